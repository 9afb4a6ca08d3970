"""Deterministic automaton over tokens, compiled from a list of byte-pair merges by one merge gadget after the other.

The automaton accepts exactly the token sequences that the merges, applied in order, produce. A state stands for the token
read last; at first every symbol follows every symbol. The gadget of the merge ``u v -> w`` makes three changes:

* state ``w`` is a copy of state ``v`` (what may follow ``v`` now may follow ``w``);
* arc ``w`` is a copy of arc ``u`` (what may stand before ``u`` now may stand before ``w``);
* the arc ``v`` leaves state ``u``, for from now on the pair is always merged, and with it the arcs of all later tokens that
  begin with ``v``. If ``u`` and ``v`` are the same token, the arc ``w`` goes too: of three in a row the first two merge.

Arcs are not stored one by one. Tokens are numbered in preorder of the tree "is the left part of", later children first, so at
any moment the tokens still to come that begin with ``v`` follow ``v`` without a gap. Copies of arcs are then implied by
the numbers, and a state is a sorted list of number ranges that are cut out of its arcs. The size of the automaton depends on the
vocabulary alone.

``encode`` follows the arcs with the longest matching token first. For each prefix of a word there is one accepted path at
most, so a position that once led nowhere never needs another try, and a word takes time in proportion to its length.
``encode_many`` takes the same steps for many words at once, each step a look-up in the tables for all words still on their way.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np


class TokenAutomaton:
    """``symbols``: the symbols that words are made of. ``merges``: pairs of tokens in order. Tokens are strings of symbols, each
    symbol one character. ``closing``: symbols that end a word, so nothing follows a token that ends with one."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]], closing: frozenset[str] = frozenset()):
        tokens = [*symbols, *(u + v for u, v in merges)]
        place = {t: k for k, t in enumerate(tokens)}
        if len(place) < len(tokens):
            raise ValueError("two merges give the same token")
        base = len(symbols)
        pairs = [(place[u], place[v]) for u, v in merges]
        if any(max(p) >= base + k for k, p in enumerate(pairs)):
            raise ValueError("a merge uses a token of a later merge")
        number, ends = _preorder(base, [u for u, _ in pairs])
        cuts: list[list[tuple[int, int]] | None] = [None if t[-1:] in closing else [] for t in tokens]
        ahead = list(ends)  # tokens to come that begin with k have the numbers from number[k] + 1 up to this
        for k, (u, v) in enumerate(pairs):
            w = base + k
            if cuts[v] is not None:
                cuts[w] = list(cuts[v])
            cuts[u].append((number[v], ahead[v]))
            ahead[u] = number[w]
        self.tokens = tokens
        self.number = number
        edges = [_joined(c) if c else () for c in cuts]
        self._edge_of = np.cumsum([0, *map(len, edges)])
        self._edges = np.array([x for e in edges for x in e], np.int32)
        self._tree()
        self._open()

    def _tree(self) -> None:
        """The tree of the tokens' symbols: keys (node, symbol) in order, the nodes they lead to, the token at each node (or -1);
        and for each token the longest other one that it begins with (or -1)."""
        symbols = sorted(t for t in self.tokens if len(t) == 1)
        self._symbol = np.full(ord(symbols[-1]) + 1, -1, np.int64)
        self._symbol[[ord(c) for c in symbols]] = np.arange(len(symbols))
        self._n_symbols = len(symbols)
        found: dict[int, int] = {}
        token, shorter = [-1], [-1] * len(self.tokens)
        for t in sorted(range(len(self.tokens)), key=lambda t: len(self.tokens[t])):
            node = 0
            for c in self.tokens[t]:
                if token[node] >= 0:
                    shorter[t] = token[node]
                node = found.setdefault(node * len(symbols) + int(self._symbol[ord(c)]), len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        keys = np.array(list(found))
        order = np.argsort(keys)
        self._keys, self._to = keys[order], np.array(list(found.values()))[order]
        self._token, self._shorter = np.array(token), np.array([*shorter, -1])

    def _open(self) -> None:
        """What follows from the other tables; made anew where the automaton arrives."""
        self._long = np.array([*map(len, self.tokens), 0])
        self._number = np.array([*self.number, 0])
        self._arcs = (np.repeat(np.arange(len(self.tokens)), np.diff(self._edge_of)) << 32) + self._edges
        self._one_by_one = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_long", "_number", "_arcs", "_one_by_one")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def follows(self, state: int, token: int) -> bool:
        """Is there an arc ``token`` out of the state of the token ``state``?"""
        lo = int(self._edge_of[state])
        return not (bisect_right(self._edges, self.number[token], lo, int(self._edge_of[state + 1])) - lo) & 1

    def encode(self, word: str) -> list[int]:
        """The tokens (their places in ``tokens``) of the one path that spells the word; KeyError for an unknown symbol."""
        if self._one_by_one is None:
            self._one_by_one = dict(zip(self._keys.tolist(), self._to.tolist(), strict=True)), self._token.tolist(), self._shorter.tolist(), self._long.tolist()
        to, token_at, shorter, long = self._one_by_one
        symbols = self._symbols(word).tolist()
        path: list[int] = []
        dead: set[int] = set()
        at, n, width = 0, len(symbols), self._n_symbols
        while at < n:
            node, token = 0, -1
            for i in range(at, n):
                node = to.get(node * width + symbols[i])
                if node is None:
                    break
                if token_at[node] >= 0:
                    token = token_at[node]
            while True:
                while token >= 0 and (at + long[token] in dead or (path and not self.follows(path[-1], token))):
                    token = shorter[token]
                if token >= 0:
                    path.append(token)
                    at += long[token]
                    break
                dead.add(at)
                if not path:
                    raise ValueError("no path spells the word")
                token = path.pop()
                at -= long[token]
                token = shorter[token]
        return path

    def _symbols(self, text: str) -> np.ndarray:
        """Numbers of the symbols of the text."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        out = self._symbol[np.minimum(code, len(self._symbol) - 1)]
        if code.size and (out.min() < 0 or code.max() >= len(self._symbol)):
            raise KeyError("unknown symbol")
        return out

    def encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and how many each word has. Words must not be empty."""
        keys, to, token, n_symbols = self._keys, self._to, self._token, self._n_symbols
        edges, number, long, shorter = self._arcs, self._number, self._long, self._shorter
        code = self._symbols("".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        best = np.full(len(code) + 1, -1)
        left = np.repeat(ends, ends - begin) - np.arange(len(code))
        at, node, deep = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        while at.size:  # the longest token from each position on
            key = node * n_symbols + code[at + deep]
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[spot] == key
            at, node, deep = at[hit], to[spot[hit]], deep + 1
            found = token[node]
            best[at[found >= 0]] = found[found >= 0]
            more = left[at] > deep
            at, node = at[more], node[more]
        path, before = np.full(len(code) + 1, -1), np.full(len(code) + 1, -1)
        on, dead = np.zeros(len(code) + 1, bool), np.zeros(len(code) + 1, bool)
        at, state, end = begin.copy(), np.full(len(words), -1), ends
        now = best[at]
        while at.size:
            next_at = at + long[now]
            cut = np.searchsorted(edges, (np.maximum(state, 0) << 32) + number[now], "right") - self._edge_of[np.maximum(state, 0)]
            fits = (now >= 0) & ((state < 0) | ((cut & 1) == 0)) & ~dead[next_at]
            on[at[fits]], path[at[fits]] = True, now[fits]
            goes = fits & (next_at < end)
            before[next_at[goes]] = now[goes]  # a word's first position keeps -1: there is nothing before it
            back = ~fits & (now < 0)
            if back.any():
                dead[at[back]] = True
                if (state[back] < 0).any():
                    raise ValueError("no path spells a word")
            tried = np.where(back, state, now)
            at = np.where(fits, next_at, np.where(back, at - long[state], at))
            on[at[back]] = False
            keep = ~fits | goes
            at, end, fits, back, tried, state, now = at[keep], end[keep], fits[keep], back[keep], tried[keep], state[keep], now[keep]
            state = np.where(fits, now, np.where(back, before[at], state))
            now = np.where(fits, best[at], shorter[tried])
        taken = np.flatnonzero(on)
        return path[taken], np.diff(np.searchsorted(taken, np.concatenate([begin, ends[-1:]])))


def _preorder(base: int, left: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of the tokens in preorder of the tree in which ``left`` names the parents of the tokens from ``base`` on, children
    made later before those made earlier; and the first number beyond each token's subtree."""
    sizes = [1] * (base + len(left))
    for k in range(len(left) - 1, -1, -1):
        sizes[left[k]] += sizes[base + k]
    number, ends, free = [0] * len(sizes), [0] * len(sizes), 0
    last: list[int] = [0] * len(sizes)  # the first number that the children placed so far take, from the end
    for k in range(len(sizes)):
        if k < base:
            number[k], free = free, free + sizes[k]
        else:
            number[k] = last[left[k - base]] - sizes[k]
            last[left[k - base]] = number[k]
        ends[k] = last[k] = number[k] + sizes[k]
    return number, ends


def _joined(ranges: list[tuple[int, int]]) -> list[int]:
    """Edges of the union of the ranges: in, out, in, out."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out
