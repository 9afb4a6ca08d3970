"""Weighted acyclic automaton over words: each path from the root spells a language and a phrase, its weight is a count.

States are kept level by level in arrays. The arcs of level k + 1 are in order of (state of level k, label), so the arcs of a state lie
next to each other, and every arc carries the count of the path that ends with it. Level 0 has the languages; its labels, like all
others, are places in the sorted list of words. Automata are built from sorted phrases, cut into parts by ranges of a prefix (the
hash of the language and the first two words), united by adding weights, and pruned.

On its way an automaton is one byte string: before it is written, states of the last level with equal arcs (labels and weights) are
made one, so phrases that go on alike share what follows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from formweave.llm.words import mix, name_hashes

_U = np.uint64


class CountAutomaton:
    """``words``: sorted byte strings (an Arrow array). Per level the arrays ``parent`` (state of the level before; 0 at level 0), ``label``
    and ``weight``; ``parent`` and then ``label`` rise. The weight of a path that is only there for its ends is 0."""

    def __init__(self, words: pa.LargeBinaryArray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @staticmethod
    def counted(words: pa.LargeBinaryArray, paths: list[np.ndarray]) -> CountAutomaton:
        """From occurrences: ``paths[k]`` has per place the label of level k, or -1 where the phrase has ended before. A place
        counts for every level that it reaches."""
        levels, state, here = [], np.zeros(len(paths[0]), np.int64), np.arange(len(paths[0]))
        for k, labels in enumerate(paths):
            on = labels[here] >= 0
            here, state = here[on], state[on]
            key = state * len(words) + labels[here]
            order = np.argsort(key, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = np.diff(key[order]) != 0
            at = np.flatnonzero(first)
            own = key[order[at]]
            levels.append((own // max(len(words), 1), own % max(len(words), 1), np.diff(np.concatenate([at, [len(order)]]))))
            state[order] = np.cumsum(first) - 1
        return CountAutomaton(words, levels)

    def path_labels(self, level: int) -> list[np.ndarray]:
        """Labels of levels 0 to ``level`` for each arc of that level."""
        out, state = [], np.arange(len(self.levels[level][0]))
        for k in range(level, -1, -1):
            out.append(self.levels[k][1][state])
            state = self.levels[k][0][state]
        return out[::-1]

    def ranges(self, parts: int, level: int) -> np.ndarray:
        """For each arc of the level, the range of its prefix: of the hash of its labels up to level 2 (the first two words)."""
        return range_of(self.path_labels(level), name_hashes(self.words), parts)

    def parts(self, n: int) -> Iterator[tuple[int, CountAutomaton]]:
        """The automaton cut into prefix ranges, each with the phrases whose arc is in the range; states that are only on the way to
        them have weight 0. One sort for all ranges together."""
        of: list[np.ndarray] = []
        for k, (parent, _, _) in enumerate(self.levels):
            of.append(self.ranges(n, k) if k <= 2 else of[-1][parent])
        cells, up = [], np.empty(0, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            m = len(self.levels[k][0])
            keys = np.unique(np.concatenate([of[k] * m + np.arange(m), up]))
            cells.append(keys)
            if k:
                up = keys // m * len(self.levels[k - 1][0]) + self.levels[k][0][keys % m]
        cells.reverse()
        flat, edges = [], []
        for k, (keys, (parent, label, weight)) in enumerate(zip(cells, self.levels, strict=True)):
            m = max(len(parent), 1)
            own, at = keys // m, keys % m
            edge = np.searchsorted(own, np.arange(n + 1))
            local = np.zeros(len(keys), np.int64)
            if k:
                local = np.searchsorted(cells[k - 1], own * len(self.levels[k - 1][0]) + parent[at]) - edges[-1][own]
            flat.append((local, label[at], np.where(of[k][at] == own, weight[at], 0)))
            edges.append(edge)
        for r in range(n):
            if edges[0][r] < edges[0][r + 1]:
                yield r, self._renamed([tuple(x[e[r] : e[r + 1]] for x in level) for level, e in zip(flat, edges, strict=True)])

    def _renamed(self, levels: list[tuple[np.ndarray, ...]]) -> CountAutomaton:
        """With those words only that the levels use."""
        used = np.unique(np.concatenate([label for _, label, _ in levels]))
        return CountAutomaton(self.words.take(pa.array(used)), [(p, np.searchsorted(used, x), w) for p, x, w in levels])

    def pruned(self, least: int) -> CountAutomaton:
        """Without phrases of words that count less than ``least`` (unless a longer one counts that much); languages stay."""
        keep, need = [], np.empty(0, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            parent, _, weight = self.levels[k]
            hold = np.ones(len(parent), bool) if k == 0 else weight >= least
            hold[need] = True
            keep.append(hold)
            need = parent[hold]
        levels, new = [], np.zeros(1, np.int64)
        for hold, (parent, label, weight) in zip(keep[::-1], self.levels, strict=True):
            levels.append((new[parent[hold]], label[hold], np.where((weight >= least) | (len(levels) == 0), weight, 0)[hold]))
            new = np.cumsum(hold) - 1
        return self._renamed(levels)

    @staticmethod
    def union(parts: list[CountAutomaton]) -> CountAutomaton:
        """All phrases of the parts; weights of the same phrase are added."""
        words, new = merged_words([p.words for p in parts])
        levels, states = [], [np.zeros(1, np.int64) for _ in parts]
        for k in range(max(len(p.levels) for p in parts)):
            keys, weights = [], []
            for p, up, place in zip(parts, states, new, strict=True):
                parent, label, weight = p.levels[k]
                keys.append(up[parent] * len(words) + place[label])
                weights.append(weight)
            both = np.concatenate(keys)
            order = np.argsort(both, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = np.diff(both[order]) != 0
            at = np.flatnonzero(first)
            total = np.add.reduceat(np.concatenate(weights)[order], at) if len(at) else np.empty(0, np.int64)
            key = both[order[at]]
            levels.append((key // max(len(words), 1), key % max(len(words), 1), total))
            state = np.empty(len(order), np.int64)
            state[order] = np.cumsum(first) - 1
            states = np.split(state, np.cumsum([len(x) for x in keys])[:-1])
        return CountAutomaton(words, levels)

    def phrases(self, level: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Labels by level, and the weights, of the phrases that end at the level with a weight."""
        weight = self.levels[level][2]
        at = np.flatnonzero(weight > 0)
        return [x[at] for x in self.path_labels(level)], weight[at]

    def compose(self, lang: pa.Array, phrases: pa.Array) -> np.ndarray:
        """Composition with phrases (a language each, and words joined by blanks) as an automaton without weights: the weight of each
        phrase, 0 where it is not."""
        rows = pc.split_pattern(phrases.cast(pa.large_string()), " ")
        size = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        first = np.cumsum(size) - size
        beyond = len(self.words)
        named = lambda x: pc.fill_null(pc.index_in(x.cast(pa.large_binary()), self.words), beyond).to_numpy(zero_copy_only=False).astype(np.int64)
        langs, labels = named(lang), named(rows.flatten())
        out = np.zeros(len(phrases), np.int64)
        state, here = np.zeros(len(phrases), np.int64), np.arange(len(phrases))
        for k, (parent, label, weight) in enumerate(self.levels):
            key = parent * (beyond + 1) + label
            want = state * (beyond + 1) + (labels[first[here] + k - 1] if k else langs[here])
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            hit = key[at] == want if len(key) else np.zeros(len(want), bool)
            here, state = here[hit], at[hit]
            ends = size[here] == k
            out[here[ends]] = weight[state[ends]]
            here, state = here[~ends], state[~ends]
        return out

    def to_bytes(self) -> bytes:
        """As bytes; last-level states with equal arcs are stored once."""
        arrays: list[np.ndarray] = []
        for k, (parent, label, weight) in enumerate(self.levels):
            last = k == len(self.levels) - 1 and k > 0
            n_states = len(self.levels[k - 1][0]) if k else 1
            counts = np.bincount(parent, minlength=n_states)
            if last and len(parent):
                with np.errstate(over="ignore"):
                    arc = mix(label.astype(_U) * _U(0x9E3779B97F4A7C15) + mix(weight.astype(_U), 1), 2)
                    sums = np.concatenate([np.zeros(1, _U), np.cumsum(arc)])
                    name = sums[np.cumsum(counts)] - sums[np.cumsum(counts) - counts] + counts.astype(_U)
                _, one, of = np.unique(name, return_index=True, return_inverse=True)
                starts = np.cumsum(counts) - counts
                take = _ranges(starts[one], counts[one])
                same = _ranges(starts[one][of], counts[one][of])
                if np.array_equal(label[same], label) and np.array_equal(weight[same], weight) and np.array_equal(counts[one][of], counts):
                    arrays += [of, counts[one], label[take], weight[take]]
                    continue
            arrays += [np.arange(n_states if last else 0), counts, label, weight]
        off, words = _flat(self.words)
        head = [len(self.levels), len(words)]
        body = [words]
        for a in [np.diff(off), *arrays]:
            size = next(s for s in (1, 2, 4, 8) if not a.size or int(a.max()) < 1 << (8 * s - 1))
            raw = a.astype(f"<i{size}").tobytes()
            head += [size, len(a)]
            body.append(raw)
        flat = b"".join(body)
        return struct.pack(f"<q{len(head)}q", len(head), *head) + pa.compress(flat, "zstd", asbytes=True)

    @staticmethod
    def from_bytes(raw: bytes) -> CountAutomaton:
        n = struct.unpack_from("<q", raw)[0]
        head = struct.unpack_from(f"<{n}q", raw, 8)
        n_levels, at = head[:2]
        sizes = list(zip(head[2::2], head[3::2], strict=True))
        flat = pa.decompress(raw[8 + 8 * n :], at + sum(s * m for s, m in sizes), "zstd", asbytes=True)
        text, arrays = pa.py_buffer(flat[:at]), []
        for s, m in sizes:
            arrays.append(np.frombuffer(flat, f"<i{s}", m, at).astype(np.int64))
            at += s * m
        off = np.concatenate([[0], np.cumsum(arrays[0])]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), text])
        levels, n_states = [], 1
        for k in range(n_levels):
            of, counts, label, weight = arrays[4 * k + 1 : 4 * k + 5]
            if k == n_levels - 1 and k > 0 and len(of):
                starts = np.cumsum(counts) - counts
                take = _ranges(starts[of], counts[of])
                counts, label, weight = counts[of], label[take], weight[take]
            levels.append((np.repeat(np.arange(n_states), counts), label, weight))
            n_states = len(label)
        return CountAutomaton(words, levels)


def range_of(labels: list[np.ndarray], names: np.ndarray, parts: int) -> np.ndarray:
    """The prefix range of paths with these labels by level; ``names``: hash of each word."""
    h = np.full(len(labels[0]), _U(7))
    with np.errstate(over="ignore"):
        for x in labels[:3]:
            h = mix(h * _U(0xFF51AFD7ED558CCD) + names[x])
    return (h >> _U(32)).astype(np.int64) * parts >> 32


def merged_words(lists: list[pa.LargeBinaryArray]) -> tuple[pa.LargeBinaryArray, list[np.ndarray]]:
    """All words in order, each once, and the place of each list's words among them."""
    coded = pa.concat_arrays([pa.array([], pa.large_binary()), *lists]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    new = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    return coded.dictionary.take(pa.array(order)), np.split(new, np.cumsum([len(x) for x in lists])[:-1])


def _flat(words: pa.LargeBinaryArray) -> tuple[np.ndarray, bytes]:
    """Offsets from 0, and the bytes, of the words."""
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    return off - off[0], data[int(off[0]) : int(off[-1])].to_pybytes() if data is not None and len(words) else b""


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … counts[0] numbers, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)
