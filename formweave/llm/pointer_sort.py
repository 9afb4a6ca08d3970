"""Sorting words by pointers to where they begin in a text buffer: multikey quicksort, eight bytes at a time.

A batch of texts is one byte buffer; a word is a pointer to its first byte and its length. Pointers are split in three around a
pivot block of eight bytes (less, equal, greater) until a slice is small; small slices are put in order by their blocks. Pointers with
equal blocks go on with the next eight bytes, all their slices together, unless the word has ended. Pointers of equal words stay in the order of the buffer.
No word is copied or hashed, so equal runs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from formweave.llm.words import buffers, slices

SMALL = 1 << 14


class Pointers:
    """Word starts in the texts ``a`` to ``b - 1`` of a batch; ``cuts`` flags bytes at which a new piece begins after a word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, breaks: np.ndarray | None = None):
        """``data``: bytes of the texts that begin at ``bounds``; ``inside``, ``breaks``: 256 flags, is the byte of a word, does it end a
        piece. Words of different pieces, as of different texts, are no neighbours."""
        n = len(data)
        mask = np.zeros(n + 1, bool)
        mask[:n] = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        starts = mask.copy()
        starts[1:] &= ~mask[:-1] | edge[1:]
        self.start = np.flatnonzero(starts)
        ends = ~mask
        ends[1:] |= edge[1:]
        stops = np.zeros(n + 1, bool)
        stops[1:] = mask[:-1] & ends[1:]
        self.size = np.flatnonzero(stops) - self.start
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.first = np.searchsorted(self.start, bounds)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        piece = np.cumsum(breaks[data]) if breaks is not None else np.zeros(max(n, 1), np.int64)
        self.piece = piece[self.start] + self.text if len(self.start) else self.start

    def blocks(self, at: np.ndarray, deep: int) -> np.ndarray:
        """Eight bytes of each word from byte ``deep`` on as a number in byte order; zeros beyond the word's end."""
        where, left = self.start[at] + deep, self.size[at] - deep
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            byte = self.data[where + k].astype(np.uint64)
            byte[left <= k] = 0
            out = (out << np.uint64(8)) | byte
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointers (their places in ``start``) in order of the words' bytes, and where the runs of equal words begin."""
        order = np.arange(len(self.start))
        heads = np.zeros(len(order), bool)
        open_, group, deep = order.copy(), np.zeros(len(order), np.int64), 0  # places not yet told apart from others of their group
        while open_.size:
            at = order[open_]
            keys = self.blocks(at, deep)
            rest = np.minimum(self.size[at] - deep, 9)  # bytes still to come; 9 for any number beyond this block
            by = _arranged(group, keys, rest)
            order[open_], group, keys, rest = at[by], group[by], keys[by], rest[by]
            new = np.ones(len(by), bool)
            new[1:] = (np.diff(group) != 0) | (keys[1:] != keys[:-1]) | (np.diff(rest) != 0)
            heads[open_[new]] = True
            run = np.cumsum(new) - 1
            on = (rest == 9) & (np.bincount(run)[run] > 1)
            open_, group, deep = open_[on], run[on], deep + 8
        return order, np.flatnonzero(heads)

    def words(self, at: np.ndarray) -> pa.Array:
        """The words behind the pointers as an Arrow array of bytes."""
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], size)
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.data[take])])


def _arranged(group: np.ndarray, keys: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The order by (group, key, rest), equal ones as they come. Groups are sorted already; a large one is split around pivots."""
    out = np.arange(len(keys))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(keys)]])
    large = np.flatnonzero(np.diff(edges) > SMALL)
    small = np.ones(len(keys), bool)
    for a, b in zip(edges[large].tolist(), edges[large + 1].tolist(), strict=True):
        small[a:b] = False
        _quicksort(out, keys, rest, a, b)
    left = np.flatnonzero(small)
    if left.size:
        out[left] = left[np.lexsort((rest[left], keys[left], group[left]))]
    return out


def _quicksort(out: np.ndarray, keys: np.ndarray, rest: np.ndarray, a: int, b: int) -> None:
    """Three-way splits of places a to b - 1 around pivot keys; slices of at most SMALL are sorted outright."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        part = out[x:y]
        own = keys[part]
        if y - x <= SMALL:
            out[x:y] = part[np.lexsort((rest[part], own))]
            continue
        pivot = np.sort(own[:: max(1, (y - x) // 9)])[4 if y - x > 8 else 0]
        less, more = own < pivot, own > pivot
        same = part[~(less | more)]
        if (rest[same] != rest[same[0]]).any():
            same = same[np.argsort(rest[same], kind="stable")]
        lower, upper = part[less], part[more]
        out[x:y] = np.concatenate([lower, same, upper])
        todo += [(p, q) for p, q in ((x, x + len(lower)), (y - len(upper), y)) if q > p]


def pointers(text: pa.Array, inside: np.ndarray, size: int, lower: np.ndarray | None = None, breaks: np.ndarray | None = None) -> Iterator[tuple[int, int, Pointers]]:
    """Rows a to b - 1 of the array and their word pointers, about ``size`` bytes at a time; ``lower`` maps bytes first."""
    data, off = buffers(text)
    for a, b in slices(off, size):
        part = data[off[a] : off[b]]
        yield a, b, Pointers(part if lower is None else lower[part], off[a : b + 1] - off[a], inside, breaks)
