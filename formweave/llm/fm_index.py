"""A compressed full-text index over word sequences: suffix order, Burrows-Wheeler transform, 16-ary wavelet matrix.

Only backward search is offered, for many patterns side by side. Each sequence ends with a sentinel of its own, so all
suffixes differ and the order is complete.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 32


class FmIndex:
    def __init__(self, symbols: np.ndarray, ends: np.ndarray, weights: np.ndarray):
        """``symbols``: words as numbers from 1, 0 at the sequence ends ``ends``; ``weights``: how often each sequence counts."""
        n, k = len(symbols), len(ends)
        rank = symbols.astype(np.int64) + k - 1
        rank[ends] = np.arange(k)
        step = 1
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:-step or None] = rank[step:] + 1 if step < n else 0
            key = rank * (max(n, int(rank.max()) + 1) + 2) + nxt
            order = np.argsort(key, kind="stable")
            s = key[order]
            fresh = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        sequence = np.repeat(np.arange(k), np.diff(np.concatenate([[-1], ends])))
        self.total = np.concatenate([[0], np.cumsum(weights[sequence[order]])])
        top = int(symbols.max()) + 1
        self.before = np.searchsorted(np.sort(symbols), np.arange(top + 1))  # rows that begin with a smaller symbol
        self.n = n
        self._wavelet(symbols[order - 1], top)

    def _wavelet(self, bwt: np.ndarray, top: int) -> None:
        digits = max(1, (int(top - 1).bit_length() + 3) // 4)
        self.shifts, self.levels = [4 * i for i in range(digits - 1, -1, -1)], []
        rows = -(-(self.n + 1) // _BLOCK)
        for shift in self.shifts:
            d = ((bwt >> shift) & 15).astype(np.uint8)
            padded = np.full(rows * _BLOCK, 255, np.uint8)
            padded[: self.n] = d
            blocks = padded.reshape(rows, _BLOCK)
            counts = np.stack([(blocks == x).sum(axis=1, dtype=np.int32) for x in range(16)], axis=1)
            seen = np.zeros((rows, 16), np.int32)
            np.cumsum(counts[:-1], axis=0, out=seen[1:])
            first = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])[:16]
            self.levels.append((blocks, (seen + first).astype(np.int32)))
            bwt = bwt[np.argsort(d, kind="stable")]
        every = np.arange(top)
        self.base = self._place(every, np.zeros(top, np.int64))

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = np.arange(_BLOCK, dtype=np.int64)
        for shift, (blocks, seen) in zip(self.shifts, self.levels, strict=True):
            d = (symbol >> shift) & 15
            row, off = at // _BLOCK, at % _BLOCK
            at = seen[row, d] + ((blocks[row] == d[:, None].astype(np.uint8)) & (inside < off[:, None])).sum(axis=1)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns made longer by one symbol on the left."""
        both = self._place(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.tile(self.base[symbol] - self.before[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.total[hi] - self.total[lo]


def repeated_windows(symbols: np.ndarray, ends: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """Per position: does the window of ``window`` words that starts there lie in one sequence and occur twice or more?

    For a range of window starts the words below all of them are matched from the right end to the left (the matching
    statistic of that end). What was matched settles the windows inside it; where it ended early, the range is made shorter.
    """
    index, n = FmIndex(symbols, ends, weights), len(symbols)
    begins = np.concatenate([[0], ends[:-1] + 1])
    first, last = begins.astype(np.int64), (ends - window).astype(np.int64)  # window starts still open, both ends included
    out = np.zeros(n, bool)
    keep = last >= first
    first, last = first[keep], last[keep]
    while len(first):
        at = last + window  # the next word to match is at - 1
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
        live = np.arange(len(at))
        while len(live):
            a, b = index.extend(symbols[at[live] - 1], lo[live], hi[live])
            good = index.weight(a, b) >= 2
            live, a, b = live[good], a[good], b[good]
            lo[live], hi[live] = a, b
            at[live] -= 1
            live = live[at[live] > first[live]]
        # words from `at` to the end occur twice; with the word before, they don't, unless `at` is the first
        some = at <= last
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, at[some], 1)
        np.add.at(marks, last[some] + 1, -1)
        out |= np.cumsum(marks[:n]) > 0
        last = np.where(some, at - 1, last - 1)
        keep = last >= first
        first, last = first[keep], last[keep]
    return out
