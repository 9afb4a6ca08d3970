"""Words and word windows of whole Arrow text batches as NumPy arrays.

Texts are cut into words on their UTF-8 bytes, all texts of a slice at once. A word is named by a 64-bit hash of its bytes
(a polynomial in an odd base, then mixed with the length). A batch is taken in slices of about ``SLICE`` bytes, so memory
does not depend on the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def byte_classes(separators: bytes | None = None, word_ascii: bytes | None = None) -> np.ndarray:
    """256 flags: does a byte belong to a word? Bytes of characters beyond ASCII always do unless they are separators."""
    flags = np.ones(256, bool)
    if word_ascii is not None:
        flags[:128] = False
        flags[list(word_ascii)] = True
    if separators is not None:
        flags[list(separators)] = False
    return flags


BLANK_SEPARATED = byte_classes(separators=b" \t\n\x0b\x0c\r")
ALPHANUMERIC = byte_classes(word_ascii=b"0123456789abcdefghijklmnopqrstuvwxyz")
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[:] = _U(base & (2**64 - 1))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    n = 0

    def get(self, n: int):
        if n > self.n:
            self.n = max(n, SLICE * 2)
            self.up, self.down = _powers(self.n, _BASE), _powers(self.n, pow(_BASE, -1, 2**64))
        return self.up, self.down


_TABLES = _Tables()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Words:
    """Words of some texts: ``hash`` per word, byte range ``start``/``end`` in ``data``; text d begins at byte ``begin[d]`` and
    has words ``first[d]`` to ``first[d + 1] - 1``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        up, down = _TABLES.get(n + 1)
        mask = inside[self.data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[bounds] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = mask[:-1]
        starts = np.flatnonzero(mask & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = mask[1:]
        ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
        total = np.zeros(n + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(_U) + _U(1)) * up[:n], out=total[1:])
            self.hash = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
        self.start, self.end, self.begin = starts, ends, bounds
        self.first = np.searchsorted(starts, bounds)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text (its place in the slice) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of ``size`` words within one text."""
        n = len(self.hash)
        if n < size:
            return np.empty(0, _U), np.empty(0, np.int64)
        valid = np.ones(n, bool)
        for back in range(1, size):
            last = self.first[1:] - back
            valid[last[(last >= self.first[:-1])]] = False
        at = np.flatnonzero(valid[: n - size + 1])
        h = np.full(n - size + 1, _U(seed + size), _U)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = h * _U(0xFF51AFD7ED558CCD) + self.hash[k : n - size + 1 + k]
                h ^= h >> _U(29)
        return mix(h[at], seed), at

    def piece(self, a: int, b: int) -> bytes:
        """Words a to b - 1 joined by one blank."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b))


def name_hashes(names: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each byte string, the same in every process."""
    off = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)[off[0] : off[-1]] if len(names) and names.buffers()[2] is not None else np.empty(0, np.uint8)
    off = off - off[0] if len(off) else np.zeros(1, np.int64)
    up, down = _TABLES.get(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
        return mix((total[off[1:]] - total[off[:-1]]) * down[off[:-1]] + np.diff(off).astype(_U) * _U(0xD6E8FEB86659FD93), 5)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    big = pa.types.is_large_string(text.type)
    if not (big or pa.types.is_string(text.type)):
        text, big = text.cast(pa.string()), False
    off = np.frombuffer(text.buffers()[1], np.int64 if big else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)), off


def slices(off: np.ndarray, size: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each; at least one row, ``rows`` rows at most."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1), a + rows, n)
        yield a, b
        a = b


def words(text: pa.Array, inside: np.ndarray = BLANK_SEPARATED, lower: bool = False, size: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int, Words]]:
    """Rows a to b - 1 of the array and their words, slice by slice."""
    data, off = buffers(text)
    for a, b in slices(off, size, rows):
        yield a, b, Words(data[off[a] : off[b]], off[a : b + 1] - off[a], inside, lower)
