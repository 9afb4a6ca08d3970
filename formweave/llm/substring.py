"""Substring dedup: compressed FM-index per shard, backward search for matching statistics.

A window is ``window`` consecutive words of one text. Every word that lies in a window whose words also start anywhere else
is reported. A plain sharding would search every document in every shard; here shards are cut by content, so the work grows
with the input:

1. The anchor of a window is the least hash among its ``ANCHOR``-word runs. Neighbouring windows with one anchor form a
   segment (``RUN`` windows at most). Equal windows have equal anchors, so only segments of anchors that occur again matter.
2. Segments with equal words are one class with a count, so an index holds the words of many copies once. Classes are dealt
   to shards by anchor. A class of an anchor with more than ``CROWD`` classes is dealt window by window, by window hash.
3. A shard indexes its classes (``FmIndex``) and matches each of them from its right end to the left while the words matched
   so far occur twice, counting each class as often as it occurs. This settles each window of each class.
4. The settled windows go back to the segments by class, and to the documents by row.

Classes are named by two 64-bit hashes, words inside the index by one. Null and empty texts have no words. Repeated rows are
repeated text: their long passages are reported like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm import words as W
from formweave.llm.fm_index import repeated_windows
from formweave.llm.jaccard import _Blobs, _blocks, _joined
from formweave.llm.tables import stored

WINDOW, ANCHOR, RUN, CROWD = 35, 8, 28, 256
_U = np.uint64
_B = 0xBF58476D1CE4E5B9


class _Segments:
    """Segments of some texts: first word, number of windows, anchor, hash of the words; ``twice``: the anchor occurs again inside."""

    def __init__(self, w: W.Words, window: int, bits: int):
        anchor = min(ANCHOR, window)
        n, span = len(w.hash), window - anchor + 1
        low = np.full(n + 2 * window, ~_U(0), _U)
        h, at = w.windows(anchor, seed=11)
        low[at] = h
        single, reach = low.copy(), 1
        while reach * 2 <= span:
            low[:-reach] = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low[: len(low) - (span - reach)] = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        starts = np.flatnonzero(np.arange(n) + window <= np.repeat(w.first[1:], w.count()))
        self.text_of = w.text_of()
        if not len(starts):
            self.start = self.m = np.empty(0, np.int64)
            self.anchor = self.hash = np.empty(0, _U)
            self.twice, self.text = np.empty(0, bool), np.empty(0, np.int64)
            return
        v = low[starts]
        new = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (v[1:] != v[:-1])])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
        new |= (np.arange(len(starts)) - begin) % RUN == 0
        i = np.flatnonzero(new)
        self.start, self.m = starts[i], np.diff(np.append(i, len(starts)))
        inside = self.start[:, None] + np.arange(RUN + span - 1)[None, :]
        same = (single[np.minimum(inside, len(single) - 1)] == v[i][:, None]) & (np.arange(RUN + span - 1)[None, :] < (self.m + span - 1)[:, None])
        self.twice = same.sum(axis=1) > 1
        name = W.mix(v[i], 51)  # least hashes are small numbers: mixed again, they fill all blocks alike
        self.anchor = name & ~_U((1 << (64 - bits)) - 1) | (name & _U(0xFFFFFFFF))  # the block and the lower 32 bits
        self.hash = run_hash(w, self.start, self.m + window - 1)
        self.text = self.text_of[self.start]

    def name(self, bits: int) -> np.ndarray:
        return ((self.anchor >> _U(64 - bits)).astype(np.int64) << 32) | (self.anchor & _U(0xFFFFFFFF)).astype(np.int64)


def run_hash(w: W.Words, start: np.ndarray, length: np.ndarray, seed: int = 21) -> np.ndarray:
    """Hash of ``length`` words from ``start`` on."""
    up, down = _POWERS.get(len(w.hash) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum(W.mix(w.hash, seed) * up[: len(w.hash)])])
        return W.mix((total[start + length] - total[start]) * down[start] + length.astype(_U), seed)


class _Powers:
    n = 0

    def get(self, n: int):
        if n > self.n:
            self.n = max(n, 1 << 19)
            self.up, self.down = W._powers(self.n, _B), W._powers(self.n, pow(_B, -1, 2**64))
        return self.up, self.down


_POWERS = _Powers()


def _classes(rows: DataFrame, window: int, blocks: int, crowd: int) -> DataFrame:
    """Classes of anchors that occur again: one place (``key``, ``start``), ``m``, ``anchor``, ``seg``, ``n``, ``crowded``."""
    bits = blocks.bit_length() - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = np.asarray(batch.column(0)), _Blobs(blocks, _U, np.int64, np.int64, np.int32, np.uint8, np.int32)
            for a, _, w in W.words(batch.column(1)):
                s = _Segments(w, window, bits)
                out.add(s.anchor, s.hash.view(np.int64), keys[a + s.text], (s.start - w.first[s.text]).astype(np.int32), s.m.astype(np.uint8), 1 + s.twice.astype(np.int32))
            if not out.held[0]:
                continue
            # equal segments of the batch are one entry
            cols = [np.concatenate(h) for h in out.held]
            order = np.lexsort((cols[1], cols[0]))
            cols = [c[order] for c in cols]
            at = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])) if len(order) else order
            n = np.diff(np.append(at, len(order))).astype(np.int32)
            cols = [c[at] for c in cols]
            cols[5] = np.maximum(n, cols[5])
            merged = _Blobs(blocks, *out.kinds, np.int32)
            merged.add(*cols, n)
            yield merged.rows()

    def gather(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        anchor, seg, key, start, m, seen, n = (_joined(table, f"c{i}", k) for i, k in enumerate((np.uint32, np.int64, np.int64, np.int32, np.uint8, np.int32, np.int32)))
        order = np.lexsort((start, key, seg, anchor))
        anchor, seg, key, start, m, seen, n = (c[order] for c in (anchor, seg, key, start, m, seen, n))
        at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])]))
        n, seen = np.add.reduceat(n.astype(np.int64), at), np.add.reduceat(seen.astype(np.int64), at)
        anchor, seg, key, start, m = (c[at] for c in (anchor, seg, key, start, m))
        group = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(group, len(anchor)))
        again = np.repeat(np.add.reduceat(seen, group) > 1, size)
        return pa.table({"key": key[again], "start": start[again], "m": m[again].astype(np.int32), "anchor": (anchor.astype(np.int64) | (block << 32))[again], "seg": seg[again],
                         "n": n[again], "crowded": np.repeat(size > crowd, size)[again]})

    return rows.select("key", "text").mapInArrow(cut, "block int, " + ", ".join(f"c{i} binary" for i in range(7))).groupBy("block").applyInArrow(
        gather, "key long, start int, m int, anchor long, seg long, n long, crowded boolean")


def _contents(rows: DataFrame, window: int, blocks: int) -> DataFrame:
    """What the classes of each text are made of: per class, or per window of a crowded class, the words' hashes."""
    bits = blocks.bit_length() - 1
    fields = ["block", "id1", "id2", "n", "m", "body", "anchor", "seg", "off", "crowded"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for a, b, w in W.words(batch.column(0)):
                part = lists.slice(a, b - a)
                text, flat = np.asarray(pc.list_parent_indices(part)).astype(np.int64), part.flatten()
                start, m, anchor, seg, n, crowded = (np.asarray(flat.field(i)) for i in range(6))
                first, length = w.first[text] + start, m.astype(np.int64) + window - 1
                fits = start + length <= w.count()[text]
                fits[fits] = run_hash(w, first[fits], length[fits]).view(np.int64) == seg[fits]  # else another row with the same key
                plain, single = np.flatnonzero(fits & ~crowded), np.flatnonzero(fits & crowded)
                off = np.concatenate([np.arange(x) for x in m[single]]) if len(single) else np.empty(0, np.int64)
                single = np.repeat(single, m[single])
                spots, width = first[single] + off, np.full(len(single), window)
                one, two = (run_hash(w, spots, width, seed).view(np.int64) for seed in (31, 32))
                every = np.concatenate([plain, single])
                begin, width = np.concatenate([first[plain], spots]), np.concatenate([length[plain], width])
                ends = np.concatenate([[0], np.cumsum(width)])
                body = w.hash[np.repeat(begin - ends[:-1], width) + np.arange(ends[-1])]
                zero, is_single = np.zeros(len(plain), np.int64), np.arange(len(every)) >= len(plain)
                columns = [np.concatenate([anchor[plain] >> 32, (one.view(_U) >> _U(64 - bits)).astype(np.int64)]).astype(np.int32), np.concatenate([anchor[plain], one]), np.concatenate([seg[plain], two]), n[every],
                           np.where(is_single, 1, m[every]).astype(np.int32), None, anchor[every], seg[every], np.concatenate([zero, off]).astype(np.int32), is_single]
                columns = [pa.array(c) if c is not None else pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(body)]) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return rows.mapInArrow(cut, "block int, id1 long, id2 long, n long, m int, body binary, anchor long, seg long, off int, crowded boolean")



def _searched(contents: DataFrame, window: int) -> DataFrame:
    """``id1``, ``id2``, ``bits``: which windows of a class occur twice or more."""

    def search(table: pa.Table) -> pa.Table:
        m, n = np.asarray(table.column("m")).astype(np.int64), np.asarray(table.column("n"))
        length = m + window - 1
        ends = np.cumsum(length + 1) - 1
        symbols = np.zeros(int(ends[-1]) + 1, np.int64)
        spots = np.ones(len(symbols), bool)
        spots[ends] = False
        symbols[spots] = np.unique(np.frombuffer(b"".join(x.as_py() for x in table.column("body")), _U), return_inverse=True)[1] + 1
        again = repeated_windows(symbols, ends, n, window)
        bits = np.zeros(len(m), np.int64)
        begins = np.concatenate([[0], ends[:-1] + 1])
        for k in range(int(m.max())):
            inside = m > k
            bits[inside] |= again[begins[inside] + k].astype(np.int64) << k
        return pa.table({"id1": table.column("id1"), "id2": table.column("id2"), "bits": bits})

    return contents.select("block", "id1", "id2", "n", "m", "body").groupBy("block").applyInArrow(search, "id1 long, id2 long, bits long")


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``spans`` ([first, end) word ranges that repeat), ``kept`` (the other words, one blank between)."""
    if not 1 < window:
        raise ValueError("a window has two words or more")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind, blocks = dict(rows.dtypes)["doc_id"], _blocks(docs)
    bits = blocks.bit_length() - 1
    classes = stored(_classes(rows, window, blocks, crowd), "classes")
    lists = classes.groupBy("key").agg(F.collect_list(F.struct("start", "m", "anchor", "seg", "n", "crowded")).alias("segments"))
    contents = _contents(rows.join(lists, "key").select("text", "segments"), window, blocks)
    if classes.where("crowded").isEmpty():
        found = _searched(contents, window).select(F.col("id1").alias("anchor"), F.col("id2").alias("seg"), "bits")
    else:
        contents = stored(contents, "contents")
        plain = contents.where("not crowded").select("block", "id1", "id2", "n", "m", "body")
        single = contents.where("crowded")
        found = _searched(plain.union(single.groupBy("block", "id1", "id2").agg(F.sum("n").alias("n"), F.first("m").alias("m"), F.first("body").alias("body")).where("n > 1")), window)
        found = stored(found, "found")
        own = single.select("id1", "id2", "anchor", "seg", "off").join(found.where("bits <> 0"), ["id1", "id2"]).groupBy("anchor", "seg").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"))
        found = found.join(single.select("id1", "id2").distinct(), ["id1", "id2"], "left_anti").select(F.col("id1").alias("anchor"), F.col("id2").alias("seg"), "bits").union(own)
    # stored, so that the join below stands apart from this sum and Spark can split a class that many rows hold
    found = stored(found.where("bits <> 0").groupBy("anchor", "seg").agg(F.bit_or("bits").alias("bits")), "repeated")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for a, _, w in W.words(batch.column(1)):
                s = _Segments(w, window, bits)
                yield pa.record_batch([pa.array(s.name(bits)), pa.array(s.hash.view(np.int64)), pa.array(keys[a + s.text]), pa.array((s.start - w.first[s.text]).astype(np.int32)), pa.array(s.m.astype(np.int32))], names=["anchor", "seg", "key", "start", "m"])

    at = rows.select("key", "text").mapInArrow(places, "anchor long, seg long, key long, start int, m int").join(found, ["anchor", "seg"])
    marks = at.groupBy("key").agg(F.collect_list(F.struct("start", "m", "seg", "bits")).alias("marks"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.words(batch.column(1)):
                part, raw = batch.column(2).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()
                text, flat = np.asarray(pc.list_parent_indices(part)).astype(np.int64), part.flatten()
                delta = np.zeros(len(w.hash) + window + 1, np.int64)
                if len(flat):
                    start, m, seg, mask = (np.asarray(flat.field(i)) for i in range(4))
                    first, length = w.first[text] + start, m.astype(np.int64) + window - 1
                    fits = start + length <= w.count()[text]
                    fits[fits] = run_hash(w, first[fits], length[fits]).view(np.int64) == seg[fits]  # else another row with the same key
                    for k in range(int(m.max())):
                        on = ((mask >> k) & 1).astype(bool) & fits
                        np.add.at(delta, first[on] + k, 1)
                        np.add.at(delta, first[on] + k + window, -1)
                gone = np.cumsum(delta[: len(w.hash)]) > 0
                spans, kept = [], []
                for d in range(b - a):
                    own, all_words = gone[w.first[d] : w.first[d + 1]], raw[d].encode().split()
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2).tolist() if own.any() else []
                    if edges:
                        left = [0, *(e[1] for e in edges)]
                        all_words = [x for i, (j, _) in zip(left, [*edges, [len(all_words), 0]], strict=True) for x in all_words[i:j]]
                    spans.append(edges)
                    kept.append(b" ".join(all_words).decode())
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(w.count(), pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return rows.join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(cover, f"doc_id {kind}, n_words long, spans array<array<int>>, kept string")
