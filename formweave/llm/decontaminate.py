"""Benchmark decontamination: hash set of normalised test n-grams, scanned over the word windows of the documents.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. A test item gives each
window of ``n`` consecutive words; a shorter item, if it has a word, is one window. The windows' hashes are broadcast to the
scan, which looks every document window up in the sorted hashes and compares the words of each hit. The benchmark's bytes are
counted first: items are dealt into blocks of at most about ``BLOCK_BYTES``, and the documents pass the blocks one after
another, so a broadcast is bounded however large the benchmark is. The scan has no shuffle.

Null or empty texts and items have no words: nothing is hit. A null item id is listed as ``null``; equal ids count once;
repeated documents are scanned one by one. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from formweave.llm import words as W
from formweave.llm.tables import stored

N = 10
BLOCK_BYTES = 32 << 20
_SCAN = [StructField("n_words", LongType()), StructField("spans", ArrayType(ArrayType(IntegerType()))), StructField("items", ArrayType(StringType()))]


class NgramSet:
    """Windows of a block of items: per length the sorted hashes, and per hash the words and items behind it."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for _, _, w in W.words(pa.array([t for _, t in items], pa.string()), W.ALPHANUMERIC, lower=True, size=1 << 40):
            sizes = np.minimum(w.count(), n)
            for size in np.unique(sizes[sizes > 0]).tolist():
                h, at = w.windows(size)
                of = w.text_of()[at]
                for x, a, i in zip(h.tolist(), at.tolist(), of.tolist(), strict=True):
                    if sizes[i] == size:
                        found.setdefault(size, {}).setdefault(x, {}).setdefault(w.piece(a, a + size), set()).add(items[i][0])
        self.sizes = {size: (np.array(sorted(by), np.uint64), by) for size, by in sorted(found.items())}

    def hits(self, w: W.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Flag per word covered by an occurrence; per text with occurrences, the items."""
        cover, items, n = np.zeros(len(w.hash) + 1, np.int64), {}, len(w.hash)
        for size, (known, by) in self.sizes.items():
            h, at = w.windows(size)
            spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for k in np.flatnonzero(known[spot] == h).tolist():
                a = int(at[k])
                if who := by[int(h[k])].get(w.piece(a, a + size)):
                    cover[a] += 1
                    cover[a + size] -= 1
                    items.setdefault(int(np.searchsorted(w.first, a, "right")) - 1, set()).update(who)
        return np.cumsum(cover[:n]) > 0, items


def _runs(flags: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length(F.coalesce("t", F.lit(""))))).first()[0] or 0
    k = total // block_bytes + 1
    for b in range(k):
        mine = rows if k == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == b)
        yield [(r.i, r.t) for r in mine.collect()]  # at most about block_bytes


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Per document: its id, (the text,) ``n_words``, ``spans`` (merged [first, end) word ranges hit), ``items`` (sorted ids)."""
    out = docs.select(F.col(doc_id), F.col(text))
    base = out.schema
    for k, block in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        known = docs.sparkSession.sparkContext.broadcast(NgramSet(block, n))
        if k:
            out = stored(out, "decontaminate")

        def run(batches: Iterator[pa.RecordBatch], known=known, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old_spans = batch.column(3).to_pylist() if k else None
                old_items = batch.column(4).to_pylist() if k else None
                counts, spans, items = [], [], []
                for a, b, w in W.words(batch.column(1), W.ALPHANUMERIC, lower=True):
                    hit, who = known.value.hits(w)
                    counts += w.count().tolist()
                    for d in range(b - a):
                        own = hit[w.first[d] : w.first[d + 1]]
                        ids = who.get(d, set())
                        if k and old_spans[a + d]:
                            own = own.copy()
                            for x, y in old_spans[a + d]:
                                own[x:y] = True
                            ids = ids | set(old_items[a + d])
                        spans.append(_runs(own) if own.any() else [])
                        items.append(sorted(ids))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                                      names=[*base.names, "n_words", "spans", "items"])

        out = out.mapInArrow(run, StructType([*base.fields, *_SCAN]))
    return out if keep_text else out.select(F.col(base.names[0]), "n_words", "spans", "items")


def without_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no benchmark window occurs in, all columns unchanged."""
    return _filtered(docs, benchmark, n, text, item, item_text, block_bytes, False)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents; in the text, each run of hit words (first to last letter) is cut out. Items are judged block by block."""
    return _filtered(docs, benchmark, n, text, item, item_text, block_bytes, True)


def _filtered(docs, benchmark, n, text, item, item_text, block_bytes, spans: bool) -> DataFrame:
    at, schema = docs.columns.index(text), docs.schema
    out = docs
    for block in _blocks(benchmark, item, item_text, block_bytes):
        known = docs.sparkSession.sparkContext.broadcast(NgramSet(block, n))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, texts = [], batch.column(at).to_pylist() if spans else []
                for a, b, w in W.words(batch.column(at), W.ALPHANUMERIC, lower=True):
                    hit, who = known.value.hits(w)
                    keep += [d not in who for d in range(b - a)]
                    for d in who if spans else ():
                        raw, zero = texts[a + d].encode(), int(w.begin[d])
                        cuts = [(int(w.start[w.first[d] + x]) - zero, int(w.end[w.first[d] + y - 1]) - zero) for x, y in _runs(hit[w.first[d] : w.first[d + 1]])]
                        bits, last = [], 0
                        for x, y in cuts:
                            bits.append(raw[last:x])
                            last = y
                        texts[a + d] = b"".join([*bits, raw[last:]]).decode()
                if spans:
                    yield pa.record_batch([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], schema=batch.schema)
                else:
                    yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
