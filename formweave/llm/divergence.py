"""Source divergence audit: how far the sources of a language differ in their terms, from sorted word pointers.

Each task sorts pointers to the word starts of its Arrow text buffers (``pointer_sort``); a run of equal words gives a term's
occurrences and documents per (language, source) of the slice. These partial counts are summed by Spark, map side first, so a frequent
term or a large source is one row per task. Each language keeps the terms that enough of its documents hold; with V of them and N
occurrences of them in a group, a term's share is ``1 + floor(10^9 (count + 5) / (N + 5 V))``, in whole numbers of up to 38 digits.

``term_reports`` ranks, per (language, source), the kept terms it has above the share of the whole language. ``pair_reports`` sums the
differences of shares over all kept terms for every two sources of a language. The terms of a language are dealt into blocks of about
``BLOCK_TERMS``; a task holds one block as a matrix of sources by terms, absent terms included, and returns one partial sum for each pair.

Null texts, languages and sources count as ''. Repeated rows are documents of their own. A group whose texts have no
words takes part with zero counts. A language without kept terms has pairs of value 0 and no terms; one without a second source has no
pairs. An empty table gives no rows. Ties rank by the bytes of the item. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from formweave.llm import words as W
from formweave.llm.pointer_sort import pointers
from formweave.llm.tables import stored

MIN_DOCS = 30
ADDED = 5
UNIT = 1_000_000_000
TOP = 50
SLICE = 8 << 20
BLOCK_TERMS = 1024
LETTERS = W.byte_classes(word_ascii=bytes(range(ord("A"), ord("Z") + 1)) + bytes(range(ord("a"), ord("z") + 1)))
_COUNTS = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", StringType()),
                      StructField("count", LongType()), StructField("docs", LongType())])


def _slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term and group; a row without a term for each group."""
    group_of = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
    names, first, group = np.unique(code, return_index=True, return_inverse=True)
    yield _counted(group_of, first, pa.nulls(len(first), pa.string()), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64))
    for a, b, p in pointers(text, LETTERS, SLICE, lower=W._LOWER):
        order, heads = p.sorted()
        if not len(order):
            continue
        term = np.zeros(len(order), np.int64)
        term[heads] = 1
        term = np.cumsum(term) - 1
        doc = p.text[order]
        new_doc = np.ones(len(order), bool)  # within a run the documents come in order
        new_doc[1:] = (np.diff(term) != 0) | (np.diff(doc) != 0)
        key = term * len(names) + group[a + doc]
        rank = np.argsort(key, kind="stable")
        key = key[rank]
        at = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        counts, docs = np.diff(np.concatenate([at, [len(key)]])), np.add.reduceat(new_doc[rank].astype(np.int64), at)
        for x in range(0, len(at), 1 << 16):
            some = at[x : x + (1 << 16)]
            terms = p.words(order[heads[key[some] // len(names)]]).cast(pa.large_string()).cast(pa.string())
            yield _counted(group_of, first[key[some] % len(names)], terms, counts[x : x + (1 << 16)], docs[x : x + (1 << 16)])


def _counted(groups: pa.StructArray, at: np.ndarray, terms: pa.Array, counts: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    own = groups.take(pa.array(at))
    return pa.record_batch([own.field("lang"), own.field("source"), terms, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], names=_COUNTS.names)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs) for all groups and terms; each group also has one row whose term is null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _slice_counts(b.column(0), b.column(1), b.column(2))

    parts = rows.mapInArrow(run, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, n: Column, v: Column, added: int, unit: int) -> Column:
    """1 + floor(unit (count + added) / (n + added v)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(unit).cast("decimal(10,0)") * wide(count + F.lit(added))
    low = wide(n) + F.lit(added).cast("decimal(5,0)") * v.cast("decimal(13,0)")
    return F.call_function("div", top, low) + F.lit(1)


class Audit:
    """Counts of kept terms, stored; ``groups``: (lang, source, n, v); ``kept``: (lang, source, term, count, n, v, p, q)."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, added: int = ADDED, unit: int = UNIT):
        self.added, self.unit = added, unit
        counts = stored(term_counts(docs, text, lang, source), "term-counts")
        terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all_count"))
        terms = stored(terms.where(F.col("docs") >= min_docs).select("lang", "term", "all_count"), "kept-terms")
        langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_count").alias("all_n"))
        own = counts.where("term IS NOT NULL").select("lang", "source", "term", "count").join(terms, ["lang", "term"])
        own = stored(own, "kept-counts")
        sizes = own.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
        self.groups = stored(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_n", F.lit(0)).alias("all_n")), "groups")
        self.kept = own.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", "count", "v", _share(F.col("count"), F.col("n"), F.col("v"), added, unit).alias("p"),
            _share(F.col("all_count"), F.col("all_n"), F.col("v"), added, unit).alias("q"))

    def term_reports(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): terms above the share of their language, the ``top`` largest differences."""
        over = self.kept.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return _ranked(over).where(F.col("rank") <= top)

    def pair_reports(self, block_terms: int = BLOCK_TERMS) -> DataFrame:
        """(lang, source, item, value, rank): every other source of the language by the summed difference of shares."""
        blocks = F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1))
        absent = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.greatest("v", F.lit(1)), self.added, self.unit)).otherwise(F.lit(0).cast("long"))
        own = self.kept.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", F.col("term"), "p")
        all_ = self.groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), absent.alias("p"))
        parts = own.unionByName(all_).groupBy("lang", "block").applyInArrow(_pair_sums, "lang string, source string, item string, value long")
        half = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        return _ranked(both)


def _pair_sums(t: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of one block, for all pairs of its language's sources; the smaller source comes first."""
    none = pc.is_null(t["term"])
    groups, cells = t.filter(none), t.filter(pc.invert(none))
    names = groups["source"].to_pylist()
    place = {s: k for k, s in enumerate(names)}
    terms = cells["term"].combine_chunks().dictionary_encode() if cells.num_rows else None
    n = len(terms.dictionary) if terms is not None else 0
    p = np.repeat(groups["p"].to_numpy()[:, None], n, axis=1)
    if n:
        p[[place[s] for s in cells["source"].to_pylist()], terms.indices.to_numpy()] = cells["p"].to_numpy()
    left, right, value = [], [], []
    for i in range(len(names) - 1):
        left += [names[i]] * (len(names) - 1 - i)
        right += names[i + 1 :]
        value.append(np.abs(p[i + 1 :] - p[i]).sum(axis=1))
    lang = t["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()), "item": pa.array(right, pa.string()),
                     "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def _ranked(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.select("lang", "source", "item", "value", F.row_number().over(w).alias("rank"))
