"""Document fingerprints: SimHash, and the numbers of fingerprints within a Hamming radius.

The terms of a text are its pairs of neighbouring words (A-Z lower-cased; a text of one word has that word). A term that
occurs c times has the weight 1 + ln c; its 128 hash bits vote with this weight, and a bit is set where the votes for 1 lead.
Texts with equal terms have equal fingerprints. Null, empty and blank texts have no terms: all bits are 0.

``with_neighbours`` counts the rows within ``RADIUS`` bits by block tables: the bits are permuted into tables by ``BLOCKS`` blocks, one table per
block, each with its block as the key. Block k has a reach r_k, and the sum of all r_k + 1 is the radius plus one, so two fingerprints
within the radius differ in at most r_k bits in some block k. A fingerprint that is asked for is sought in each table under all values
within the reach of its own block; what meets there is compared in full, and a pair counts in the first table only where it meets. Keys that
many fingerprints share (large groups of near copies) are cut into parts. Equal fingerprints are one row with a count. At a radius of
20 over 9 blocks a fingerprint is compared with about 2.5 % of all others; that is still a share of the rows, so a much larger corpus wants
fewer, wider blocks (argument), with more values per search. ids may be of any type here; ``with_next`` needs numbers.

``near`` lists the pairs themselves, for radii of a few bits: the bits are cut into ``blocks`` blocks. Two fingerprints within
radius r agree in at least blocks - r of them, so each choice of blocks - r blocks is a table with these blocks as the key, and
every neighbour shares a key in some table. Both are exact; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm import words as W
from formweave.llm.tables import stored

BITS, RADIUS, BLOCKS = 128, 20, 9
PART = 1 << 15  # fingerprints of one key that one task holds
_VOTE = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)
_SLICE, _ROWS = 1 << 19, 512  # votes take 32 KB a text


def fingerprints(text: pa.Array) -> np.ndarray:
    """One row of 16 bytes per text."""
    out = [np.zeros((0, BITS // 8), np.uint8)]
    for a, b, w in W.words(text, lower=True, size=_SLICE, rows=_ROWS):
        h, at = w.windows(2)
        alone = np.flatnonzero(w.count() == 1)
        of = np.concatenate([w.text_of()[at], alone])
        h = np.concatenate([h, w.hash[w.first[alone]]])
        key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        weight = 1 + np.log(np.diff(np.append(first, len(key)))) if len(first) else np.empty(0)
        key = key[first]
        of, term = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
        code = np.stack([W.mix(term, 41), W.mix(term, 42)], axis=1).view(np.uint8).reshape(-1, BITS // 8)
        # how much weight each value of each of the 16 bytes got, then the votes of that value for its 8 bits
        spot = (of[:, None] * (BITS // 8) + np.arange(BITS // 8)[None, :]) * 256 + code
        held = np.bincount(spot.ravel(), np.repeat(weight, BITS // 8), (b - a) * (BITS // 8) * 256).reshape(-1, 256)
        out.append(np.packbits(held @ _VOTE > 1e-9, axis=1).reshape(b - a, BITS // 8))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _columns(prints: np.ndarray) -> list[pa.Array]:
    words = np.ascontiguousarray(prints).view(">i8")
    return [pa.array([x.tobytes().hex() for x in prints], pa.string()), pa.array(words[:, 0].astype(np.int64)), pa.array(words[:, 1].astype(np.int64))]


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (hex), ``hi``, ``lo`` (its halves)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), *_columns(fingerprints(batch.column(1)))], names=["doc_id", "fingerprint", "hi", "lo"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string, hi long, lo long")


def near(queries: DataFrame, prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """All pairs (``fingerprint`` of ``queries``, ``other`` of ``prints``) within the radius, each once, with their ``distance``.

    Both need ``fingerprint``, ``hi`` and ``lo``; equal fingerprints count once on either side and pair with each other.
    """
    if not 0 <= radius < blocks:
        raise ValueError("blocks must outnumber the radius")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    one = lambda t, m: F.struct(F.lit(t).alias("t"), F.col("hi").bitwiseAND(F.lit(signed(m >> 64))).alias("x"), F.col("lo").bitwiseAND(F.lit(signed(m & (1 << 64) - 1))).alias("y"))
    tables = F.inline(F.array(*[one(t, m) for t, m in enumerate(masks)]))
    left = queries.select("fingerprint", "hi", "lo").distinct().select("*", tables)
    right = prints.select(F.col("fingerprint").alias("other"), "hi", "lo").distinct().select("*", tables).withColumnRenamed("hi", "ohi").withColumnRenamed("lo", "olo")
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("ohi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("olo")))
    return left.join(right, ["t", "x", "y"]).select("fingerprint", "other", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null is empty), ``next_text``: that of the next row by id, then hash of the text; null ids last,
    and the first row follows the last. One shuffle, by ranges of the id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    edges = [float("-inf"), *sorted({float(x) for x in cuts}), float("inf")]
    if len(edges) > 2:
        put = Bucketizer(splits=edges, inputCol="_x", outputCol="bucket", handleInvalid="keep")
        rows = put.transform(rows.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))).drop("_x")
    else:
        rows = rows.withColumn("bucket", F.lit(0.0))
    order = [F.col("doc_id").asc_nulls_last(), F.col("th")]
    heads = rows.groupBy("bucket").agg(F.min_by("text", F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("head"))
    names = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # one number per range
    if names:
        turn = docs.sparkSession.createDataFrame([(b, names[k - 1]) for k, b in enumerate(names)], "bucket double, previous double")
        heads = heads.join(turn, "bucket").select(F.col("previous").alias("bucket"), "head")
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumn("following", F.lead("text").over(w))
    return rows.join(heads, "bucket", "left").select("doc_id", "text", F.coalesce("following", "head").alias("next_text"))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the beginning of the next text."""
    rows = with_next(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = W.buffers(batch.column(1))
            for a, b in W.slices(off, _SLICE, _ROWS):
                own, nxt = batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)
                texts = own.to_pylist()
                edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nxt.to_pylist(), strict=True)]
                mine, other, then = fingerprints(own), fingerprints(pa.array(edited, pa.string())), fingerprints(nxt)
                text_print, hi, lo = _columns(mine)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), text_print,
                                       _columns(other)[0], pa.array(likeness(mine, other)), pa.array(likeness(mine, then)), hi, lo],
                                      names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long")


def _block(hi: Column, lo: Column, a: int, b: int) -> Column:
    """Bits a to b (from the highest) of a fingerprint as an int."""
    ones = F.lit((1 << (b - a)) - 1)
    if b <= 64:
        return F.shiftrightunsigned(hi, 64 - b).bitwiseAND(ones).cast("int")
    if a >= 64:
        return F.shiftrightunsigned(lo, 128 - b).bitwiseAND(ones).cast("int")
    return F.shiftleft(hi.bitwiseAND(F.lit((1 << (64 - a)) - 1)), b - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - b)).cast("int")


def block_reach(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, end, reach) of each block: together the reaches leave no pair within the radius unmet. Blocks that are not needed are left out."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    each, more = divmod(radius + 1, blocks)
    return [(edge[k], edge[k + 1], each - 1 + (k < more)) for k in range(blocks) if each + (k < more) > 0]


def with_neighbours(prints: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Add ``n_within``: for the rows that ``asked`` names, how many other rows lie within the radius; null elsewhere.

    ``prints`` has ``hi`` and ``lo``. The key of a row is its table and block value. How many rows a key has is a table of at most the
    possible block values; those of more than ``part`` are dealt by hash into parts, and searches are repeated once per part.
    """
    prints = stored(prints, "fingerprints")
    every = prints.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    wanted = prints.where(asked).select("hi", "lo").distinct()
    tables = block_reach(radius, blocks)
    own = lambda k: _block(F.col("hi"), F.col("lo"), *tables[k][:2])
    key = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = every.select("hi", "lo", "n", F.inline(F.array(*[key(k, own(k)) for k in range(len(tables))])))
    flips = [[sum(1 << i for i in chosen) for r in range(reach + 1) for chosen in combinations(range(b - a), r)] for a, b, reach in tables]
    spread = lambda v, masks: F.transform(F.lit(masks), lambda m: v.bitwiseXOR(m))
    values = [F.struct(F.lit(k).alias("k"), spread(own(k), masks).alias("vs")) for k, masks in enumerate(flips)]
    probes = wanted.select("hi", "lo", F.inline(F.array(*values))).select(F.col("hi").alias("qhi"), F.col("lo").alias("qlo"), "k", F.explode("vs").alias("v"))
    crowded = rows.groupBy("k", "v").agg(F.count("*").alias("c")).where(F.col("c") > part).select("k", "v", F.ceil(F.col("c") / part).cast("int").alias("parts"))
    crowded = stored(crowded.coalesce(1), "crowded")
    if crowded.isEmpty():
        rows, probes = rows.withColumn("p", F.lit(0)), probes.withColumn("p", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        rows = rows.join(crowded, ["k", "v"], "left").withColumn("p", F.pmod(F.xxhash64("hi", "lo"), parts).cast("int")).drop("parts")
        probes = probes.join(crowded, ["k", "v"], "left").withColumn("p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    differ = (F.col("hi").bitwiseXOR(F.col("qhi")), F.col("lo").bitwiseXOR(F.col("qlo")))
    first = F.coalesce(*[F.when(F.bit_count(_block(*differ, a, b)) <= reach, F.lit(k)) for k, (a, b, reach) in enumerate(tables)])
    # merged: the size that Spark expects of the searches leaves out how many values each is sought under, so it might broadcast them
    met = rows.join(probes.hint("merge"), ["k", "v", "p"]).where(F.bit_count(differ[0]) + F.bit_count(differ[1]) <= radius).where(first == F.col("k"))
    # stored, so that the join stands apart from the sum and Spark can split a fingerprint that many rows have
    found = met.groupBy(F.col("qhi").alias("hi"), F.col("qlo").alias("lo")).agg((F.sum("n") - 1).alias("_n"))
    return prints.join(stored(found, "within"), ["hi", "lo"], "left").withColumn("n_within", F.when(asked, F.col("_n"))).select(*prints.columns, "n_within")
