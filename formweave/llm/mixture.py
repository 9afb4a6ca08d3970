"""Mixing sources to target weights by Pareto order sampling. Columns and SQL functions only.

A source's target is its share, by weight, of the words of all documents; a target stops at ``most`` times the source's words
and the excess is shared again by weight, until none is above. A source that must give r times its words takes floor(r) whole
copies of each document for certain. For the rest each document has the inclusion probability p = r - floor(r): it gets a
random number U from a hash of its id, its rank is the odds of U over the odds of p, and the documents of least rank are taken
until the words reach what is left (a document counts if half of it fits). So the sample has a fixed size in words. The last
place is settled by one document more or less: the one whose words come nearest to the difference, if that helps.

The running sums along the ranks are cut over many tasks, so one source may hold any part of the rows. Sources are ordered by
code point, null last, and take ``weights`` in turn. A document's size is its words; documents without words are taken with
no effect. Equal ids share U; equal rows are sampled as rows of their own. No randomness but the hash: reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm.tables import running, stored

WEIGHTS, MOST = (1, 2, 3), 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to one row per source (``none``, ``name``, ``source_size``)."""
    order = Window.orderBy("none", "name")  # one row per source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = Window.orderBy("full", "none", "name")
    rows = sizes.withColumn("w", w).withColumn("full", most * F.col("source_size") / F.col("w"))
    left = F.sum("source_size").over(Window.partitionBy()) - most * (F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))
    rows = rows.withColumn("level", left / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "none", "name", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("level", level)
    return rows.select("none", "name", "source_size", F.least(F.col("w") * F.col("level"), (most * F.col("source_size")).cast("double")).alias("target"))


def chance(doc_id: str) -> Column:
    """A number inside (0, 1) from the id: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per row: ``doc_id``, ``th`` (hash of the text), ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
                       F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
    rows = stored(rows, "sizes")
    plan = targets(rows.groupBy("none", "name").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # one row per source; stored in one file, so that its size is known and Spark broadcasts it where it is small
    plan = stored(plan.withColumn("sure", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio)).withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size")).coalesce(1), "plan")
    odds = lambda c: c / (1 - c)
    ranked = rows.join(plan, ["none", "name"]).withColumn("u", chance("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, odds(F.col("u")) / odds(F.col("p"))).otherwise(F.col("u")))
    ranked = running(ranked, ["none", "name"], ["rank", "doc_id", "size", "th"], {"before": F.col("size")})
    ranked = stored(ranked.withColumn("extra", (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))), "ranked")
    gap = ranked.groupBy("none", "name").agg((F.first("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("gap"))
    gap = stored(gap.coalesce(1), "gap")
    off = F.abs(F.col("size") - F.abs("gap"))
    # a row of size > 0 is the only one with its `before` in its source
    fit = ranked.where("size > 0").join(gap, ["none", "name"]).where(((F.col("gap") > 0) != F.col("extra")) & (off < F.abs("gap")) & (F.col("p") > 0))
    fit = fit.groupBy("none", "name").agg(F.min_by("before", F.struct(off, "rank", "before")).alias("turned"))
    out = ranked.join(stored(fit.coalesce(1), "fit"), ["none", "name"], "left")
    extra = F.col("extra") != F.coalesce((F.col("turned") == F.col("before")) & (F.col("size") > 0), F.lit(False))
    return out.select("doc_id", "th", "size", "source_size", "target", (F.col("sure") + extra.cast("long")).alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns unchanged."""
    taken = copies(docs, doc_id, text, source, weights, most).groupBy("doc_id", "th").agg(F.sum("copies").alias("__n"), F.count("*").alias("__k"))
    taken = stored(taken.where("__n > 0").withColumnRenamed("doc_id", "__id").withColumnRenamed("th", "__th"), "taken")
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    repeat = lambda df, cols: df.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i")).drop("__i")
    out = repeat(docs.join(taken.where("__k = 1"), on), [docs[c] for c in docs.columns])
    more = taken.where("__k > 1")
    if more.isEmpty():
        return out
    one = docs.join(more, on).select(*[docs[c] for c in docs.columns], "__id", "__th", "__n").dropDuplicates(["__id", "__th"])
    return out.union(repeat(one, docs.columns))
