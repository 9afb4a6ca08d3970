"""Equi joins whose large side may hold a third of its rows in one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

HEAVY_ROWS = 1_000_000


def heavy_keys(rows: DataFrame, key: str, limit: int = HEAVY_ROWS) -> DataFrame:
    """(``_heavy``, ``_cuts``): keys of more than ``limit`` rows, and into how many parts of about ``limit`` rows each is cut.

    The counts combine before the shuffle. There are at most rows / limit such keys; they are written as one file, so that
    the optimizer knows the size and broadcasts it where it is small.
    """
    n = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_heavy")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    n = n.select("_heavy", F.ceil(F.col("n") / limit).cast("int").alias("_cuts"))
    path = shared_dir(rows.sparkSession, "heavy")
    n.coalesce(1).write.parquet(path)
    return rows.sparkSession.read.schema(n.schema).parquet(path)


def split_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner", limit: int = HEAVY_ROWS) -> DataFrame:
    """``large.join(small, key, how)`` for ``inner``, ``left``, ``left_semi`` and ``left_anti``, without a task that holds a heavy key.

    The frequent keys of ``large`` are found first. Their rows are dealt into parts by a hash of the whole row (so that a task that
    is run again deals them alike; equal rows stay together), and the rows of ``small`` with such a key are repeated once per part. Other keys
    have one part. Nothing depends on what adaptive execution takes for skewed.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a join that keeps rows of the repeated side cannot be split: {how}")
    heavy = heavy_keys(large, key, limit)
    if heavy.isEmpty():
        return large.join(small, key, how)
    cuts = lambda df: df.join(heavy, df[key] == heavy["_heavy"], "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1))).drop("_heavy")
    dealt = cuts(large).withColumn("_part", F.pmod(F.xxhash64(*large.columns), F.col("_cuts")).cast("int")).drop("_cuts")
    repeated = cuts(small).select(*small.columns, F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_part"))
    return dealt.join(repeated, [key, "_part"], how).drop("_part")
