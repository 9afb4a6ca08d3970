"""Shared helpers: reading tables, cutting lineage in the shared folder, running sums without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.session import shared_dir

RANGE_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder of the cluster and read again: lineage ends here."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add, per name in ``sums``, the sum over all earlier rows of the same keys (0 for the first row).

    Rows are dealt into ranges of (keys, order, a row number), which hold about as many rows each however many of them are equal. Windows run
    inside one range of a key, and over the totals of a key's ranges; so no task holds a key, a common value or a group of
    equal rows. Both steps read stored tables: the row numbers are fixed, and what follows is a small plan. Keys must not be null; rows that are
    equal in ``order`` come in any order.
    """
    cols = df.columns
    n = stored(df.withColumns({f"_v_{s}": c for s, c in sums.items()}), "running")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n.count() // RANGE_ROWS + 1)
    n = n.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, *order, "_row")
    n = stored(n.withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    past = lambda s, w: F.coalesce(F.sum(s).over(w), F.lit(0))
    totals = n.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
    totals = totals.select(*keys, "_range", *[past(f"_t_{s}", before(keys, ["_range"])).alias(f"_c_{s}") for s in sums])
    n = n.withColumns({f"_d_{s}": past(f"_v_{s}", before([*keys, "_range"], [*order, "_row"])) for s in sums}).join(totals, [*keys, "_range"])
    return n.select(*cols, *[(F.col(f"_c_{s}") + F.col(f"_d_{s}")).alias(s) for s in sums])
