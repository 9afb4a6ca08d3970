"""Writers. Every write is partitioned work by the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import csv_columns, snapshots


def write_snapshots(df: DataFrame, path: str) -> None:
    """Current snapshot per storage key as JSON lines."""
    snapshots(df).write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_csv(df: DataFrame, names: list[str], path: str, *keep: str) -> None:
    """Flat records as CSV with a header."""
    csv_columns(df, names, *keep).write.mode("overwrite").option("header", True).csv(path)


def append_log(log: DataFrame, path: str) -> None:
    """Append to the document log, laid out by tax year and form for partition pruning."""
    log.withColumn("form_type", F.col("document_type")).write.mode("append").partitionBy("tax_year", "form_type").parquet(path)


def write_validated(df: DataFrame, path: str) -> None:
    """Validated documents partitioned by form type; rows of one form may be split over many files."""
    df.write.mode("overwrite").partitionBy("form_type").parquet(path)
