"""Readers of the domain tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_uploads(spark: SparkSession, path: str, hash_content: bool = True) -> DataFrame:
    """Uploaded files with an accepted extension, their size, hash and whether a PDF starts like one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = extension(F.col("path"))
    out = files.where(ext.isin(V.UPLOAD_EXTENSIONS)).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), ext.alias("ext"), "length",
        F.col("modificationTime").alias("received_at"), "content")
    if hash_content:
        starts = F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF")
        out = out.withColumn("doc_hash", F.sha2("content", 256)).withColumn(
            "is_corrupted", (F.col("ext") == ".pdf") & ~F.coalesce(starts, F.lit(False)))
    return out


def read_extractions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Extraction payloads as raw JSON text with their file name; parsing is left to the flatten step."""
    return spark.read.option("wholetext", multi_line).text(path).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("payload"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None,
              partitions: int = 8, **options: str) -> DataFrame:
    """JDBC table, split on a numeric key when bounds are given so that one task never reads it all."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        r = (r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
             .option("numPartitions", partitions))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def word_boxes_from_polygons(df: DataFrame, points: str = "points") -> DataFrame:
    """Box of each detected word from its polygon points; blank words are dropped."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return df.where(F.trim("text") != "").select(
        *[c for c in df.columns if c not in (points, "text")], F.trim("text").alias("text"),
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def word_boxes_digital(df: DataFrame) -> DataFrame:
    """Word boxes with coordinates kept to one decimal."""
    nums = ["x0", "y0", "x1", "y1", "page_width", "page_height"]
    return df.where(F.trim("text") != "").withColumns(
        {c: F.round(F.col(c).cast("decimal(18,6)"), 1).cast("double") for c in nums if c in df.columns})


def seed_dimension(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed rows not present yet by (enum_type, code); running it twice adds nothing."""
    return seed.dropDuplicates(["enum_type", "code"]).join(existing.select("enum_type", "code"), ["enum_type", "code"], "left_anti")
