"""License scan by canonical digests. Columns and SQL functions only.

Canonical form of a text: lower case; lines that only state a copyright ("Copyright (c) 2020 Name", "© Name", "All rights
reserved") are dropped; whatever is neither letter nor digit is one blank; equivalent spellings are written one way. The SHA-256
of this form is the digest. The digest of the entire text, and that of every whole line of it, is joined by hash with the
digests of the known licences. There are no partial matches, so a licence quoted inside a sentence is not one.

Null and empty texts have the digest of the empty text, which is never known. Equal rows are looked up one by one. An empty
catalogue matches nothing. Catalogue rows without a text are ignored; of licences with equal digests the first name counts.
The catalogue is joined without a hint: Spark broadcasts it where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.license_texts import SPELLINGS, known

COPYRIGHT = r"(^|\n)[^\n\p{L}\p{N}]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|©|\(c\)[ \t]*[0-9]{4})[^\n]*"
RESERVED = r"(^|\n)[^\n\p{L}\p{N}]*all rights reserved[^\n\p{L}\p{N}]*(\n|$)"


def lines(text: Column) -> Column:
    """The canonical lines of a text that are not empty, in order."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "$1")
    t = F.regexp_replace(t, RESERVED, "$1$2")
    t = F.concat(F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, " "), 256)


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def digests(catalog: DataFrame, license: str = "license", text: str = "text") -> DataFrame:
    """``digest``, ``license`` of the known licences."""
    rows = catalog.select(F.col(license).alias("license"), lines(F.col(text)).alias("l")).where(F.size("l") > 0)
    return rows.groupBy(digest(F.col("l")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, catalog: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``digest`` of the entire text, ``license`` (of the entire text, or null), ``line_licenses`` (sorted)."""
    codes = digests(catalog)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("_key"), lines(F.col(text)).alias("_l"))
    rows = rows.select("doc_id", "_key", digest(F.col("_l")).alias("digest"), F.array_distinct(F.transform("_l", lambda x: F.sha2(x, 256))).alias("_lines"))
    found = rows.select("_key", F.explode("_lines").alias("digest")).join(codes, "digest").groupBy("_key").agg(F.sort_array(F.collect_set("license")).alias("line_licenses"))
    out = rows.drop("_lines").join(codes, "digest", "left").join(found, "_key", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))
