"""Export records, snapshots and CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def record_id(doc_id: Column) -> Column:
    """Stable record identifier, equal on every run and retry."""
    return F.sha2(doc_id.cast("string"), 256)


def resolved_items(excs: Column) -> Column:
    return F.transform(excs, lambda e: F.struct(
        e["field"].alias("field"), e["code"].alias("rule"), F.coalesce(e["value"], S.plain_number_text(e["value_num"])).alias("original_value"),
        F.lit("unresolved").alias("resolution")))


def export_records(validated: DataFrame) -> DataFrame:
    """One export record per validated document."""
    items = resolved_items(F.col("exceptions"))
    return validated.select(
        "doc_id", record_id(F.col("doc_id")).alias("record_id"), "form_type", "confidence", "document_confidence", "needs_review",
        F.size("fields").cast("bigint").alias("fields_count"), F.size("exceptions").cast("bigint").alias("exceptions_count"),
        F.transform(F.slice("fields", 1, 20), lambda x: F.struct(x["field"].alias("field"), x["s"].alias("value"))).alias("sample_fields"),
        F.slice(items, 1, 10).alias("first_exceptions"), items.alias("exceptions_resolved"),
        F.to_json(F.map_from_entries(F.transform("fields", lambda x: F.struct(x["field"], x["s"])))).alias("csv_row"))


def csv_columns(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """Flat record as one column per field name."""
    m = F.map_from_entries(F.transform("fields", lambda x: F.struct(x["field"], x["s"])))
    return df.select(*keep, m.alias("_m")).select(*keep, *[F.col("_m")[n].alias(n) for n in names])


def snapshots(df: DataFrame) -> DataFrame:
    """Latest payload per storage key with its envelope.

    The key is the document id, else the file name without extension, else the session, else 'unknown'.
    The newest payload per key is a combinable maximum, so a shared key costs one row per task.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")

    def key(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", S.storage_key(c))

    d = df.withColumn("storage_key", F.coalesce(key(F.col("document_id")), key(stem), S.storage_key(F.col("session_id"))))
    meta = F.struct("document_id", "filename", "form_type", "session_id", "source", F.col("ts").alias("updated_at"), "storage_key",
                    S.storage_key(F.col("form_type")).alias("storage_form_key"))
    g = d.groupBy("storage_key").agg(F.max_by(F.struct(meta.alias("meta"), F.col("payload").alias("payload")), F.struct("ts", "seq")).alias("r"))
    return g.select("storage_key", "r.meta", "r.payload")


def safe_projection(sessions: DataFrame) -> DataFrame:
    """Session rows without raw text and document bytes."""
    return sessions.drop("raw_text", "document_bytes")


def submission(df: DataFrame) -> DataFrame:
    """Ledger submission from an extraction row: name from override, payload, context or file name."""
    name = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("name_override", "extracted_name", "ctx_client_name", "filename")])
    return df.select(
        name.alias("client_name"), F.coalesce(F.nullif("form_type", F.lit("")), F.lit("Unknown")).alias("document_type"),
        F.concat(F.lit("Auto-extracted: "), "filename").alias("description"), F.col("filename").alias("source"),
        F.coalesce(F.nullif(F.col("ctx_tax_year").try_cast("int"), F.lit(0)), F.year(F.current_date())).alias("tax_year"), "ts", "seq")
