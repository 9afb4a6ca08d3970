"""Field and document confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from .records import Layout, settle

# fixed values: score ladder
VERIFIED, ABSENT, FAILED, BLOCKED, CORRECTED = 1.0, 0.70, 0.20, 0.35, 0.82
CLEAN_DIGITAL, CLEAN_SCANNED, WARNED_DIGITAL, WARNED_SCANNED = 0.97, 0.91, 0.87, 0.81


def ladder(verified: Column | None, absent: Column, failed: Column | None, blocked: Column, corrected: Column | None, warned: Column,
           digital: Column) -> Column:
    """First matching step wins; a step that is None has no documents. The steps are two-decimal constants, so no rounding is needed."""
    steps = [(verified, VERIFIED), (absent, ABSENT), (failed, FAILED), (blocked, BLOCKED), (corrected, CORRECTED),
             (warned, F.when(digital, WARNED_DIGITAL).otherwise(WARNED_SCANNED))]
    out = F
    for cond, score in steps:
        out = out if cond is None else out.when(cond, score)
    return out.otherwise(F.when(digital, CLEAN_DIGITAL).otherwise(CLEAN_SCANNED))


def _fields_with(excs: Column, severity: str) -> Column:
    return F.transform(F.filter(excs, lambda e: e["severity"] == severity), lambda e: e["field"])


def _in(arr: Column, v: Column) -> Column:
    return F.coalesce(F.array_contains(arr, v), F.lit(False))


def _score_lists(excs: Column, pdf_type: Column, verified: Column | None, corrections: Column | None) -> dict[str, Column]:
    blocking, warning = _fields_with(excs, "BLOCKING"), _fields_with(excs, "WARNING")
    lists = {"blk": blocking, "wrn": warning, "digital": F.coalesce(pdf_type == "digital", F.lit(False))}
    if verified is not None:
        lists["hv"] = verified
    if corrections is not None:
        lists["cor"] = F.transform(F.filter(corrections, lambda c: c["status"] == "corrected"), lambda c: c["field"])
        lists["fail"] = F.transform(F.filter(corrections, lambda c: c["status"].isin("failed", "no_change")), lambda c: c["field"])
    return lists


def _score(field: Column, kind: Column, lists: Column, names: list[str]) -> Column:
    on = lambda name: _in(lists[name], field) if name in names else None
    return F.struct(field.alias("field"), ladder(on("hv"), kind == "null", on("fail"), on("blk"), on("cor"), on("wrn"), lists["digital"]).alias("score"))


def field_scores(fields: Column, excs: Column, pdf_type: Column, verified: Column | None,
                 corrections: Column | None = None) -> Column:
    """array<struct<field,score>>; ``verified`` is array<string> or absent, ``corrections`` array<struct<field,status>> or absent."""
    lists = _score_lists(excs, pdf_type, verified, corrections)
    facts = F.struct(*[c.alias(n) for n, c in lists.items()])
    return S.let(facts, lambda k: F.transform(fields, lambda x: _score(x["field"], x["kind"], k, list(lists))))


def laid_out_scores(df: DataFrame, layout: Layout, pdf_type: Column, verified: Column | None, corrections: Column | None = None) -> DataFrame:
    """Add ``field_scores``, written out over a layout, to rows holding fields and exceptions."""
    lists = _score_lists(F.col("exceptions"), pdf_type, verified, corrections)
    df = settle(df, _lists=F.struct(*[c.alias(n) for n, c in lists.items()]))
    scores = [_score(F.lit(n), F.get("fields", F.lit(i))["kind"], F.col("_lists"), list(lists)) for i, n in enumerate(layout)]
    return settle(df, field_scores=F.array(*scores)).drop("_lists")


def mean_score(cents: Column, n: Column) -> Column:
    return F.coalesce(S.round3(cents / (n * 100)), F.lit(0.0))


def document_score(scores: Column, t: Thresholds = DEFAULTS, layout: Layout | None = None) -> list[Column]:
    """document_confidence, needs_review and review_fields from the nested scores.

    Scores are summed as whole hundredths, so the mean does not depend on the order of the fields.
    """
    hundredths = lambda x: F.rint(x["score"] * 100).cast("bigint")
    if layout:
        cents = sum((hundredths(F.get(scores, F.lit(i))) for i in range(len(layout))), F.lit(0).cast("bigint"))
    else:
        cents = F.aggregate(scores, F.lit(0).cast("bigint"), lambda acc, x: acc + hundredths(x))
    confidence = mean_score(cents, F.nullif(F.size(scores), F.lit(0)))
    low = F.transform(F.filter(scores, lambda x: x["score"] < t.review_field_score), lambda x: x["field"])
    return [
        confidence.alias("document_confidence"),
        ((confidence < t.review_document_score) | (F.size(low) > 0)).alias("needs_review"),
        low.alias("review_fields"),
    ]


def long_field_scores(fields: DataFrame, excs: DataFrame, verified: DataFrame, corrections: DataFrame,
                      pdf_type: Column) -> DataFrame:
    """Scores from long tables: one pre-aggregated join per fact, all keyed by (doc_id, field).

    ``verified`` holds (doc_id, field); ``corrections`` holds (doc_id, field, status).
    """
    worst = excs.where(F.col("field").isNotNull()).groupBy("doc_id", "field").agg(
        F.max((F.col("severity") == "BLOCKING").cast("int")).alias("blk"),
        F.max((F.col("severity") == "WARNING").cast("int")).alias("wrn"))
    fixed = corrections.groupBy("doc_id", "field").agg(
        F.max((F.col("status") == "corrected").cast("int")).alias("cor"),
        F.max(F.col("status").isin("failed", "no_change").cast("int")).alias("fail"))
    hv = verified.select("doc_id", "field").distinct().withColumn("hv", F.lit(1))
    j = fields.join(worst, ["doc_id", "field"], "left").join(fixed, ["doc_id", "field"], "left").join(
        hv, ["doc_id", "field"], "left")

    def on(c: str) -> Column:
        return F.coalesce(F.col(c) == 1, F.lit(False))

    return j.select(
        "doc_id", "field",
        ladder(on("hv"), F.col("kind") == "null", on("fail"), on("blk"), on("cor"), on("wrn"), pdf_type == "digital").alias("score"))
