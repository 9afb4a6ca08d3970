"""The validate -> classify -> score chain as one narrow projection per document row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from ..operators import classify as C
from ..operators import exceptions as X
from ..operators import flags as FL
from ..operators import rules_context as ctxr
from ..operators import score as SC
from ..operators.flatten import flatten_payload
from ..operators.fixes import apply_to_records, patch_payload
from ..operators.json_tokens import is_valid
from ..operators.records import Layout, Record, field_map, from_columns, settle
from ..operators.rules_forms import form_exceptions, single_form_rules
from ..operators.rules_universal import laid_out_rules, universal_exceptions


def with_exceptions(docs: DataFrame, t: Thresholds = DEFAULTS, forms: list[str] | None = None,
                    universal: bool = True, context: bool | None = None, layout: Layout | None = None) -> DataFrame:
    """Add ``exceptions`` to rows holding form_type and fields (optionally ctx, hv).

    The field map only lives inside the projection that picks the fields which the rules read by name. Where all documents share a
    layout, the rules are written out over it.
    """
    has_ctx = "ctx" in docs.columns if context is None else context
    d = settle(docs, fields=F.col("fields"))
    fields, form = F.col("fields"), F.col("form_type")
    record = Record(field_map(fields) if layout is None else fields, slots=True, layout=layout)
    image_only = ctxr.image_only(F.col("ctx")) if has_ctx else None
    parts = []
    if universal:
        parts.append(universal_exceptions(fields, t) if layout is None else X.concat([X.empty(), *laid_out_rules(record, t)]))
    parts.append(form_exceptions(form, fields, record, t, image_only, forms))
    if has_ctx:
        parts.append(ctxr.context_exceptions(F.col("ctx"), form, fields, record, t))
    elif universal:
        parts.append(ctxr.type_conflicts(fields) if layout is None else X.concat([X.empty(), *ctxr.laid_out_conflicts(record)]))
    excs = F.concat(*parts) if len(parts) > 1 else parts[0]
    if universal:
        empty = F.array(X.exc("FLD_ZERO_VS_BLANK"))
        if "flatten_failed" in docs.columns:
            empty = F.when(F.col("flatten_failed"), F.array(X.exc("DB_JSON_FLATTEN_FAIL"))).otherwise(empty)
        excs = F.when(F.size(fields) > 0, excs).otherwise(empty)
    d = settle(record.settled(d), exceptions=excs).drop("_slots", "_facts")
    if "hv" in docs.columns:
        d = settle(d, exceptions=X.suppress_verified(F.col("exceptions"), F.col("hv")))
    return d


def with_classified(docs: DataFrame, t: Thresholds = DEFAULTS, forms: list[str] | None = None, layout: Layout | None = None) -> DataFrame:
    """Exceptions and their fixable/review split, for readers that take no scores."""
    d = with_exceptions(docs, t, forms, layout=layout)
    return settle(d, classified=C.classify(F.col("exceptions"), F.col("fields"), t, layout))


def validate(docs: DataFrame, t: Thresholds = DEFAULTS, forms: list[str] | None = None, layout: Layout | None = None, split: bool = True) -> DataFrame:
    """Exceptions, fixable/review split, and scores. Input columns: doc_id, form_type, fields [, pdf_type, hv, ctx].

    Readers that take neither ``classified`` nor its counts leave out the ``split``; settled columns are worked out whether read or not.
    """
    d = with_classified(docs, t, forms, layout) if split else with_exceptions(docs, t, forms, layout=layout)
    hv = F.col("hv") if "hv" in docs.columns else None
    pdf = F.col("pdf_type") if "pdf_type" in docs.columns else F.lit("digital")
    corr = F.col("corrections") if "corrections" in docs.columns else None
    if layout is None:
        d = settle(d, field_scores=SC.field_scores(F.col("fields"), F.col("exceptions"), pdf, hv, corr))
    else:
        d = SC.laid_out_scores(d, layout, pdf, hv, corr)
    d = d.select("*", *SC.document_score(F.col("field_scores"), t, layout))
    e = F.col("exceptions")
    return d.select(
        *d.columns, X.triage(e).alias("confidence"),
        F.size(e).cast("bigint").alias("n_total"),
        *[X.count_severity(e, s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "BLOCKING", "WARNING", "INFO")],
        *[F.size(C.in_bucket(F.col("classified"), b)).cast("bigint").alias(f"n_{b}") for b in ("fixable", "review") if split],
    )


_VERDICTS = ["confidence", "n_total", "n_critical", "n_blocking", "n_warning", "n_info", "n_fixable", "n_review", "document_confidence", "needs_review"]


def _flags(df: DataFrame, columns: list[tuple], forms: list[str], t: Thresholds) -> FL.Flags | None:
    """The rules over typed columns as flags; None where they take a context, corrections or rules of users, or where fields may be left out."""
    if any(kind == "optional" for _, kind, *_ in columns):
        return None
    r = Record(None, columns=columns)
    by_form = single_form_rules(F.col("form_type"), r, t, forms)
    if by_form is None or {"ctx", "corrections", "flatten_failed"} & set(df.columns):
        return None
    hv = F.col("hv") if "hv" in df.columns else None
    pdf = F.col("pdf_type") if "pdf_type" in df.columns else F.lit("digital")
    return FL.Flags(r, [*laid_out_rules(r, t), *by_form, *ctxr.laid_out_conflicts(r)], hv, pdf, t)


def _as_documents(df: DataFrame, columns: list[tuple]) -> tuple[DataFrame, Layout | None]:
    layout = {name: kind for name, kind, *_ in columns}
    own = [c for c in df.columns if c in ("doc_id", "form_type", "pdf_type", "hv", "ctx", "corrections", "flatten_failed")]
    return df.select(*own, from_columns(columns).alias("fields")), None if "optional" in layout.values() else layout


def verdicts(df: DataFrame, columns: list[tuple], forms: list[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id and form_type with the counts, split sizes and scores of ``validate``, for readers that take no arrays.

    Documents are rows of typed columns, listed as for ``from_columns``; beside them form_type, doc_id [, pdf_type, hv, ...] as for ``validate``.
    """
    keep, flags = ["doc_id", "form_type"], _flags(df, columns, forms, t)
    if flags is None:
        docs, layout = _as_documents(df, columns)
        return validate(docs, t, forms, layout).select(*keep, *_VERDICTS)
    return FL.verdicts(df, flags, keep, t)


def review_hints(df: DataFrame, columns: list[tuple], forms: list[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Review items per code and hint text (code, edit_hint, n) over all documents, which are given as for ``verdicts``."""
    flags = _flags(df, columns, forms, t)
    if flags is not None:
        return FL.review_hints(df, flags)
    docs, layout = _as_documents(df, columns)
    c = with_classified(docs, t, forms, layout).select(F.explode(C.in_bucket(F.col("classified"), "review")).alias("c"))
    return c.groupBy(F.col("c.code").alias("code"), F.col("c.edit_hint").alias("edit_hint")).agg(F.count("*").alias("n"))


def validate_payloads(df: DataFrame, t: Thresholds = DEFAULTS, **flatten_options) -> DataFrame:
    """Flatten JSON payloads, then run the chain. A payload that is no JSON fails its own document only."""
    flat = flatten_payload(df, **flatten_options)
    text = F.col(flatten_options.get("payload", "payload"))
    failed = (F.size("fields") == 0) & (F.coalesce(S.strip(text), F.lit("")) != "") & ~is_valid(text)
    return validate(flat.withColumn("flatten_failed", failed), t).drop("flatten_failed")


def revalidate_with_fixes(docs: DataFrame, fixes: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Patch the documents that have fixes and run the chain on those only.

    Documents with a ``payload`` are patched in their nested payload, which comes back with the result; flat records are patched as they are.
    """
    if "payload" in docs.columns:
        patched = patch_payload(docs, fixes, only_touched=True)
        return validate_payloads(patched.drop("fields"), t)
    return validate(apply_to_records(docs, fixes, only_touched=True), t)


def response(validated: DataFrame) -> DataFrame:
    """The caller-facing columns of a validated document."""
    v = F.col("classified")
    summary = F.struct(
        F.col("n_total").alias("total"), F.col("n_critical").alias("critical"), F.col("n_blocking").alias("blocking"),
        F.col("n_warning").alias("warning"), F.col("n_info").alias("info"))
    have = set(validated.columns)
    pdf = F.col("pdf_type") if "pdf_type" in have else F.lit("digital").alias("pdf_type")
    hv = F.col("hv") if "hv" in have else F.array().cast("array<string>")
    data = F.col("payload") if "payload" in have else F.to_json(F.map_from_entries(
        F.transform("fields", lambda x: F.struct(x["field"], x["s"]))))
    return validated.select(
        "doc_id", "form_type", pdf, "confidence", X.error_list(F.col("exceptions")).alias("errors"), "exceptions",
        summary.alias("summary"), C.in_bucket(v, "fixable").alias("fixable_exceptions"),
        C.in_bucket(v, "review").alias("review_exceptions"), data.alias("data"),
        F.map_from_entries("field_scores").alias("field_confidence"), "document_confidence", "needs_review",
        "review_fields", hv.alias("human_verified_fields"))
