"""Context rules derived from tables: joins and aggregations instead of pre-computed flags.

Every function returns exception rows (doc_id or client key, code, value). Groups are reduced with
aggregates that combine before the shuffle; nothing collects a group, and no rule pairs rows of a group
with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from .joins import split_join
from .rules_context import box_drift, name_differs, wrong_entity


def _rows(df: DataFrame, code: str, *keep: str, value: Column | None = None) -> DataFrame:
    v = F.lit(None).cast("string") if value is None else value
    return df.select(*keep, F.lit(code).alias("code"), v.alias("value"))


# --- documents -----------------------------------------------------------------------------------------------
def duplicate_uploads(docs: DataFrame) -> DataFrame:
    """Documents whose content hash was seen before (doc_id, doc_hash, ts).

    The first document per hash is a combinable minimum. A hash shared by a third of all documents is one
    row on the other side of the join; its documents are cut into parts.
    """
    first = docs.groupBy("doc_hash").agg(F.min(F.struct("ts", "doc_id")).alias("f"), F.count("*").alias("n")).where("n > 1").select(
        "doc_hash", F.col("f.doc_id").alias("first_id"))
    return _rows(split_join(docs, first, "doc_hash").where("doc_id <> first_id"), "XDOC_DUPLICATE_UPLOAD", "doc_id", value=F.col("doc_hash"))


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Documents holding the same page hash twice; the value is the repeated hash of the earliest page."""
    per_hash = pages.groupBy("doc_id", "page_hash").agg(F.count("*").alias("n"), F.min("page").alias("first_page")).where("n > 1")
    d = per_hash.groupBy("doc_id").agg(F.min_by("page_hash", F.struct("first_page", "page_hash")).alias("h"))
    return _rows(d, "OCR_DUPLICATE_PAGE", "doc_id", value=F.col("h"))


def missing_pages(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """Expected pages (doc_id, page) that were not scanned."""
    gone = expected.join(scanned.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return _rows(gone, "OCR_CROPPED", "doc_id", value=F.col("page").cast("string"))


def tampered(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents whose hash differs from the registered one."""
    j = docs.join(registry, "doc_id").where((F.col("expected_hash") != "") & (F.col("doc_hash") != "") & (F.col("expected_hash") != F.col("doc_hash")))
    return _rows(j, "SEC_TAMPERED_DOC", "doc_id", value=F.col("doc_hash"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Primary key values that occur more than once."""
    return _rows(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "DB_DUPLICATE_PK", key, value=F.col(key).cast("string"))


def schema_drift(fields: DataFrame, template: DataFrame) -> DataFrame:
    """Keys of a document that its form's template does not know (template: form_type, key; small)."""
    extra = fields.select("doc_id", "form_type", F.col("field").alias("key")).join(template.select("form_type", "key").distinct(), ["form_type", "key"], "left_anti")
    return _rows(extra, "DB_SCHEMA_DRIFT", "doc_id", value=F.col("key"))


def not_null_violations(fields: DataFrame, not_null: DataFrame) -> DataFrame:
    bad = fields.where("kind = 'null'").join(not_null, ["form_type", "field"], "left_semi")
    return _rows(bad, "DB_NULL_NON_NULLABLE", "doc_id", value=F.col("field"))


def bbox_drift(boxes: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Fields found away from their expected place (doc_id, field, expected, actual as arrays)."""
    hit = boxes.where(box_drift(F.col("expected"), F.col("actual"), t))
    return _rows(hit, "LLM_CONTEXT_DRIFT", "doc_id", "field", value=F.array_join(F.col("actual").cast("array<string>"), ","))


def ungrounded_values(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Field values that appear nowhere among the words of their document (hallucination check)."""
    seen = words.select("doc_id", F.lower(F.col("word")).alias("v")).distinct()
    f = fields.where("s <> ''").withColumn("v", F.lower("s"))
    return _rows(f.join(seen, ["doc_id", "v"], "left_anti"), "LLM_HALLUCINATED", "doc_id", "field", value=F.col("s"))


# --- engagement and identity ----------------------------------------------------------------------------------
def unknown_clients(docs: DataFrame, clients: DataFrame) -> DataFrame:
    return _rows(docs.join(clients.select("client_id").distinct(), "client_id", "left_anti"), "ENG_UNKNOWN_CLIENT", "doc_id")


def merged_clients(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """Documents of clients that were merged into others; the value is the surviving client, none where the merges go in a circle."""
    hit = docs.join(survivors, "client_id")
    return _rows(hit, "ENG_CLIENT_MERGED", "doc_id", value=F.col("survivor").cast("string"))


def deleted_clients(docs: DataFrame, survivors: DataFrame, deleted: DataFrame) -> DataFrame:
    """Documents whose client, or the client that it was merged into, is deleted."""
    now = docs.join(survivors.select("client_id", "survivor"), "client_id", "left").select("doc_id", F.coalesce("survivor", "client_id").alias("client_id"))
    return _rows(now.join(deleted.select("client_id").distinct(), "client_id", "left_semi"), "ENG_CLIENT_DELETED", "doc_id")


def unknown_senders(mails: DataFrame, domains: DataFrame) -> DataFrame:
    d = mails.withColumn("domain", F.lower(F.regexp_extract("sender", "@([^@]+)$", 1)))
    return _rows(d.join(domains.select("domain").distinct(), "domain", "left_anti"), "EMAIL_UNKNOWN_SENDER", "doc_id", value=F.col("domain"))


def multi_client_mails(ssns: DataFrame) -> DataFrame:
    n = ssns.groupBy("mail_id").agg(F.countDistinct("ssn").alias("n")).where("n > 1")
    return _rows(n, "EMAIL_MULTI_CLIENT", "mail_id", value=F.col("n").cast("string"))


def duplicate_profiles(clients: DataFrame) -> DataFrame:
    """Identifiers (digits) used by more than one client."""
    d = clients.select("client_id", S.digits_only(F.col("tax_id")).alias("tin")).where("tin <> ''").distinct()
    n = d.groupBy("tin").agg(F.count("*").alias("n")).where("n > 1")
    return _rows(n, "ENG_DUPLICATE_PROFILE", "tin", value=F.col("n").cast("string"))


def wrong_years(docs: DataFrame, engagements: DataFrame) -> DataFrame:
    j = docs.join(engagements, "client_id").where("form_tax_year <> engagement_year")
    return _rows(j, "ENG_WRONG_YEAR", "doc_id", value=F.col("form_tax_year").cast("string"))


def wrong_entities(docs: DataFrame, clients: DataFrame) -> DataFrame:
    j = docs.join(clients.select("client_id", "client_entity_type"), "client_id")
    return _rows(j.where(wrong_entity(F.col("client_entity_type"), F.col("form_type"))), "ENG_WRONG_ENTITY", "doc_id", value=F.col("form_type"))


def name_tin_mismatches(docs: DataFrame, tins: DataFrame) -> DataFrame:
    """Employer names that disagree with the registered name of their identifier (tins: tin, known_name)."""
    j = split_join(docs, tins, "tin").where(name_differs(F.col("known_name"), F.col("employer_name")))
    return _rows(j, "ID_NAME_TIN_MISMATCH", "doc_id", value=F.col("tin"))


def cross_tenant(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Documents with an SSN owned by another tenant; one row per document."""
    # the two smallest tenants of an SSN are enough: one of them is not the document's own
    own = owners.where("tenant_id is not null").select("ssn", "tenant_id").distinct()
    first = own.groupBy("ssn").agg(F.min("tenant_id").alias("first"))
    second = own.join(first, "ssn").where("tenant_id <> first").groupBy("ssn").agg(F.min("tenant_id").alias("second"))
    j = docs.where("tenant_id is not null").join(first, "ssn").join(second, "ssn", "left")
    j = j.withColumn("owner", F.when(F.col("first") != F.col("tenant_id"), F.col("first")).otherwise(F.col("second"))).where("owner is not null")
    return _rows(j.groupBy("doc_id").agg(F.min("owner").alias("owner")), "MT_CROSS_TENANT_CLIENT", "doc_id", value=F.col("owner"))


def shared_households(logins: DataFrame) -> DataFrame:
    n = logins.groupBy("household").agg(F.countDistinct("login").alias("n")).where("n > 1")
    return _rows(n, "MT_SHARED_FAMILY", "household", value=F.col("n").cast("string"))


def new_tins(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Identifiers unknown to a client that has known ones (docs: doc_id, client_id, tin; known: client_id, tin)."""
    has_any = known.select("client_id").distinct()
    d = docs.where("tin <> ''").join(has_any, "client_id", "left_semi").join(known, ["client_id", "tin"], "left_anti")
    return _rows(d, "ID_NEW_EMPLOYER_TIN", "doc_id", value=F.col("tin"))


def dependents(docs: DataFrame, deps: DataFrame) -> DataFrame:
    """Documents under a dependent's SSN, plus the 1099 variant of the rule."""
    d = docs.join(deps.select("client_id", "ssn").distinct(), ["client_id", "ssn"], "left_semi")
    return _rows(d, "ID_DUPLICATE_DEP_SSN", "doc_id", value=F.col("ssn")).unionByName(
        _rows(d.where(F.col("form_type").startswith("1099")), "CTX_DEP_FORM", "doc_id", value=F.col("ssn")))


# --- form sets -----------------------------------------------------------------------------------------------------
def missing_recurring(forms: DataFrame) -> DataFrame:
    """Forms a client had the year before and lacks this year (forms: client_id, tax_year, form_type).

    Only for client-years that have any form, so an absent year raises nothing.
    """
    f = forms.select("client_id", "tax_year", "form_type").distinct()
    this_year = f.select("client_id", "tax_year").distinct()
    expected = f.withColumn("tax_year", F.col("tax_year") + 1).join(this_year, ["client_id", "tax_year"], "left_semi")
    return _rows(expected.join(f, ["client_id", "tax_year", "form_type"], "left_anti"), "XDOC_MISSING_RECURRING", "client_id", "tax_year", value=F.col("form_type"))


def partial_form_sets(expected: DataFrame, received: DataFrame, waived: DataFrame) -> DataFrame:
    """Expected forms neither received nor waived, one row per form."""
    key = ["client_id", "form_type"]
    d = expected.select(*key).distinct().join(received.select(*key).distinct(), key, "left_anti").join(waived.select(*key).distinct(), key, "left_anti")
    return _rows(d, "LED_PARTIAL_FORM_SET", "client_id", value=F.col("form_type"))


def waived_forms(docs: DataFrame, waived: DataFrame) -> DataFrame:
    return _rows(docs.join(waived, ["client_id", "form_type"], "left_semi"), "LED_CLIENT_WAIVED", "doc_id", value=F.col("form_type"))


def forms_outside_ledger(docs: DataFrame, ledger_forms: DataFrame) -> DataFrame:
    """Forms not listed for a client whose ledger lists any."""
    listed = ledger_forms.select("client_id").distinct()
    d = docs.join(listed, "client_id", "left_semi").join(ledger_forms, ["client_id", "form_type"], "left_anti")
    return _rows(d, "LED_FORM_NOT_IN_LEDGER", "doc_id", value=F.col("form_type"))


def repeated_forms(docs: DataFrame) -> DataFrame:
    n = docs.groupBy("client_id", "form_type").agg(F.count("*").alias("n")).where("n > 1")
    return _rows(n, "LED_MULTIPLE_SAME_FORM", "client_id", "form_type", value=F.col("n").cast("string"))


# --- amounts across documents ------------------------------------------------------------------------------------
def income_conflicts(amounts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """State against federal income per client (client_id, level 'state'/'federal', amount)."""
    a = S.money(F.col("amount"))
    s = amounts.groupBy("client_id").agg(F.sum(F.when(F.col("level") == "state", a)).alias("st"), F.sum(F.when(F.col("level") == "federal", a)).alias("fd"))
    st, fd = F.coalesce("st", F.lit(0)), F.coalesce("fd", F.lit(0))
    conflict = s.where((st != 0) & (fd != 0) & (F.abs(st - fd) > t.state_federal_gap))
    mismatch = s.where((st != 0) & (fd == 0))
    return _rows(conflict, "XDOC_CONFLICT_INCOME", "client_id").unionByName(_rows(mismatch, "XDOC_STATE_MISMATCH", "client_id"))


def carryovers(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior-year loss or estimated payments without a counterpart this year."""
    j = current.join(prior, "client_id")
    return _rows(j.where("prior_cap_loss > 0 and capital_loss_carryover is null"), "CTX_CAP_LOSS_MISSING", "doc_id").unionByName(
        _rows(j.where("prior_estimated > 0 and estimated_tax_payments is null"), "CY_CARRYOVER_MISSING", "doc_id"))


def estimates_not_filed(docs: DataFrame, forms: DataFrame) -> DataFrame:
    filed = forms.where("form_type = '1040'").select("client_id").distinct()
    return _rows(docs.where("estimated_tax_payments > 0").join(filed, "client_id", "left_anti"), "CY_EST_NOT_FILED", "doc_id")


# --- workflow, security ----------------------------------------------------------------------------------------------
def ledger_gaps(extractions: DataFrame, ledger: DataFrame) -> DataFrame:
    return _rows(extractions.join(ledger.select("doc_id").distinct(), "doc_id", "left_anti"), "WF_LEDGER_NOT_UPDATED", "doc_id")


def unlogged_overrides(overrides: DataFrame, audit: DataFrame) -> DataFrame:
    return _rows(overrides.join(audit.select("doc_id").distinct(), "doc_id", "left_anti"), "WF_MANUAL_NO_AUDIT", "doc_id")


def after_closed(docs: DataFrame, closings: DataFrame) -> DataFrame:
    """Documents received after their client's ledger was closed."""
    c = closings.groupBy("client_id").agg(F.min("closed_at").alias("closed_at"))
    return _rows(docs.join(c, "client_id").where("ts > closed_at"), "WF_AFTER_CLOSED", "doc_id")


def attempt_windows(attempts: DataFrame, size: str, slide: str | None = None, t: Thresholds = DEFAULTS, key: str = "doc_id") -> DataFrame:
    """Windows in which a document was tried more often than the limit."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    n = attempts.groupBy(key, w.alias("w")).agg(F.count("*").alias("attempts")).where(F.col("attempts") > t.attempt_limit)
    return n.select(key, F.col("w.start").alias("window_start"), F.lit("SEC_EXCESS_ATTEMPTS").alias("code"), "attempts")


PII_RE = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b|\b[0-9]{2}-[0-9]{7}\b"


def pii_in_logs(logs: DataFrame, text: str = "detail") -> DataFrame:
    """Log rows that hold an SSN or EIN, with the number of hits; map-only."""
    hits = F.regexp_count(F.col(text), F.lit(PII_RE))
    return logs.where(F.col(text).rlike(PII_RE)).select("log_id", F.lit("SEC_PII_IN_LOGS").alias("code"), hits.cast("long").alias("n_hits"))


def mask_pii(text: Column) -> Column:
    """Replace SSNs and EINs in free text, keeping the last four and seven characters."""
    return F.regexp_replace(F.regexp_replace(text, r"\b[0-9]{3}-[0-9]{2}-([0-9]{4})\b", "•••-••-$1"), r"\b[0-9]{2}-([0-9]{7})\b", "••-$1")


