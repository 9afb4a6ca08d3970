"""Context rules over an optional struct column of pre-computed facts.

A section that is null raises nothing. The same facts derived from tables instead of a struct are in
``rules_tables``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from .exceptions import Raised, concat, empty, exc, raised, raised_each
from .records import Record, has_numeric_name

CONTEXT_TYPE = (
    "struct<pdf_type:string,document:struct<has_text_layer:boolean>,"
    "ocr:struct<is_cropped:boolean,is_rotated:boolean,is_corrupted:boolean,multi_form_detected:boolean,"
    "image_only:boolean,is_scanned:boolean,no_text_layer:boolean,confidence:double,"
    "field_confidence:map<string,double>,page_hashes:array<string>>,"
    "email:struct<sender_registered:boolean,is_cpa_forward:boolean,has_metadata:boolean,is_encrypted:boolean,"
    "sender_domain:string,spoofing_risk_score:double,client_ssns_found:array<string>>,"
    "engagement:struct<client_found:boolean,client_deleted:boolean,duplicate_profile_detected:boolean,"
    "client_active:boolean,client_merged:boolean,engagement_year:int,form_tax_year:int,"
    "client_entity_type:string,merged_alias:string,known_tin_name_map:map<string,string>>,"
    "tenant:struct<current_tenant_id:string,ssn_tenant_map:map<string,string>,target_s3_bucket:string,"
    "detected_s3_bucket:string,shared_family_account:boolean>,"
    "workflow:struct<client_waived_forms:array<string>,ledger_status:string,is_reupload:boolean,"
    "prior_version_exists:boolean,ledger_updated:boolean,manual_override:boolean,audit_trail_present:boolean,"
    "forms_in_ledger:array<string>,form_instance_count:map<string,int>>,"
    "session:struct<processed_hashes:array<string>,dependent_ssns:array<string>,prior_year_forms:array<string>,"
    "current_year_forms:array<string>,known_tins:array<string>,state_income_reported:double,"
    "federal_income_reported:double,prior_year_cap_loss:double,prior_year_estimated_payments:double>,"
    "security:struct<pii_in_logs_detected:boolean,unauthorized_role:boolean,s3_public_access:boolean,"
    "document_hash_expected:string,document_hash_actual:string,extraction_attempt_count:int>,"
    "llm:struct<context_client_id:string,extracted_client_id:string,context_window_tokens:int,"
    "extraction_page:int,expected_page:int,"
    "field_bounding_boxes:map<string,struct<expected:array<double>,actual:array<double>>>,"
    "multi_form_page_assignment:map<string,string>,hallucinated_fields:array<string>,"
    "blank_as_missing_fields:array<string>,reordered_fields:array<string>,over_inferred_fields:array<string>>,"
    "db:struct<json_flatten_failed:boolean,duplicate_pk:boolean,schema_drift_detected:boolean,"
    "null_non_nullable_fields:array<string>,pk_value:string,schema_version:string>,"
    "schema:struct<missing_pages:array<string>,variant_validated:boolean,layout_year:int,"
    "conditional_skipped_fields:array<string>,deprecated_fields_present:array<string>,"
    "intentionally_blank_fields:array<string>>>"
)

_WORDS = r"\b(" + "|".join(V.NUMBER_WORDS) + r")\b"


def _on(section: Column, rules: list) -> Column:
    return F.when(section.isNotNull(), concat(rules)).otherwise(empty())


def _has(arr: Column, v: Column) -> Column:
    return F.coalesce(F.array_contains(arr, v), F.lit(False))


def _filled(arr: Column) -> Column:
    return F.coalesce(F.size(arr) > 0, F.lit(False))


def _set(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _as_text(arr: Column) -> Column:
    return F.array_join(arr, ",")


def image_only(ctx: Column) -> Column:
    """A scanned source: by type, by OCR mark, or because there is no text layer."""
    o = ctx["ocr"]
    return (
        _set(F.lower(S.strip(ctx["pdf_type"])) == "scanned") | _set(o["image_only"]) | _set(o["is_scanned"])
        | _set(o["no_text_layer"]) | _set(~ctx["document"]["has_text_layer"])
    )


def ocr(c: Column, t: Thresholds) -> Column:
    low = F.map_entries(F.map_filter(c["field_confidence"], lambda _, v: v < t.field_confidence))
    hashes = c["page_hashes"]
    repeated = F.filter(hashes, lambda h: F.size(F.filter(hashes, lambda g: g == h)) > 1)
    return _on(c, [
        raised(_set(c["is_cropped"]), "OCR_CROPPED"), raised(_set(c["is_rotated"]), "OCR_ROTATED"),
        raised(_set(c["is_corrupted"]), "OCR_CORRUPTED_PDF"),
        raised(_set(c["multi_form_detected"]), "OCR_MULTI_FORM_PDF"),
        raised(c["confidence"] < t.ocr_confidence, "OCR_LOW_CONFIDENCE", num=c["confidence"]),
        raised_each(low, lambda e: exc("FLD_ILLEGIBLE", e["key"], num=e["value"])),
        raised(F.size(repeated) > 0, "OCR_DUPLICATE_PAGE", value=F.try_element_at(repeated, F.lit(1))),
    ])


def email(c: Column, t: Thresholds) -> Column:
    domain = F.coalesce(c["sender_domain"], F.lit("unknown"))
    found = F.size(c["client_ssns_found"])
    return _on(c, [
        raised(_set(~c["sender_registered"]), "EMAIL_UNKNOWN_SENDER", value=domain),
        raised(_set(c["is_cpa_forward"]), "EMAIL_CPA_FORWARD"),
        raised(c["spoofing_risk_score"] >= t.spoofing_risk, "EMAIL_SPOOFED", num=c["spoofing_risk_score"]),
        raised(found > 1, "EMAIL_MULTI_CLIENT", num=found),
        raised(_set(~c["has_metadata"]), "EMAIL_NO_METADATA"),
        raised(_set(c["is_encrypted"]), "EMAIL_ENCRYPTED_PDF"),
    ])


def name_differs(known: Column, seen: Column) -> Column:
    """Neither normalised name contains the other."""
    a, b = S.letters_and_digits(known), S.letters_and_digits(seen)
    return ~b.contains(a) & ~a.contains(b)


def wrong_entity(entity: Column, form: Column) -> Column:
    return ((entity == "individual") & form.isin(V.BUSINESS_FORMS)) | (
        (entity == "business") & form.isin(V.INDIVIDUAL_FORMS))


def engagement(c: Column, form: Column, r: Record) -> Column:
    tin, name = r.first_truthy_text("employer_tin", "payer_tin"), r.first_truthy_text("employer_name", "payer_name")
    known = c["known_tin_name_map"][tin]
    fy, ey = c["form_tax_year"], c["engagement_year"]
    alias = F.coalesce(c["merged_alias"], F.lit("unknown"))
    rules = concat([
        raised(_set(c["client_deleted"]), "ENG_CLIENT_DELETED"),
        raised(_set(c["duplicate_profile_detected"]), "ENG_DUPLICATE_PROFILE"),
        raised(_set(~c["client_active"]), "ENG_INACTIVE", num=ey),
        raised((fy != 0) & (ey != 0) & (fy != ey), "ENG_WRONG_YEAR", "tax_year", num=fy),
        raised(wrong_entity(c["client_entity_type"], form), "ENG_WRONG_ENTITY", value=form),
        raised(_set(c["client_merged"]), "ENG_CLIENT_MERGED", value=alias),
        raised(name_differs(known, name), "ID_NAME_TIN_MISMATCH", "employer_tin", tin),
    ])
    return (
        F.when(c.isNull(), empty())
        .when(_set(~c["client_found"]), F.array(exc("ENG_UNKNOWN_CLIENT")))
        .otherwise(rules)
    )


def tenant(c: Column) -> Column:
    foreign = F.filter(F.map_values(c["ssn_tenant_map"]), lambda v: ~v.eqNullSafe(c["current_tenant_id"]))
    target, seen = c["target_s3_bucket"], c["detected_s3_bucket"]
    return _on(c, [
        raised(F.size(foreign) > 0, "MT_CROSS_TENANT_CLIENT", value=F.try_element_at(foreign, F.lit(1))),
        raised((target != "") & (seen != "") & (target != seen), "MT_CROSS_TENANT_DOC", value=seen),
        raised(_set(c["shared_family_account"]), "MT_SHARED_FAMILY"),
    ])


def workflow(c: Column, form: Column) -> Column:
    n = c["form_instance_count"][form]
    return _on(c, [
        raised(_has(c["client_waived_forms"], form), "LED_CLIENT_WAIVED", value=form),
        raised(c["ledger_status"] == "closed", "WF_AFTER_CLOSED"),
        raised(_set(c["is_reupload"]) & _set(c["prior_version_exists"]), "WF_REUPLOAD"),
        raised(_set(~c["ledger_updated"]), "WF_LEDGER_NOT_UPDATED"),
        raised(_set(c["manual_override"]) & ~_set(c["audit_trail_present"]), "WF_MANUAL_NO_AUDIT"),
        raised(_filled(c["forms_in_ledger"]) & ~_has(c["forms_in_ledger"], form), "LED_FORM_NOT_IN_LEDGER", value=form),
        raised(n > 1, "LED_MULTIPLE_SAME_FORM", num=n),
    ])


def session(c: Column, wf: Column, form: Column, r: Record, t: Thresholds) -> Column:
    doc_hash = r.text("_document_hash")
    person = r.first_truthy_text("recipient_tin", "employee_ssn")
    recipient = r.first_truthy_text("recipient_tin")
    tin = r.first_truthy_text("employer_tin", "payer_tin")
    state, fed = c["state_income_reported"], c["federal_income_reported"]
    state_on, fed_on = S.truthy(state, "double"), S.truthy(fed, "double")
    gap = F.abs(state - fed)
    held, est = r.num("state_income_tax_withheld"), r.num("estimated_tax_payments")
    loss, py_est = c["prior_year_cap_loss"], c["prior_year_estimated_payments"]
    py, cy = c["prior_year_forms"], c["current_year_forms"]
    missing = F.when(_filled(py) & _filled(cy), F.filter(py, lambda f: ~_has(cy, f) & (f != form)))
    owed_forms = F.filter(wf["forms_in_ledger"], lambda f: ~_has(cy, f) & ~_has(wf["client_waived_forms"], f))
    return _on(c, [
        raised(_has(c["processed_hashes"], doc_hash), "XDOC_DUPLICATE_UPLOAD", value=doc_hash),
        raised(_has(c["dependent_ssns"], person), "ID_DUPLICATE_DEP_SSN", "recipient_tin", person),
        raised(state_on & fed_on & (gap > t.state_federal_gap), "XDOC_CONFLICT_INCOME", num=gap),
        raised_each(missing, lambda f: exc("XDOC_MISSING_RECURRING", value=f)),
        raised(state_on & ~fed_on, "XDOC_STATE_MISMATCH", num=state),
        raised(S.truthy(held, "double") & ~fed_on, "CTX_STATE_NO_FED", "state_income_tax_withheld", num=held),
        raised((loss > 0) & r.num("capital_loss_carryover").isNull(), "CTX_CAP_LOSS_MISSING", "capital_loss_carryover", num=loss),
        raised((py_est > 0) & est.isNull(), "CY_CARRYOVER_MISSING", "estimated_tax_payments", num=py_est),
        raised((est > 0) & ~_has(cy, F.lit("1040")), "CY_EST_NOT_FILED", "estimated_tax_payments", num=est),
        raised(form.startswith("1099") & _has(c["dependent_ssns"], recipient), "CTX_DEP_FORM", "recipient_tin", recipient),
        raised(tin.isNotNull() & _filled(c["known_tins"]) & ~_has(c["known_tins"], tin), "ID_NEW_EMPLOYER_TIN", "employer_tin", tin),
        raised(F.size(owed_forms) > 0, "LED_PARTIAL_FORM_SET", value=_as_text(owed_forms)),
    ])


def security(c: Column, t: Thresholds) -> Column:
    want, got = c["document_hash_expected"], c["document_hash_actual"]
    n = c["extraction_attempt_count"]
    return _on(c, [
        raised(_set(c["pii_in_logs_detected"]), "SEC_PII_IN_LOGS"),
        raised(_set(c["unauthorized_role"]), "SEC_UNAUTHORIZED_ACCESS"),
        raised(_set(c["s3_public_access"]), "SEC_S3_PUBLIC"),
        raised((want != "") & (got != "") & (want != got), "SEC_TAMPERED_DOC", value=got),
        raised(n > t.attempt_limit, "SEC_EXCESS_ATTEMPTS", num=n),
    ])


def box_drift(expected: Column, actual: Column, t: Thresholds) -> Column:
    limit = t.bbox_drift_normalised if t.bbox_space == "normalised" else t.bbox_drift_pixels
    dx = F.abs(F.get(expected, 0) - F.get(actual, 0))
    dy = F.abs(F.get(expected, 1) - F.get(actual, 1))
    return (dx > limit) | (dy > limit)


def extraction(c: Column, fields: Column, r: Record, t: Thresholds) -> Column:
    """Rules about the extraction run itself (anchors, pages, inferred values)."""
    want, got = c["context_client_id"], c["extracted_client_id"]
    drift = F.filter(F.map_entries(c["field_bounding_boxes"]),
                     lambda e: box_drift(e["value"]["expected"], e["value"]["actual"], t))
    pages = c["multi_form_page_assignment"]
    worded = F.filter(fields, lambda x: x["nf"] & (x["kind"] == "str") & F.lower(x["s"]).rlike(_WORDS))
    tokens = c["context_window_tokens"]
    return _on(c, [
        raised((want != "") & (got != "") & (want != got), "LLMD_CROSS_CLIENT_BLEED", value=got),
        raised(tokens > t.context_tokens, "LLMD_CONTEXT_OVERFLOW", num=tokens),
        raised(c["extraction_page"] != c["expected_page"], "LLM_CROSS_PAGE_BLEED", num=c["extraction_page"]),
        raised_each(drift, lambda e: exc("LLM_CONTEXT_DRIFT", e["key"], F.array_join(e["value"]["actual"].cast("array<string>"), ","))),
        raised(F.size(F.array_distinct(F.map_values(pages))) > 1, "LLMD_MULTI_FORM_MISASSIGN", value=F.to_json(pages)),
        raised_each(worded, lambda x: exc("LLM_NUMERIC_WORD_ERR", x["field"], x["s"])),
        raised_each(c["hallucinated_fields"], lambda f: exc("LLM_HALLUCINATED", f, r.value(f), r.number(f))),
        raised_each(c["blank_as_missing_fields"], lambda f: exc("LLM_BLANK_AS_MISSING", f)),
        raised(_filled(c["reordered_fields"]), "LLM_REORDERED_MAP", value=_as_text(c["reordered_fields"])),
        raised_each(c["over_inferred_fields"], lambda f: exc("LLM_OVER_INFERENCE", f, r.value(f), r.number(f))),
    ])


def type_conflicts(fields: Column) -> Column:
    """Text in a numeric field that is no number, other than blank or N/A. Runs with or without context."""
    bad = F.filter(fields, lambda x: x["nf"] & x["kind"].isin("str", "bool", "list") & x["d"].isNull()
                   & ~S.strip(x["s"]).isin("", "N/A"))
    return F.transform(bad, lambda x: exc("DB_TYPE_CONFLICT", x["field"], x["s"]))


def laid_out_conflicts(r: Record) -> list[Raised]:
    """``type_conflicts`` written out over the fields of the record's layout."""
    return [raised(r.raw(n)["kind"].isin("str", "bool") & r.num(n).isNull() & ~S.strip(r.text(n)).isin("", "N/A"), "DB_TYPE_CONFLICT", n, r.text(n))
            for n, k in r.layout.items() if has_numeric_name(n) and k != "num"]


def database(c: Column, fields: Column) -> Column:
    return F.concat(_on(c, [
        raised(_set(c["json_flatten_failed"]), "DB_JSON_FLATTEN_FAIL"),
        raised_each(c["null_non_nullable_fields"], lambda f: exc("DB_NULL_NON_NULLABLE", f)),
        raised(_set(c["duplicate_pk"]), "DB_DUPLICATE_PK", value=c["pk_value"]),
        raised(_set(c["schema_drift_detected"]), "DB_SCHEMA_DRIFT", value=c["schema_version"]),
    ]), type_conflicts(fields))


def structural(c: Column, r: Record, t: Thresholds) -> Column:
    pages, ok = c["missing_pages"], _set(c["variant_validated"])
    return _on(c, [
        raised_each(F.when(ok, pages), lambda p: exc("STR_MULTI_PAGE_VARIANT", value=p)),
        raised(_filled(pages) & ~ok, "OCR_CROPPED", value=_as_text(pages)),
        raised((c["layout_year"] != 0) & (c["layout_year"] != t.tax_year), "STR_ALT_LAYOUT", num=c["layout_year"]),
        raised_each(c["conditional_skipped_fields"], lambda f: exc("STR_CONDITIONAL_SKIP", f)),
        raised_each(c["deprecated_fields_present"], lambda f: exc("STR_DEPRECATED_FIELD", f, r.value(f), r.number(f))),
        raised_each(c["intentionally_blank_fields"], lambda f: exc("STR_OPTIONAL_BLANK", f)),
    ])


def context_exceptions(ctx: Column, form: Column, fields: Column, r: Record, t: Thresholds = DEFAULTS) -> Column:
    """All context sections in their fixed order."""
    return F.concat(
        ocr(ctx["ocr"], t), email(ctx["email"], t), engagement(ctx["engagement"], form, r), tenant(ctx["tenant"]),
        workflow(ctx["workflow"], form), session(ctx["session"], ctx["workflow"], form, r, t),
        security(ctx["security"], t), extraction(ctx["llm"], fields, r, t), database(ctx["db"], fields),
        structural(ctx["schema"], r, t),
    )
