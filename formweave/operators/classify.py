"""Split exceptions into those code can fix and those a person must review, and compute the fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from .exceptions import Raised
from .records import Layout, Record, field_map

PROPOSAL_TYPE = "struct<text:string,number:double,flag:boolean>"


def _proposal(text: Column | None = None, number: Column | None = None, flag: Column | None = None) -> Column:
    return F.struct(
        (F.lit(None) if text is None else text).cast("string").alias("text"),
        (F.lit(None) if number is None else number).cast("double").alias("number"),
        (F.lit(None) if flag is None else flag).cast("boolean").alias("flag"),
    )


def _plain(r: Record, name: str) -> Column:
    """Strict number of a field: stored number, or text that reads as a number as it stands."""
    if r.is_num(name):
        return r.num(name)
    x = r.raw(name)
    return F.when(x["kind"] == "num", x["d"]).when(x["kind"] == "str", S.strip(x["s"]).try_cast("double"))


def _or_zero(r: Record, name: str) -> Column:
    """Absent or empty counts as zero; text that is no number stays null."""
    return F.when(r.truthy(name), _plain(r, name)).otherwise(F.lit(0.0))


def subtotal_fix(field: str | Column, r: Record, t: Thresholds = DEFAULTS) -> Column:
    """Recomputed total for the fields that have an exact formula, else null. For a field known by name only its own formula is made."""

    def present(*names: str) -> Column:
        out = r.text(names[0]).isNotNull()
        for n in names[1:]:
            out = out | r.text(n).isNotNull()
        return out

    def social_security() -> Column:
        return F.coalesce(F.when(r.truthy("social_security_wages"), _plain(r, "social_security_wages")), _plain(r, "box_3_social_security_wages"))

    def medicare() -> Column:
        return F.coalesce(F.when(r.truthy("medicare_wages_and_tips"), _plain(r, "medicare_wages_and_tips")), _plain(r, "box_5_medicare_wages_and_tips"))

    def balance() -> Column:
        return S.round2(_plain(r, "total_tax") - _plain(r, "total_payments"))

    wh = ("withholding_w2", "withholding_1099", "withholding_other")
    gp = ("guaranteed_payments_services", "guaranteed_payments_capital")
    within = {"social_security_tax": lambda: S.round2(social_security() * t.ss_rate), "medicare_tax": lambda: S.round2(medicare() * t.medicare_rate)}
    named = {
        "adjusted_gross_income": lambda: S.round2(_plain(r, "total_income") - _or_zero(r, "adjustments_to_income")),
        "taxable_income": lambda: S.floor_zero(S.round2(_plain(r, "adjusted_gross_income") - _or_zero(r, "total_deductions"))),
        "total_withholding": lambda: F.when(present(*wh), S.round2(_or_zero(r, wh[0]) + _or_zero(r, wh[1]) + _or_zero(r, wh[2]))),
        "amount_owed": lambda: F.when(balance() > 0, balance()),
        "overpayment": lambda: F.when(balance() < 0, -balance()),
        "total_guaranteed_payments": lambda: F.when(present(*gp), S.round2(_or_zero(r, gp[0]) + _or_zero(r, gp[1]))),
    }
    if isinstance(field, str):
        made = [f for part, f in within.items() if part in field] + [f for n, f in named.items() if n == field]
        return made[0]() if made else F.lit(None).cast("double")
    out = F
    for part, formula in within.items():
        out = out.when(field.contains(part), formula())
    for name, formula in named.items():
        out = out.when(field == name, formula())
    return out


def cleaned_number(value: Column) -> Column:
    """Number left after OCR noise is dropped; brackets mean negative."""
    s = F.regexp_replace(value, r"[^0-9.\-()]", "")
    n = S.plain_number(F.btrim(s, F.lit("()")))
    return F.when(s.startswith("(") & s.endswith(")"), -n).otherwise(n)


def propose(e: Column, fields: Column, t: Thresholds = DEFAULTS, layout: Layout | None = None) -> Column:
    """Proposed value struct, or null when code cannot decide. A proposal of three nulls means 'set to null'.

    The cleaned number of the value and the recomputed subtotal are worked out only for the codes that take them.
    """
    code, value = e["code"], e["value"]
    if layout is None:
        subtotal = lambda: S.let(field_map(fields), lambda m: subtotal_fix(e["field"], Record(m), t))
    else:
        subtotal = lambda: subtotal_fix(e["field"], Record(fields, layout=layout), t)

    def if_known(number: Column) -> Column:
        return S.let(number, lambda n: F.when(n.isNotNull(), _proposal(number=n)))

    return (
        F.when((code == "FLD_ZERO_VS_BLANK") & S.strip(value).isin(V.STRING_ZEROS), _proposal(number=F.lit(0.0)))
        .when(code == "FLD_DASH_SYMBOL", _proposal(number=F.lit(0.0)))
        .when(code == "FLD_NA_TEXT", _proposal())
        .when(code == "FLD_CHECKBOX_BLANK", _proposal(flag=F.lit(False)))
        .when(code == "FLD_SPECIAL_CHARS", if_known(cleaned_number(value)))
        .when((code == "LLM_OVER_NORMALIZATION") & (F.length(value) > 0), _proposal(text=F.upper(value)))
        .when(code == "NUM_SUBTOTAL_MISMATCH", if_known(subtotal()))
    )


# codes that ``propose`` may have a value for
DECIDABLE = ("FLD_ZERO_VS_BLANK", "FLD_DASH_SYMBOL", "FLD_NA_TEXT", "FLD_CHECKBOX_BLANK", "FLD_SPECIAL_CHARS", "LLM_OVER_NORMALIZATION", "NUM_SUBTOTAL_MISMATCH")


def decided(x: Raised, r: Record, t: Thresholds = DEFAULTS) -> Column:
    """Would ``propose`` have a value for what this rule of a ``DECIDABLE`` code raises? The same cases, for a code that is known before any row is read."""
    value = F.lit(None).cast("string") if x.value is None else x.value
    known = {
        "FLD_ZERO_VS_BLANK": lambda: S.strip(value).isin(V.STRING_ZEROS),
        "FLD_DASH_SYMBOL": lambda: F.lit(True), "FLD_NA_TEXT": lambda: F.lit(True), "FLD_CHECKBOX_BLANK": lambda: F.lit(True),
        "FLD_SPECIAL_CHARS": lambda: cleaned_number(value).isNotNull(),
        "LLM_OVER_NORMALIZATION": lambda: F.length(value) > 0,
        "NUM_SUBTOTAL_MISMATCH": lambda: subtotal_fix(x.field, r, t).isNotNull(),
    }
    return F.coalesce(known[x.code](), F.lit(False))


def classify(excs: Column, fields: Column, t: Thresholds = DEFAULTS, layout: Layout | None = None) -> Column:
    """Array of first-per-(code, field) exceptions with bucket, proposal and hint.

    Exceptions without a field, and INFO ones code cannot fix, fall in neither bucket. Keys are compared only where one repeats.
    """
    def first_of_each(a: Column, keys: Column) -> Column:
        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(repeated, F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)).otherwise(a)

    with_field = F.filter(excs, lambda e: e["field"] != "")
    first = S.let(with_field, lambda a: S.let(F.transform(a, lambda e: F.concat(e["code"], F.lit(":"), e["field"])), lambda keys: first_of_each(a, keys)))
    hints = F.create_map(*[F.lit(x) for kv in V.EDIT_HINTS.items() for x in kv])

    proposed = F.transform(first, lambda e: F.struct(e.alias("e"), propose(e, fields, t, layout).alias("p")))

    def label(x: Column) -> Column:
        e, p = x["e"], x["p"]
        return F.struct(
            e["code"].alias("code"), e["severity"].alias("severity"), e["field"].alias("field"),
            e["value"].alias("value"), e["value_num"].alias("value_num"),
            F.when(p.isNotNull(), "fixable").when(e["severity"] != "INFO", "review").alias("bucket"),
            p.alias("proposal"),
            F.when(p.isNull(), F.coalesce(F.element_at(hints, e["code"]), F.lit(V.DEFAULT_HINT))).alias("edit_hint"),
        )

    return F.filter(F.transform(proposed, label), lambda c: c["bucket"].isNotNull())


def in_bucket(classified: Column, bucket: str) -> Column:
    return F.filter(classified, lambda c: c["bucket"] == bucket)


def is_ignored(code: Column, field: Column, ignored: Column) -> Column:
    """Is an exception on the ignore list of its document ('code:field' or 'code:document')? The list travels on the row."""
    exc_id = F.concat_ws(":", code, F.coalesce(F.nullif(field, F.lit("")), F.lit("document")))
    return F.coalesce(F.array_contains(ignored, exc_id), F.lit(False))


def accepted_value(proposed: Column, auto: Column, current: Column) -> Column:
    return F.coalesce(proposed, auto, current, F.lit(""))


def build_fixes(accepted: DataFrame, edits: DataFrame) -> DataFrame:
    """Accepted proposals followed by manual edits; edits are numbered later, so they win."""
    a = accepted.select("doc_id", "field", "new_value", F.lit(0).alias("origin"))
    b = edits.select("doc_id", "field", F.col("new_value"), F.lit(1).alias("origin"))
    return a.unionByName(b).select("doc_id", F.col("origin").alias("seq"), "field", "new_value")


def all_verified(fields: Column) -> Column:
    """Approve-all: every field of the record becomes human-verified."""
    return F.transform(fields, lambda x: x["field"])
