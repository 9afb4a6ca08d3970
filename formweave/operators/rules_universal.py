"""Field hygiene rules that apply to every form, evaluated in one pass over the field array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from . import exceptions as X
from .records import Record, has_numeric_name, may_be_text

_BLANK_TEXTS = V.DASH_TEXTS + S.NA_SPELLINGS
_SPECIAL_TEXTS = V.STRING_ZEROS + _BLANK_TEXTS
_LISTED_FIELDS = V.NAME_FIELDS + V.YEAR_FIELDS + V.CHECKBOX_FIELDS + V.ADDRESS_FIELDS
_ZIP = r"[0-9]{5}"
_STATE = r"\b(?=[A-Z]{2}\b)(" + "|".join(V.STATE_CODES) + r")\b"
_STREET = r"(?i)\b[0-9]+\s+\w+\s+(" + "|".join(V.STREET_WORDS) + r")\b"


def special_residue(s: Column) -> Column:
    """What is left of a numeric text after digits, blanks, currency and sign marks are removed."""
    return F.regexp_replace(s, r"[0-9\s$,.\-()+/]", "")


def address_collapsed(s: Column) -> Column:
    return (F.length(s) > 40) & ~s.contains("\n") & s.rlike(_ZIP) & s.rlike(_STATE) & s.rlike(_STREET)


def year_value(s: Column) -> Column:
    return F.left(S.strip(s), F.lit(4)).try_cast("int")


def wrong_year(s: Column, t: Thresholds) -> Column:
    y = year_value(s)
    return (y < t.tax_year - 1) | (y > t.tax_year)


def last_cent_five(d: Column) -> Column:
    return F.pmod(F.rint(F.abs(d) * 100), F.lit(10.0)) == 5.0


def _suspicious(x: Column, t: Thresholds) -> Column:
    """A cheap test that lets every field through on which a rule below may fire; most fields of most documents go no further."""
    return (
        (x["nf"] & (x["d"] > min(t.misplaced_decimal, t.large_value))) | x["field"].isin(_LISTED_FIELDS)
        | ((x["kind"] == "str") & (x["nf"] | S.strip(x["s"]).isin(_SPECIAL_TEXTS))))


def _in_list_order(hits: Column, names: list[str]) -> Column:
    place = lambda x: F.array_position(F.array(*[F.lit(v) for v in names]), x["field"])

    def ordered(a: Column) -> Column:
        ranked = F.array_sort(F.transform(a, lambda x: F.struct(place(x).alias("place"), x.alias("x"))))
        return F.when(F.size(a) > 1, F.transform(ranked, lambda r: r["x"])).otherwise(a)

    return S.let(hits, ordered)


def universal_exceptions(fields: Column, t: Thresholds = DEFAULTS) -> Column:
    """Array of exceptions in rule order, then field order; rules over a list of names report in the order of that list."""
    half_cent = F.filter(fields, lambda x: x["nf"] & x["d"].isNotNull() & last_cent_five(x["d"]))
    variance = S.let(F.try_element_at(half_cent, F.lit(1)), lambda x: X.raised(x.isNotNull(), "NUM_ROUNDING_VARIANCE", x["field"]).array())

    def rules(a: Column) -> Column:
        f, s, d = (lambda x: x["field"]), (lambda x: x["s"]), (lambda x: x["d"])
        is_text = lambda x: x["kind"] == "str"

        def each(cond, make, names: list[str] | None = None) -> Column:
            hits = F.filter(a, lambda x: cond(x) if names is None else x["field"].isin(names) & cond(x))
            return F.transform(hits if names is None else _in_list_order(hits, names), make)

        def blank_code(x: Column) -> Column:
            return F.when(S.is_na_text(S.strip(s(x))), X.exc("FLD_NA_TEXT", f(x), s(x))).otherwise(X.exc("FLD_DASH_SYMBOL", f(x), s(x)))

        return F.concat(
            each(lambda x: is_text(x) & S.strip(s(x)).isin(V.STRING_ZEROS), lambda x: X.exc("FLD_ZERO_VS_BLANK", f(x), s(x))),
            each(lambda x: x["nf"] & is_text(x) & (special_residue(s(x)) != ""), lambda x: X.exc("FLD_SPECIAL_CHARS", f(x), s(x))),
            each(lambda x: x["nf"] & (d(x) > t.misplaced_decimal), lambda x: X.exc("NUM_DECIMAL_MISPLACE", f(x), num=d(x))),
            each(lambda x: x["nf"] & (d(x) > t.large_value) & ~(d(x) > t.misplaced_decimal), lambda x: X.exc("NUM_LARGE_OUTLIER", f(x), num=d(x))),
            each(lambda x: is_text(x) & S.title_cased(s(x)), lambda x: X.exc("LLM_OVER_NORMALIZATION", f(x), s(x)), V.NAME_FIELDS),
            each(lambda x: wrong_year(s(x), t), lambda x: X.exc("CY_WRONG_YEAR_UPLOAD", f(x), num=year_value(s(x))), V.YEAR_FIELDS),
            variance,
            each(lambda x: x["kind"] == "null", lambda x: X.exc("FLD_CHECKBOX_BLANK", f(x)), V.CHECKBOX_FIELDS),
            each(lambda x: is_text(x) & address_collapsed(s(x)), lambda x: X.exc("FLD_ADDRESS_COLLAPSED", f(x), s(x)), V.ADDRESS_FIELDS),
            each(lambda x: is_text(x) & S.strip(s(x)).isin(_BLANK_TEXTS), blank_code),
        )

    return S.let(F.filter(fields, lambda x: _suspicious(x, t)), rules)


def laid_out_rules(r: Record, t: Thresholds = DEFAULTS) -> list[X.Raised]:
    """The same rules, in the same order, written out over the fields of the record's layout."""
    texts = [n for n, k in r.layout.items() if may_be_text(k)]
    numeric = [n for n in r.layout if has_numeric_name(n)]
    known = lambda names: [n for n in names if n in r.layout]
    is_text, s, d = r.is_text, r.text, r.num

    def blank_codes(n: str) -> list[X.Raised]:
        text = r.stripped(n)
        return [X.raised(is_text(n) & S.is_na_text(text), "FLD_NA_TEXT", n, s(n)), X.raised(is_text(n) & text.isin(V.DASH_TEXTS), "FLD_DASH_SYMBOL", n, s(n))]

    first = F
    for n in numeric:
        first = first.when(d(n).isNotNull() & last_cent_five(d(n)), F.lit(n))
    variance = r.fact("cent five", first.otherwise(F.lit(None).cast("string"))) if numeric else None
    return [
        *[X.raised(is_text(n) & r.stripped(n).isin(V.STRING_ZEROS), "FLD_ZERO_VS_BLANK", n, s(n)) for n in texts],
        *[X.raised(is_text(n) & (special_residue(s(n)) != ""), "FLD_SPECIAL_CHARS", n, s(n)) for n in texts if n in numeric],
        *[X.raised(d(n) > t.misplaced_decimal, "NUM_DECIMAL_MISPLACE", n, num=d(n)) for n in numeric],
        *[X.raised((d(n) > t.large_value) & ~(d(n) > t.misplaced_decimal), "NUM_LARGE_OUTLIER", n, num=d(n)) for n in numeric],
        *[X.raised(is_text(n) & S.title_cased(s(n)), "LLM_OVER_NORMALIZATION", n, s(n)) for n in known(V.NAME_FIELDS) if n in texts],
        *[X.raised(wrong_year(s(n), t), "CY_WRONG_YEAR_UPLOAD", n, num=year_value(s(n))) for n in known(V.YEAR_FIELDS)],
        *[X.raised(variance == n, "NUM_ROUNDING_VARIANCE", n) for n in numeric],
        *[X.raised(r.absent(n), "FLD_CHECKBOX_BLANK", n) for n in known(V.CHECKBOX_FIELDS)],
        *[X.raised(is_text(n) & address_collapsed(s(n)), "FLD_ADDRESS_COLLAPSED", n, s(n)) for n in known(V.ADDRESS_FIELDS) if n in texts],
        *[x for n in texts for x in blank_codes(n)],
    ]
