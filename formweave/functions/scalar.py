"""Column functions shared by all operators. Everything stays in the JVM; no Python UDF."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

WHITESPACE = " \t\n\r\x0b\x0c"
NUMERIC_SUFFIX_RE = "_(" + "|".join(x[1:] for x in V.NUMERIC_SUFFIXES) + ")$"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace on both sides, not blanks only."""
    return F.btrim(c, F.lit(WHITESPACE))


def _round(c: Column, digits: int) -> Column:
    return F.round(c.try_cast("decimal(38,6)"), digits).cast("double")


def money(c: Column) -> Column:
    """Exact two-digit amount for sums: independent of the order of addition."""
    return F.round(c.try_cast("decimal(38,6)"), 2).cast("decimal(20,2)")


def round2(c: Column) -> Column:
    """Two-digit rounding through DECIMAL, so that engines agree (null beyond 1e32)."""
    return _round(c, 2)


def round3(c: Column) -> Column:
    return _round(c, 3)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Lambdas of higher-order functions evaluate outer expressions again for every element; a value bound
    this way is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def floor_zero(c: Column) -> Column:
    """max(0, c) that keeps null (``greatest`` would skip it)."""
    return F.when(c > 0, c).when(c.isNotNull(), F.lit(0.0))


def is_numeric_field(name: Column) -> Column:
    return name.rlike(NUMERIC_SUFFIX_RE)


NA_SPELLINGS = sorted({"".join(x) for t in V.NA_TEXTS for x in product(*((c.lower(), c.upper()) for c in t))})


def is_na_text(s: Column) -> Column:
    """N/A in one of its spellings, whatever the case of each letter."""
    return s.isin(NA_SPELLINGS)


PLAIN_NUMBER_RE = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"
# a digit, and no minus behind the first one: without this nothing that is left can be a number
MAYBE_NUMBER_RE = r"^[^0-9]*+[0-9][^\-]*+$"


def plain_number(c: Column) -> Column:
    """Number of a text of digits, dots and signs. The test spares the cast's exception, which costs far more than the rule, on other texts."""
    return F.when(c.rlike(PLAIN_NUMBER_RE), c.try_cast("double"))


def lenient_number(text: Column) -> Column:
    """Number printed on a form: blanks and N/A are null, dashes are zero, brackets are negative."""
    s = strip(text)
    value = F.when(s.rlike(MAYBE_NUMBER_RE), plain_number(F.regexp_replace(s, r"[^0-9.\-]", "")))
    return (
        F.when(is_na_text(s) | (s == ""), F.lit(None).cast("double"))
        .when(s.isin(V.DASH_TEXTS), F.lit(0.0))
        .when(s.startswith("(") & s.endswith(")"), -value)
        .otherwise(value)
    )


def plain_number_text(d: Column) -> Column:
    """Text form of a double without exponent: 123456789.0 stays 123456789.0."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    wide = F.regexp_replace(d.try_cast("decimal(38,10)").cast("string"), "0+$", "")
    return (
        F.when(whole, F.concat(d.try_cast("bigint").cast("string"), F.lit(".0")))
        .when(F.abs(d) >= 1e7, F.coalesce(wide, d.cast("string")))
        .otherwise(d.cast("string"))
    )


def truthy(c: Column, dtype: str) -> Column:
    """Null, zero, false, empty text and empty lists count as absent."""
    if dtype in ("string",):
        t = c != ""
    elif dtype == "boolean":
        t = c
    elif dtype.startswith(("array", "map")):
        t = F.size(c) > 0
    else:
        t = c != 0
    return F.coalesce(t, F.lit(False))


# --- identifiers -------------------------------------------------------------------------------------
MASKED_SSN_RE = r"^([*Xx]{3}-[*Xx]{2}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[*Xx]{4}|[*Xx]{3}-[*Xx]{2}-[*Xx]{4})$"
SSN_RE = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
EIN_RE = r"^[0-9]{2}-[0-9]{7}$"


def bad_ssn(s: Column) -> Column:
    area = F.substring(s, 1, 3)
    return (
        area.isin("000", "666") | area.startswith("9")
        | (F.substring(s, 5, 2) == "00") | (F.substring(s, 8, 4) == "0000")
    )


def tin_status(text: Column) -> Column:
    """'ok', 'masked' or 'bad' for an SSN or EIN; null in, null out."""
    s = strip(text)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s.rlike(MASKED_SSN_RE), F.lit("masked"))
        .when(s.rlike(SSN_RE), F.when(bad_ssn(s), F.lit("bad")).otherwise(F.lit("ok")))
        .when(s.rlike(EIN_RE), F.when(F.left(s, F.lit(2)).isin(V.BAD_EIN_PREFIXES), F.lit("bad")).otherwise(F.lit("ok")))
        .otherwise(F.lit("bad"))
    )


def bad_ein(text: Column) -> Column:
    s = strip(text)
    return ~s.rlike(EIN_RE) | F.left(s, F.lit(2)).isin(V.BAD_EIN_PREFIXES)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def tin_code(text: Column, ein_only: bool = False) -> Column:
    """Exception code raised by an identifier, or null when it is acceptable or absent."""
    if ein_only:
        return F.when(bad_ein(text), F.lit("ID_INVALID_TIN"))
    status = tin_status(text)
    return F.when(status == "masked", F.lit("ID_MASKED_SSN")).when(
        status == "bad",
        F.when(F.length(digits_only(text)) == 9, F.lit("ID_INVALID_SSN")).otherwise(F.lit("ID_INVALID_TIN")),
    )


# --- names ---------------------------------------------------------------------------------------------
def title_cased(c: Column) -> Column:
    """Text equal to its own title-casing while not being all upper case. Text without letters counts."""
    lower_start = c.rlike(r"(^|[^\p{L}])\p{Ll}")
    upper_inside = c.rlike(r"\p{L}\p{Lu}")
    all_upper = c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")
    return (strip(c) != "") & ~all_upper & ~lower_start & ~upper_inside


def norm_name(c: Column) -> Column:
    """Trimmed, lower-case, inner whitespace collapsed."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def letters_and_digits(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def storage_key(c: Column) -> Column:
    """File-safe key: lower case, everything but letters, digits, '-', '_', '.' becomes '_'."""
    s = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("unknown")))), r"[^\p{L}\p{N}\-_.]", "_")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("._")), F.lit("")), F.lit("unknown"))


# --- presentation --------------------------------------------------------------------------------------
def mask_value(value: Column, key: Column) -> Column:
    """Hide identifiers under sensitive keys, leaving the last digits."""
    k, s = F.lower(key), strip(value)
    digits = digits_only(s)
    sensitive = k.contains("ssn") | k.contains("tin") | k.contains("claim_number")
    ein_like = k.contains("tin") | (s.contains("-") & (F.length(s) == 10))
    return (
        F.when(~sensitive | (F.coalesce(value, F.lit("")) == ""), value)
        .when(ein_like, F.concat(F.lit("••-"), F.right(s, F.lit(7))))
        .when((F.length(s) >= 9) & (F.length(digits) == 9), F.concat(F.lit("•••-••-"), F.right(digits, F.lit(4))))
        .otherwise(F.concat(F.lit("••••"), F.right(s, F.lit(4))))
    )


def confidence_percent(c: Column) -> Column:
    """Half-up whole percent."""
    return F.floor(c * 100 + 0.5).cast("bigint")


def confidence_band(c: Column) -> Column:
    p = confidence_percent(c)
    return F.when(c.isNull(), F.lit("")).when(p >= 90, F.lit("high")).when(p >= 75, F.lit("med")).otherwise(F.lit("low"))


def rating_band(c: Column) -> Column:
    return (
        F.when(c >= 0.95, F.lit("Excellent")).when(c >= 0.85, F.lit("Good"))
        .when(c >= 0.75, F.lit("Fair")).otherwise(F.lit("Poor"))
    )


def field_label(key: Column) -> Column:
    """Underscores to blanks, first letter of each word raised, box badge split off."""
    rest = F.regexp_replace(key, r"^box_[0-9]+[a-z]?_", "")
    return raise_words(F.replace(rest, F.lit("_"), F.lit(" ")))


def raise_words(c: Column) -> Column:
    words = F.split(c, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def box_badge(key: Column) -> Column:
    hit = F.regexp_extract(key, r"^(box_[0-9]+[a-z]?)_", 1)
    return F.when(hit != "", F.concat(F.lit("Box "), F.regexp_replace(hit, "^box_", "")))


def lookup(mapping: dict[str, object], key: Column, default: object = None) -> Column:
    """Small constant map as a CASE-free literal map lookup."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    hit = F.element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))
