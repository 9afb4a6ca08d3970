"""Secret scan: fixed patterns, and the Shannon entropy of a sliding window over candidate strings. Columns and SQL functions only.

Patterns (leftmost, not overlapping, per kind): ``assign`` a key word and a value of 12 characters or more, ``access`` a cloud
access key id, ``hex`` a hexadecimal run. The method adds ``entropy``: a candidate is a run of ``WINDOW`` or more characters of
the base64 alphabets. Its class is the narrowest alphabet that holds it (without digits, hexadecimal, alphanumeric, base64).
A window of ``WINDOW`` characters slides over it; the counts of the characters and the sum of c log c change by the character
that enters and the one that leaves, and where the entropy reaches the limit of the class the candidate is reported, unless a
pattern of the allow list fits it or a pattern span already covers it. Without digits the limit is highest, and runs all of whose
pieces are word-like are allowed.

The characters of a candidate are split once and the counts are changed at two places for each step, so the time is in proportion to
the text. Loops over groups in the allow list are possessive: the regex engine runs them without calling itself, however long the run
is, and each is followed by what it cannot take, so nothing else fits or fails than without.

Positions are code points, ends exclusive. Null texts count as empty. Rows are scanned one by one, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_KEY = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# the longest run decides: a shorter match would lie in the same run
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
VALUE = 12
WINDOW = 20
_SET = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_SET}){_SET}{{{WINDOW},}}"
LIMITS = (("^[^0-9]+$", 3.9), ("^[0-9A-Fa-f]+$", 3.0), ("^[A-Za-z0-9]+$", 3.6), ("", 3.8))
# words, also in camel case; a piece of a path: words with a short number, or numbers, parted by signs
_LETTERS = "(?:[A-Z]?[a-z]++(?:[A-Z][a-z][a-z]++)*+|[A-Z]++)"
_WORD = f"(?:{_LETTERS}[0-9]{{0,4}}+|[0-9]{{1,8}}+)"
_PIECE = f"{_WORD}(?:[_=-]++{_WORD})*+"
ALLOW = (
    "^[0-9=+/_-]+$",  # numbers, dates, rules of signs
    f"^[=+/_-]*+(?:{_LETTERS}[=+/_-]++)*+(?:{_LETTERS})?+$",  # words without numbers
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # identifiers made to be public
    f"^(?:/++(?:{_PIECE}/++){{2,}}+|(?:{_PIECE}/++){{3,}}+)(?:{_PIECE})?+$",  # paths all of whose pieces are word-like; a slash alone says nothing, base64 has it
    "^[A-Za-z]++(?:[_-][A-Za-z]++)*+[_-]?[0-9]{1,4}$",  # words with a number
    # placeholders, where nothing else is there
    "^[Xx0-9_=+/-]*+(?:(?:[Ee]xample|EXAMPLE|[Dd]ummy|[Cc]hangeme|[Pp]laceholder|[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET|abcdefghij(?:klmnopqrstuvwxyz)?)[Xx0-9_=+/-]*+)*+$",
    "^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",  # a published example
)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, t): where the pattern matches and what; empty where it does not."""
    p = F.lit(pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))

    def step(state: Column, x: Column) -> Column:
        s = state["at"] + F.length(x["gap"])
        e = s + F.length(F.coalesce(x["hit"], F.lit("")))
        return F.struct(e.alias("at"), F.when(x["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("t"))))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda state: state["out"])).otherwise(F.array().cast("array<struct<s:int,e:int,t:string>>"))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of the string; -1 for a shorter string."""
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    put = lambda n, k, v: F.concat(F.slice(n, F.lit(1), k), F.array(v), F.slice(n, k + 2, F.lit(128)))
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def over(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enter, leave = F.get(codes, i), F.when(i >= window, F.get(codes, i - window))
            n = state["n"]
            less = F.when(leave.isNull() | (leave == enter), n).otherwise(put(n, leave, F.get(n, leave) - 1))
            counts = F.when(leave == enter, n).otherwise(put(less, enter, F.get(less, enter) + 1))
            add, gone = F.get(n, enter), F.get(n, leave)
            change = F.when(leave == enter, 0.0).otherwise(term(add + 1) - term(add) + F.when(leave.isNotNull(), term(gone - 1) - term(gone)).otherwise(0.0))
            total = state["sum"] + change
            best = F.when(i >= window - 1, F.greatest(state["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(state["best"])
            return F.struct(counts.alias("n"), total.alias("sum"), best.alias("best"))

        places = F.transform(codes, lambda _, i: i)
        return F.aggregate(places, start, step, lambda state: state["best"])

    # bound once: the lambda of the walk reads the codes as they are
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    return F.coalesce(F.get(F.transform(F.array(codes), over), F.lit(0)), F.lit(-1.0))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allow: Sequence[str] = ALLOW, limits: Sequence[tuple[str, float]] = LIMITS) -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of (kind, s, e, t) by start and kind."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    value = lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= VALUE
    rows = rows.select("doc_id", F.filter(_matches(t, ASSIGN), value).alias("assign"), _matches(t, ACCESS).alias("access"), _matches(t, HEX).alias("hex"), _matches(t, CANDIDATE).alias("found"))
    limit = F.lit(float(limits[-1][1]))

    def suspect(x: Column) -> Column:
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | x["t"].rlike(p)
        least = limit
        for p, bits in reversed(limits[:-1]):
            least = F.when(x["t"].rlike(p), F.lit(float(bits))).otherwise(least)
        covered = F.exists(F.concat("assign", "access", "hex"), lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]))
        return F.when(allowed | covered, F.lit(False)).otherwise(peak_entropy(x["t"]) >= least - 1e-9)

    rows = rows.withColumn("entropy", F.when(F.size("found") > 0, F.filter("found", suspect)).otherwise(F.col("found")))
    tag = lambda i: lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), x["t"].alias("t"))
    tagged = [F.transform(k, tag(i)) for i, k in enumerate(KINDS)]
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    spans = F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.struct(kind(x).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t")))
    return rows.select("doc_id", spans.alias("spans"))
