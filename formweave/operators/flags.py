"""Rules as flags on the document row, for documents that all have the same fields.

Over a layout each rule has one code, one severity and one field, so all that varies is whether it fires. Counts, split and scores are sums
and CASEs over these flags, which compile; arrays of exceptions would be walked by lambdas, which Spark interprets for every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..fixed_values import DEFAULTS, Thresholds
from . import classify as C
from . import score as SC
from .exceptions import Raised
from .records import Record, settle


def _any(flags: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in flags:
        out = out | c
    return out


class Flags:
    """The rules of a flat record and what follows from them. Rules come in the order in which they raise exceptions."""

    def __init__(self, r: Record, rules: list[Raised], verified: Column | None, pdf_type: Column, t: Thresholds = DEFAULTS):
        self.r = r
        seen = {}
        if verified is not None:
            names = dict.fromkeys([*r.layout, *[x.field for x in rules if x.field is not None]])  # rules ask for fields that a layout may lack
            seen = {n: r.fact(f"verified:{n}", F.coalesce(F.array_contains(verified, n), F.lit(False))) for n in names}
            rules = [x if x.field is None else x.where(~seen[x.field]) for x in rules]
        self.rules = rules
        self.made = {f"_on{i}": F.coalesce(x.cond, F.lit(False)) for i, x in enumerate(rules)}
        self.made |= {f"_fix{i}": C.decided(x, r, t) for i, x in enumerate(rules) if x.code in C.DECIDABLE}
        self.made |= {f"_absent{r.places[n]}": r.absent(n) for n in r.layout} | {f"_seen{r.places[n]}": seen[n] for n in r.layout if seen}
        self.made["_digital"] = r.fact("digital", F.coalesce(pdf_type == "digital", F.lit(False)))

    def settled(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` and the flags of the rules; fields are no longer needed."""
        return settle(self.r.settled(df, *keep, *[c for c in ("hv", "form_type", "pdf_type") if c in df.columns and c not in keep]), **self.made).select(*keep, *self.made)

    def on(self, i: int) -> Column:
        return F.col(f"_on{i}")

    def first(self, i: int) -> Column:
        """Fires, and no rule before has raised the same code on the same field."""
        x = self.rules[i]
        before = [j for j in range(i) if (self.rules[j].code, self.rules[j].field) == (x.code, x.field)]
        return self.on(i) & ~_any(self.on(j) for j in before) if before else self.on(i)

    def total(self, wanted: Callable[[Raised], bool] = lambda x: True) -> Column:
        return _sum(self.on(i) for i, x in enumerate(self.rules) if wanted(x))

    def severity(self, name: str) -> Column:
        return self.total(lambda x: V.SEVERITY[x.code] == name)

    def split(self, bucket: str, code: str | None = None) -> Column:
        """Number of items that are ``fixable`` or for ``review``, of one code or of all."""
        items = [(i, x) for i, x in enumerate(self.rules) if x.field is not None and code in (None, x.code)]
        if bucket == "fixable":
            return _sum(self.first(i) & F.col(f"_fix{i}") for i, _ in items if f"_fix{i}" in self.made)
        return _sum(self.first(i) & ~F.col(f"_fix{i}") if f"_fix{i}" in self.made else self.first(i) for i, x in items if V.SEVERITY[x.code] != "INFO")

    def cents(self, name: str) -> Column:
        """Score of a field in whole hundredths."""
        raised = lambda severity: _any(self.on(i) for i, x in enumerate(self.rules) if x.field == name and V.SEVERITY[x.code] == severity)
        place = self.r.places[name]
        verified = F.col(f"_seen{place}") if f"_seen{place}" in self.made else None
        return F.rint(SC.ladder(verified, F.col(f"_absent{place}"), None, raised("BLOCKING"), None, raised("WARNING"), F.col("_digital")) * 100).cast("int")


def _sum(flags: Iterable[Column]) -> Column:
    out = F.lit(0)
    for c in flags:
        out = out + c.cast("int")
    return out.cast("bigint")


def verdicts(df: DataFrame, flags: Flags, keep: list[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Triage, counts, sizes of the split and score per document: what ``validate`` gives, without its arrays."""
    layout = flags.r.layout
    counts = {"n_total": flags.total(), **{f"n_{s.lower()}": flags.severity(s) for s in ("CRITICAL", "BLOCKING", "WARNING", "INFO")},
              **{f"n_{b}": flags.split(b) for b in ("fixable", "review")}}
    cents = {f"_cents{i}": flags.cents(n) for i, n in enumerate(layout)}
    d = flags.settled(df, *keep).select(*keep, *[c.alias(n) for n, c in (counts | cents).items()])
    confidence = SC.mean_score(sum((F.col(c) for c in cents), F.lit(0)).cast("bigint"), F.lit(len(layout)))
    low = _any(F.col(c) / 100 < t.review_field_score for c in cents)
    return d.select(
        *keep, F.when(F.col("n_critical") + F.col("n_blocking") > 0, "LOW").when(F.col("n_warning") > 0, "MEDIUM").otherwise("HIGH").alias("confidence"),
        *counts, confidence.alias("document_confidence"), ((confidence < t.review_document_score) | low).alias("needs_review"))


def review_hints(df: DataFrame, flags: Flags) -> DataFrame:
    """Review items per code and hint: one sum per code, added up in every task before anything is shuffled."""
    codes = list(dict.fromkeys(x.code for x in flags.rules))
    d = flags.settled(df).agg(*[F.sum(flags.split("review", c)).alias(c) for c in codes])
    hint = lambda c: F.lit(V.EDIT_HINTS.get(c, V.DEFAULT_HINT))
    rows = F.array(*[F.struct(F.lit(c).alias("code"), hint(c).alias("edit_hint"), F.col(c).alias("n")) for c in codes])
    return d.select(F.inline(rows)).where(F.col("n") > 0)
