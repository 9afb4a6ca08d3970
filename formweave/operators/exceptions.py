"""Exception rows raised by rules, and the registry they refer to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalar as S

EXC_TYPE = "struct<code:string,severity:string,field:string,value:string,value_num:double>"


def exc(code: str, field=None, value: Column | None = None, num: Column | None = None) -> Column:
    """Struct of one exception. The severity is constant per code and needs no lookup."""
    f = field if isinstance(field, Column) else F.lit(field).cast("string")
    return F.struct(
        F.lit(code).alias("code"), F.lit(V.SEVERITY[code]).alias("severity"), f.alias("field"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
        (F.lit(None) if num is None else num).cast("double").alias("value_num"),
    )


def empty() -> Column:
    return F.array().cast(f"array<{EXC_TYPE}>")


def when_raised(cond: Column, e: Column) -> Column:
    """One-element array where the condition holds, an empty one otherwise (also for a null condition).

    Rules are arrays that get concatenated: ``concat`` and CASE compile to Java code, while filtering an
    array of nullable structs would run every rule below it interpreted.
    """
    return F.when(cond, F.array(e)).otherwise(empty())


class Raised(NamedTuple):
    """A rule of one code that raises at most one exception. Kept in parts, so that it can be an array or just a flag."""

    cond: Column
    code: str
    field: str | Column | None = None
    value: Column | None = None
    num: Column | None = None

    def array(self) -> Column:
        return when_raised(self.cond, exc(self.code, self.field, self.value, self.num))

    def where(self, cond: Column) -> Raised:
        return self._replace(cond=cond & self.cond)


def raised(cond: Column, code: str, field=None, value: Column | None = None, num: Column | None = None) -> Raised:
    return Raised(cond, code, field, value, num)


def raised_one_of(code: Column, candidates: list[str], field=None, value: Column | None = None) -> Column:
    """Exception whose code is one of a few candidates decided per row; a null code raises nothing."""
    out = F
    for c in candidates:
        out = out.when(code == c, F.array(exc(c, field, value)))
    return out.otherwise(empty())


def raised_each(items: Column, make) -> Column:
    """One exception per element of an array; a null array raises nothing."""
    return F.coalesce(F.transform(items, make), empty())


def concat(items: list[Column | Raised]) -> Column:
    arrays = [x.array() if isinstance(x, Raised) else x for x in items]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def registry(spark: SparkSession) -> DataFrame:
    """The 90-row registry as a table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(V.REGISTRY, "code string, category string, exception string, handling string, severity string")


def explode_exceptions(df: DataFrame, *keep: str, column: str = "exceptions") -> DataFrame:
    """One row per exception with its order inside the document."""
    # the outer form keeps the optimizer from adding a size filter that would evaluate every rule twice
    long = df.select(*keep, F.posexplode_outer(column).alias("ord", "e"))
    return long.where(F.col("e").isNotNull()).select(*keep, "ord", "e.*")


def enrich(long: DataFrame) -> DataFrame:
    """Add category, name, handling and a readable description."""
    reg = registry(long.sparkSession).drop("severity")
    shown = F.coalesce(F.col("value"), S.plain_number_text(F.col("value_num")))
    return long.join(F.broadcast(reg), "code", "left").withColumn(
        "description",
        F.concat(
            F.col("exception"),
            F.coalesce(F.concat(F.lit(" in "), F.col("field")), F.lit("")),
            F.coalesce(F.concat(F.lit(": "), shown), F.lit("")),
            F.lit(". "), F.col("handling"), F.lit("."),
        ),
    )


# --- document level ---------------------------------------------------------------------------------
def count_severity(excs: Column, severity: str) -> Column:
    return F.size(F.filter(excs, lambda e: e["severity"] == severity)).cast("bigint")


def triage(excs: Column) -> Column:
    """LOW with any CRITICAL or BLOCKING exception, MEDIUM with a WARNING, HIGH otherwise."""
    sev = F.transform(excs, lambda e: e["severity"])
    return (
        F.when(F.arrays_overlap(sev, F.array(F.lit("CRITICAL"), F.lit("BLOCKING"))), F.lit("LOW"))
        .when(F.array_contains(sev, "WARNING"), F.lit("MEDIUM")).otherwise(F.lit("HIGH"))
    )


def error_list(excs: Column) -> Column:
    """Readable lines of everything above INFO, in rule order (name, field and value)."""
    names = F.create_map(*[F.lit(x) for row in V.REGISTRY for x in (row[0], row[2])])
    return F.transform(
        F.filter(excs, lambda e: e["severity"] != "INFO"),
        lambda e: F.concat(
            F.element_at(names, e["code"]), F.coalesce(F.concat(F.lit(" in "), e["field"]), F.lit("")),
            F.coalesce(F.concat(F.lit(": "), F.coalesce(e["value"], S.plain_number_text(e["value_num"]))), F.lit("")),
        ),
    )


def suppress_verified(excs: Column, verified: Column) -> Column:
    """Drop exceptions on human-verified fields; exceptions without a field stay."""
    return F.when(F.coalesce(F.size(verified), F.lit(0)) <= 0, excs).otherwise(
        F.filter(excs, lambda e: ~F.coalesce(F.array_contains(verified, e["field"]), F.lit(False)))
    )


def summarise(df: DataFrame, *keep: str) -> DataFrame:
    """Per-document counts and triage from the nested exceptions, without a shuffle."""
    e = F.col("exceptions")
    return df.select(
        *keep, F.size(e).cast("bigint").alias("n_total"),
        *[count_severity(e, s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "BLOCKING", "WARNING", "INFO")],
        triage(e).alias("confidence"),
    )
