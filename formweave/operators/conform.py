"""Typed schemas from form templates, and extractions conformed to them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

# fixed values: type names a template may use
TYPE_NAMES = ["verbatim-string", "string", "integer", "number", "boolean", "date", "datetime", "url", "email"]
_SPARK_TYPES = {
    "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "datetime": T.TimestampType(),
}


def typed_template(leaf: Any) -> Any:
    """Template with each leaf replaced by a type name."""
    if isinstance(leaf, dict):
        return {k: typed_template(v) for k, v in leaf.items()}
    if isinstance(leaf, list):
        return [typed_template(v) for v in leaf]
    for py, name in ((bool, "boolean"), (int, "integer"), (float, "number")):
        if isinstance(leaf, py):
            return name
    return leaf if isinstance(leaf, str) and leaf in TYPE_NAMES else "verbatim-string"


def spark_type(typed: Any) -> T.DataType:
    """Spark type of a typed template; a list takes the type of its first element."""
    if isinstance(typed, dict):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in typed.items()])
    if isinstance(typed, list):
        return T.ArrayType(spark_type(typed[0]) if typed else T.StringType())
    return _SPARK_TYPES.get(typed, T.StringType())


def template_schema(template: dict) -> T.StructType:
    return spark_type(typed_template(template))


def hyphenated(c: Column, key: str) -> Column:
    """Nine bare digits get their hyphens: as an EIN under employer/payer keys, else as an SSN."""
    k = key.lower()
    if "ssn" in k:
        pattern, shape = r"^([0-9]{3})([0-9]{2})([0-9]{4})$", "$1-$2-$3"
    elif "ein" in k or "tin" in k:
        if any(w in k for w in ("recipient", "employee", "partner_", "shareholder", "beneficiary", "taxpayer")):
            pattern, shape = r"^([0-9]{3})([0-9]{2})([0-9]{4})$", "$1-$2-$3"
        else:
            pattern, shape = r"^([0-9]{2})([0-9]{7})$", "$1-$2"
    else:
        return c
    return F.regexp_replace(S.strip(c), pattern, shape)


def _tidy(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_tidy_leaf(c[f.name], f.name, f.dataType) for f in dtype.fields]))
    return c


def _tidy_leaf(c: Column, name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return hyphenated(c, name).alias(name)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.transform(c, lambda x: _tidy(x, dtype.elementType)).alias(name)
    return _tidy(c, dtype).alias(name)


def conform(df: DataFrame, template: dict, payload: str = "payload", out: str = "data") -> DataFrame:
    """Parse a payload into the typed struct of its template in one pass.

    Keys outside the template are dropped, missing keys become null, a value of the wrong type becomes
    null while its siblings stay, and bare identifiers get hyphens. The unparsed keys are not lost:
    ``extra_keys`` lists the top-level keys the template does not know.
    """
    schema = template_schema(template)
    parsed = F.from_json(F.col(payload), schema)
    known = F.array(*[F.lit(k) for k in template])
    d = df.withColumn("_p", parsed)
    return d.withColumn(out, _tidy(F.col("_p"), schema)).withColumn(
        "extra_keys", F.array_except(F.json_object_keys(F.col(payload)), known)).drop("_p")


def template_leaves(template: dict, form_type: str) -> list[tuple[str, str, str, str, bool]]:
    """(form_type, path, key, type, is_list) of each leaf, for the template dimension."""
    out: list[tuple[str, str, str, str, bool]] = []

    def walk(node: Any, path: str, key: str, in_list: bool) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else k, k, in_list)
        elif isinstance(node, list):
            for v in node[:1]:
                walk(v, path, key, True)
        else:
            out.append((form_type, path, key, node, in_list))

    walk(typed_template(template), "", "", False)
    return out
