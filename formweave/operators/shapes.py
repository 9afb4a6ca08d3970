"""Flat records of stored payloads by shape: what many payloads have in common is worked out once.

The shape of a payload is its text with the values masked: keys, nesting and kinds of values. Fields, their order, repeated keys and the
person's name depend on the shape alone, so each distinct shape is opened by ``flatten`` and gives a template, which says where the value of
each field stands among the values of the payload. Payloads meet their template by a join, and only their values are worked on. A payload
whose text is not plain JSON, or whose values cannot be told from its shape, is flattened by itself: the result is that of
``flatten_payload`` for every payload. A pass over the payloads stores their shapes and values in the shared folder, so this is for tables, not
for streams; payloads without a template are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import shared_dir
from . import json_tokens as JT
from .flatten import ORDINAL, _number_of, _typed, arranged, flatten_payload, with_nodes
from .records import settle

# on marked texts, where no string holds a quote; each match begins where the one before ended, so no pattern starts inside a string
_KEY = r'"[^"]*+"\s*+:'
_LIST = r'\[(?:[^"\[\]{}]++|"[^"]*+")*+\]'  # a list without containers is one value
_NUMBER = r"-?\d[^\s,\]}]*+"
_SKIPPED = rf'\G((?:[^"\[\d-]++|{_KEY}|""|(?!{_LIST})\[)*+)'
_VALUE = rf'({_LIST}|"[^"]++"|{_NUMBER})'
_MASK = r'"v"(?!\s*:)'
_PLACE = r"^[snl][0-9]+( s[0-9]+)?$"
_KEYS = ["_shape", "_kinds"]


def _with_shape(df: DataFrame, payload: str) -> DataFrame:
    """Add ``_shape``, ``_values`` (texts of the masked values in their order) and ``_kinds``, a letter for each; the shape is null where the
    values are no JSON."""
    text = F.col(payload)
    shape = F.regexp_replace(JT.marked(text), _SKIPPED + _VALUE, '$1"v"')
    df = settle(df, _shape=F.when(~text.rlike(r"[\x01\x02]"), shape), _found=F.regexp_extract_all(JT.marked(text), F.lit(_SKIPPED + _VALUE), F.lit(2)))
    listed = F.concat(F.lit("["), JT.written(F.array_join("_found", ",")), F.lit("]"))
    first = F.array_join(F.transform("_found", lambda x: F.left(x, F.lit(1))), "")
    df = settle(df, _values=F.from_json(listed, "array<string>"), _kinds=F.translate(first, '"[-0123456789', "slnnnnnnnnnnn"))
    return df.withColumn("_shape", F.when(F.size("_values") == F.length("_kinds"), F.col("_shape"))).drop("_found")


def _numbered(shape: Column, kinds: Column) -> Column:
    """The shape with kind and place of each masked value in its mask; null where their numbers differ."""
    parts = F.split(shape, _MASK)
    mark = lambda i: F.when(i < F.length(kinds), F.concat(F.lit('"'), kinds.substr(i + 1, F.lit(1)), i.cast("string"), F.lit('"'))).otherwise("")
    whole = JT.written(F.array_join(F.transform(parts, lambda p, i: F.concat(p, mark(i))), ""))
    return F.when(F.size(parts) == F.length(kinds) + 1, whole)


def _templates(shapes: DataFrame, keep_metadata: bool, extended_aliases: bool) -> DataFrame:
    """Shapes with their template, an array of (pos, field, kind, places, made, text); null where a shape is no JSON or hides a value."""
    d = settle(shapes, _text=_numbered(F.col("_shape"), F.col("_kinds")))
    d = settle(with_nodes(d, "_text", "_n"), _plain=F.coalesce(JT.is_valid(F.col("_text")), F.lit(False)))
    d = settle(d, _plain=F.col("_plain") & ~F.exists("_n", lambda x: x["kind"].isin("dict", "list")))
    kinds = F.create_map(*[F.lit(x) for x in ("s", "str", "n", "num", "l", "list")])
    d = settle(d, _n=F.transform("_n", lambda x: F.when(x["raw"].rlike(_PLACE), x.withField("kind", kinds[F.left(x["raw"], F.lit(1))])).otherwise(x)))

    def entry(x: Column, i: Column) -> Column:
        placed = F.coalesce(x["raw"].rlike(_PLACE), F.lit(False))
        places = F.transform(F.split(x["raw"], " "), lambda p: F.substring(p, 2, 10).cast("int"))
        return F.struct(i.alias("pos"), x["field"].alias("field"), x["kind"].alias("kind"), F.when(placed, places).alias("places"),
                        (x["group"] == "9" * ORDINAL).alias("made"), F.when(~placed, x["raw"]).alias("text"))

    return arranged(d, keep_metadata, extended_aliases).select(*_KEYS, F.when(F.col("_plain"), F.transform("_n", entry)).alias("template"))


def flatten_rows(df: DataFrame, *keep: str, payload: str = "payload", keep_metadata: bool = False, extended_aliases: bool = False) -> DataFrame:
    """Rows (pos, field, kind, s, d, b, nf) of the flat records of stored payloads: the fields of ``flatten_payload``, one per row."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "shapes")
    read = _with_shape(df.select(*keep, payload), payload)
    read.drop(payload).write.parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    _templates(docs.select(*_KEYS).distinct(), keep_metadata, extended_aliases).write.parquet(f"{path}/templates")
    stored = spark.read.parquet(f"{path}/templates")
    known = stored.where("_shape is not null and template is not null").select(*_KEYS, "template")

    rows = docs.join(known, _KEYS).select(*keep, "_values", F.explode("template").alias("t"))
    at = lambda i: F.get("_values", F.get("t.places", F.lit(i)))
    raw = F.when(F.col("t.made"), S.strip(F.concat_ws(" ", at(0), at(1)))).when(F.col("t.places").isNotNull(), at(0)).otherwise(F.col("t.text"))
    rows = settle(rows.select(*keep, F.struct("t.pos", "t.field", "t.kind", raw.alias("raw")).alias("n")), n=F.col("n"))
    rows = settle(rows, number=_number_of(F.col("n")))
    rows = rows.select(*keep, _typed(F.col("n"), F.col("number"), F.col("n.pos")).alias("x")).select(*keep, "x.*")
    if stored.where("_shape is null or template is null").isEmpty():
        return rows
    other = read.join(known.select(*_KEYS), _KEYS, "left_anti").select(*keep, payload)
    return rows.unionByName(flatten_payload(other, payload, keep_metadata, extended_aliases).select(*keep, F.explode("fields").alias("x")).select(*keep, "x.*"))
