"""The flat record of a document: an ordered array of fields kept on the document row.

Keeping the fields on the row means that rules, classification and scoring are narrow
projections: a document never has to be re-assembled through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import split_methods

FIELD_TYPE = "struct<pos:int,field:string,kind:string,s:string,d:double,b:boolean,nf:boolean>"

# field name -> kind ('num', 'str', 'bool', 'mixed'), in field order, where every document has the same fields (a template, a wide table).
# Any value may be null. Rules over a layout are written out per field and compile; other records are walked by lambdas, which Spark interprets.
Layout = dict[str, str]


def field_struct(pos, name, kind: Column, s: Column, d: Column, b: Column, nf: Column | None = None) -> Column:
    """One field: position, name, kind (null/str/num/bool/list), text, lenient number, flag, numeric-name mark."""
    name_c = F.lit(name) if isinstance(name, str) else name
    pos_c = F.lit(pos) if isinstance(pos, int) else pos
    return F.struct(
        pos_c.cast("int").alias("pos"), name_c.alias("field"), kind.alias("kind"), s.alias("s"),
        d.cast("double").alias("d"), b.cast("boolean").alias("b"),
        (S.is_numeric_field(name_c) if nf is None else nf).alias("nf"),
    )


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _parts(kind: str, cols: list[Column]) -> dict[str, Column]:
    """Kind, text, lenient number and flag of a field of typed columns."""
    if kind == "num":
        c = cols[0]
        return {"kind": F.when(c.isNull(), "null").otherwise("num"), "s": S.plain_number_text(c.cast("double")), "d": c.cast("double"), "b": _null("boolean")}
    if kind == "str":
        c = cols[0]
        return {"kind": F.when(c.isNull(), "null").otherwise("str"), "s": c, "d": S.lenient_number(c), "b": _null("boolean")}
    if kind == "bool":
        c = cols[0]
        return {"kind": F.when(c.isNull(), "null").otherwise("bool"), "s": F.when(c, "True").when(~c, "False"), "d": _null("double"), "b": c}
    if kind == "mixed":
        n, t = cols
        return {
            "kind": F.when(t.isNotNull(), "str").when(n.isNotNull(), "num").otherwise("null"),
            "s": F.coalesce(t, S.plain_number_text(n.cast("double"))),
            "d": F.when(t.isNotNull(), S.lenient_number(t)).otherwise(n.cast("double")), "b": _null("boolean"),
        }
    raise ValueError(f"unknown field kind {kind!r}")


def from_columns(spec: list[tuple]) -> Column:
    """Field array from typed columns.

    ``spec`` entries are (name, 'num', col), (name, 'str', col), (name, 'bool', col),
    (name, 'mixed', number_col, text_col) or (name, 'optional', present_col, kind, col): the last one
    leaves the key out where ``present_col`` is false.
    """
    out, may_drop = [], False
    for i, item in enumerate(spec):
        name, kind, *cols = item
        if kind == "optional":
            present, kind, *cols = cols
            may_drop = True
        else:
            present = None
        x = _parts(kind, cols)
        v = field_struct(i, name, x["kind"], x["s"], x["d"], x["b"], F.lit(has_numeric_name(name)))
        out.append(v if present is None else F.when(present, v))
    arr = F.array(*out)
    return F.filter(arr, lambda x: x.isNotNull()) if may_drop else arr


def has_numeric_name(name: str) -> bool:
    return name.endswith(tuple(S.V.NUMERIC_SUFFIXES))


def may_be_text(kind: str) -> bool:
    return kind in ("str", "mixed")


def field_map(fields: Column) -> Column:
    """name -> field struct. Names are unique by construction of the flat record."""
    return F.map_from_arrays(fields["field"], fields)


class Parts:
    """One field of a flat record: its parts are columns, which the record notes."""

    def __init__(self, record: Record, name: str):
        self.record, self.name = record, name

    def __getitem__(self, part: str) -> Column:
        return F.col(self.record.parts.setdefault((self.name, part), f"_{part}{self.record.places[self.name]}"))


class Record:
    """Reads fields of the flat record by name.

    Rules read the same few fields many times. A record made with ``slots=True`` notes which fields and
    derived facts its rules use; ``settled`` then computes each of them once per row, in columns of their
    own, before the rules run. Without slots, fields come straight from the field-map column. With a layout ``m`` is the field array,
    and a field is read at its place. A flat record, of typed ``columns`` as ``from_columns`` takes them, has no field array: the parts of
    fields that its rules read, and the facts, become columns.
    """

    def __init__(self, m: Column | None, slots: bool = False, layout: Layout | None = None, columns: list[tuple] | None = None):
        self.flat = columns is not None
        self.columns = {name: (kind, cols) for name, kind, *cols in columns or []}
        self.m, self.slots, self.layout = m, slots or self.flat, {n: k for n, (k, _) in self.columns.items()} if self.flat else layout
        layout = self.layout
        self.places = {n: i for i, n in enumerate(layout or {})}
        self.names: dict[str, None] = {}
        self.parts: dict[tuple[str, str], str] = {}
        self.facts: dict[str, Column] = {}

    def raw(self, name: str | Column) -> Column | Parts:
        if self.flat and name in self.places:
            return Parts(self, name)
        if self.layout is not None:
            if not isinstance(name, str):
                return field_map(self.m)[name]
            return F.get(self.m, F.lit(self.places[name])) if name in self.places else F.lit(None).cast(FIELD_TYPE)
        if self.slots and isinstance(name, str):
            self.names[name] = None
            return F.col("_slots")[name]
        return self.m[name]

    def fact(self, label: str, value: Column) -> Column:
        """A derived value used by several rules; computed once per row when slots are on."""
        if not self.slots:
            return value
        self.facts.setdefault(label, value)
        return F.col(f"_fact{list(self.facts).index(label)}") if self.flat else F.col("_facts")[label]

    def settled(self, df: DataFrame, *keep: str) -> DataFrame:
        """Add the noted fields and facts to rows that hold the field map in ``_m``; of a flat record, to the columns ``keep``."""
        if self.flat:
            made = {n: _parts(kind, cols) for n, (kind, cols) in self.columns.items()}
            read = df.select(*keep, *[made[n][part].alias(c) for (n, part), c in self.parts.items()])
            return settle(read, **{f"_fact{i}": c for i, c in enumerate(self.facts.values())})
        if self.names:
            df = settle(df, _slots=F.struct(*[self.m[n].alias(n) for n in self.names]))
        if self.facts:
            df = settle(df, _facts=F.struct(*[c.alias(n) for n, c in self.facts.items()]))
        return df

    def is_num(self, name: str) -> bool:
        """Is the field a number or null in every document?"""
        return self.layout is not None and self.layout.get(name) == "num"

    def is_text(self, name: str) -> Column:
        return self.text(name).isNotNull() if self.layout and self.layout.get(name) == "str" else self.raw(name)["kind"] == "str"

    def absent(self, name: str) -> Column:
        part = {"num": "d", "str": "s", "bool": "b"}.get(self.layout.get(name)) if self.layout else None
        return self.raw(name)[part].isNull() if part else self.raw(name)["kind"] == "null"

    def num(self, name: str | Column) -> Column:
        return self.raw(name)["d"]

    def text(self, name: str | Column) -> Column:
        return self.raw(name)["s"]

    def num0(self, name: str) -> Column:
        return F.coalesce(self.num(name), F.lit(0.0))

    def stripped(self, name: str) -> Column:
        return self.fact(f"text:{name}", S.strip(self.text(name)))

    def blank(self, name: str) -> Column:
        return F.coalesce(S.strip(self.text(name)), F.lit("")) == ""

    def value(self, name: str | Column) -> Column:
        """Text of the field only where it is not a number."""
        x = self.raw(name)
        return F.when(x["kind"] != "num", x["s"])

    def number(self, name: str | Column) -> Column:
        """Number of the field only where it is stored as one."""
        x = self.raw(name)
        return F.when(x["kind"] == "num", x["d"])

    def truthy(self, name: str) -> Column:
        if self.is_num(name):
            return F.coalesce(self.num(name) != 0, F.lit(False))
        x = self.raw(name)
        yes = (
            F.when(x["kind"] == "bool", x["b"]).when(x["kind"] == "num", x["d"] != 0)
            .when(x["kind"].isin("str", "list"), F.length(x["s"]) > 0).otherwise(F.lit(False))
        )
        return F.coalesce(yes, F.lit(False))

    def first_truthy_text(self, *names: str) -> Column:
        return F.coalesce(*[F.when(self.truthy(n), self.text(n)) for n in names])


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a one-row ``inline``.

    The optimizer copies the definition of a projected column into every filter and projection that
    uses it; for rule arrays that would repeat the whole rule set per use. Values that come out of a
    generator are computed once per row and stay in the same stage. The values are projected first and the
    generator only hands them on: a projection compiles, while what stands inside a generator may be interpreted.
    """
    split_methods(df.sparkSession)
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, row.alias("_row")).select(*keep, F.inline_outer(F.array("_row")))


def to_long(df: DataFrame, *keep: str) -> DataFrame:
    """One row per field of each document (map-side explode, no shuffle)."""
    return df.select(*keep, F.explode("fields").alias("x")).select(*keep, "x.*")
