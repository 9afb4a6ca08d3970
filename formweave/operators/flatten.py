"""Nested JSON payloads to flat records, as a narrow projection.

Every nesting level is opened in place with ``from_json``: a ``map<string,string>`` view keeps the
document order and the raw text of nested values, a ``map<string,variant>`` view of the same text
keeps the kind of scalars. Nothing is exploded or shuffled, so a document of any size stays one row.
``LEVELS`` levels are opened so. The few payloads that then still hold a container are read again from their tokens with a stack of
open containers (``json_tokens``), inside the same projection: nesting changes neither the plan nor the other rows, and no payload
is looked at before the plan is built. Of a repeated key the last value counts, at the place of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalar as S
from . import json_tokens as JT
from .records import field_struct, settle

LEVELS = 5  # nesting that is opened level by level; deeper payloads take the stack
ORDINAL = 10  # digits of an entry's number in its group: as many as the largest array index has
NODE_TYPE = "struct<path:string,prefix:string,key:string,field:string,group:string,raw:string,kind:string>"
_NOT_ONLY_TEXT = list("{[-+.0123456789tfnNI")  # first characters of containers, numbers and bare words
_COERCE_RE = r"^\$?-?[0-9,]+\.?[0-9]*$"


def bare_key(key: Column) -> Column:
    """Key without its box prefix; a key that is only a box number is kept."""
    cut = F.regexp_replace(F.regexp_replace(key, r"^box_[0-9A-Za-z]+_", ""), r"^box_[0-9A-Za-z]+$", "")
    return F.when(~key.startswith("box_") | (cut == ""), key).otherwise(cut)


def _kind_of(v: Column) -> Column:
    def name(s: Column) -> Column:
        return (
            F.when(s == "STRING", "str").when(s.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool")
            .when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list").otherwise("num"))

    return S.let(F.schema_of_variant(v), name)


def _kind(raw: Column, v: Column) -> Column:
    """Kind of a value. Text that starts like no other kind is a string; only the rest has its variant looked at."""
    return F.when(raw.isNull(), "null").when(~F.left(raw, F.lit(1)).isin(*_NOT_ONLY_TEXT), "str").otherwise(_kind_of(v))


def _ordinal(i: Column) -> Column:
    return F.lpad((i + 1).cast("string"), ORDINAL, "0")


def keep_last(a: Column, key) -> Column:
    """One entry per key: place of the first, value of the last. Entries are sorted once, only where a key repeats."""

    def picked(ordered: Column) -> Column:
        firsts = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["k"] != x["k"]))
        lasts = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["k"] != x["k"]))
        places = F.array_sort(F.zip_with(firsts, lasts, lambda f, last: F.struct(f["i"].alias("f"), last["i"].alias("l"))))
        return F.transform(places, lambda x: F.get(a, x["l"]))

    tagged = F.transform(a, lambda n, i: F.struct(key(n).alias("k"), i.alias("i")))
    unique = F.size(F.array_distinct(F.transform(a, key))) == F.size(a)
    return F.when(unique, a).otherwise(S.let(F.array_sort(tagged), picked))


def _with_kind(texts: Column, variants: Column) -> Column:
    """Pair raw values with their kinds; both sides are parsed once."""
    return F.zip_with(texts, variants, lambda e, v: F.struct(e.alias("e"), _kind(e, v).alias("kind")))


def _unique_keys(m: Column) -> Column:
    """The map with one entry per key, the last value at the place of the first."""
    return F.map_from_entries(keep_last(F.map_entries(m), lambda e: e["key"]))


def _open_object(raw: Column, path: Column, prefix: Column, group: Column) -> Column:
    """Entries of one JSON object in document order. Both views of the text are parsed once, and an entry is made in one pass."""
    def node(k: Column, i: Column, texts: Column, variants: Column) -> Column:
        value = F.get(texts, i)
        return F.struct(
            F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)).alias("path"),
            prefix.alias("prefix"), k.alias("key"), F.concat(prefix, bare_key(k)).alias("field"),
            F.concat(group, _ordinal(i)).alias("group"),
            value.alias("raw"), _kind(value, F.get(variants, i)).alias("kind"),
        )

    def nodes(view: Column) -> Column:
        return F.transform(F.map_keys(view["t"]), lambda k, i: node(k, i, F.map_values(view["t"]), F.map_values(view["v"])))

    def unique(view: Column) -> Column:
        keys = F.map_keys(view["t"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), view).otherwise(
            F.struct(_unique_keys(view["t"]).alias("t"), _unique_keys(view["v"]).alias("v")))

    parsed = F.struct(F.from_json(raw, "map<string,string>").alias("t"), F.from_json(raw, "map<string,variant>").alias("v"))
    return S.let(S.let(parsed, unique), nodes)


def _list_of_objects(raw: Column) -> Column:
    return raw.rlike(r"^\[\s*\{")


def _open_list(raw: Column, path: Column, field: Column, group: Column) -> Column:
    """Entries of the objects in a list; an item that is not an object adds nothing."""
    none = F.array().cast(f"array<{NODE_TYPE}>")
    return F.flatten(F.transform(F.from_json(raw, "array<string>"), lambda it, i: F.coalesce(_open_object(
        it, F.concat_ws(".", F.nullif(path, F.lit("")), i.cast("string")),
        F.concat(field, F.lit("_"), i.cast("string"), F.lit("_")),
        F.concat(group, F.lit("-"), _ordinal(i), F.lit("."))), none)))


def _step(nodes: Column, lists_of_scalars: bool) -> Column:
    """Replace container nodes by their entries, keep everything else in place."""
    none = F.array().cast(f"array<{NODE_TYPE}>")

    def open_scalars(n: Column) -> Column:
        items = _with_kind(F.from_json(n["raw"], "array<string>"), F.from_json(n["raw"], "array<variant>"))
        return F.transform(items, lambda x, i: F.struct(
            F.concat_ws(".", n["path"], i.cast("string")).alias("path"),
            n["prefix"].alias("prefix"),
            n["key"].alias("key"), n["field"].alias("field"), n["group"].alias("group"), x["e"].alias("raw"),
            x["kind"].alias("kind")))

    def expand(n: Column) -> Column:
        c = F.when(n["kind"] == "dict", F.coalesce(_open_object(
            n["raw"], n["path"], n["prefix"], F.concat(n["group"], F.lit("."))), none))
        c = c.when((n["kind"] == "list") & _list_of_objects(n["raw"]), F.coalesce(_open_list(n["raw"], n["path"], n["field"], n["group"]), none))
        if lists_of_scalars:
            c = c.when(n["kind"] == "list", F.coalesce(open_scalars(n), none))
        return c.otherwise(F.array(n))

    opened = F.flatten(F.transform(nodes, expand))
    again = F.exists(nodes, lambda n: _still_open(n, lists_of_scalars))
    return F.when(again, opened).otherwise(nodes)


def _still_open(n: Column, lists_of_scalars: bool) -> Column:
    return (n["kind"] == "dict") | ((n["kind"] == "list") & (F.lit(True) if lists_of_scalars else _list_of_objects(n["raw"])))


def _deep_nodes(raw: Column, lists_of_scalars: bool) -> Column:
    """The same leaves from the tokens of the payload; raw values and kinds come from one parse of all leaves."""
    def valued(leaves: Column) -> Column:
        shown = F.transform(leaves, lambda x: F.when(JT.is_deep(x["text"]), F.lit("[]")).otherwise(x["text"]))
        texts = F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))
        values = _with_kind(F.from_json(texts, "array<string>"), F.from_json(texts, "array<variant>"))
        return F.zip_with(leaves, values, lambda x, v: F.struct(
            x["path"].alias("path"), x["prefix"].alias("prefix"), x["key"].alias("key"), x["field"].alias("field"), x["group"].alias("group"),
            F.when(JT.is_deep(x["text"]), x["text"]).otherwise(v["e"]).alias("raw"), v["kind"].alias("kind")))

    return S.let(JT.leaves(raw, _ordinal, bare_key, lists_of_scalars), valued)


def with_nodes(df: DataFrame, payload: str = "payload", out: str = "nodes", lists_of_scalars: bool = False, levels: int = LEVELS) -> DataFrame:
    """Leaves of the payload in depth-first order, whatever its nesting. One projection per level keeps each expression small.

    A payload that is a list is opened like a field ``item``; one that is no JSON has no leaves.
    """
    # of a repeated key inside a nested object, the last counts
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    none = F.array().cast(f"array<{NODE_TYPE}>")
    top = lambda x: [F.lit(v) for v in x]
    df = settle(df, _deep=JT.is_deep(F.col(payload)))
    raw = F.when(~F.col("_deep"), F.col(payload))
    root = F.when(raw.rlike(r"^\s*\["), _open_list(raw, *top(("", "item", "")))).otherwise(_open_object(raw, *top(("", "", ""))))
    # settled per level: a level refers to the one below several times
    df = settle(df, **{out: F.coalesce(root, none)})
    for _ in range(levels - 1):
        df = settle(df, **{out: _step(F.col(out), lists_of_scalars)})
    deeper = F.exists(out, lambda n: _still_open(n, lists_of_scalars))
    stack = F.when(F.col("_deep"), JT.follows_grammar(F.col(payload))).otherwise(deeper)
    return settle(df, **{out: F.when(stack, F.coalesce(_deep_nodes(F.col(payload), lists_of_scalars), none)).otherwise(F.col(out))}).drop("_deep")


def _number_of(n: Column) -> Column:
    """Number of a leaf: a JSON number, or text that looks like an amount."""
    text = S.strip(n["raw"])
    return F.when((n["kind"] == "str") & text.rlike(_COERCE_RE), F.regexp_replace(text, "[$,]", "").try_cast("double")).when(
        n["kind"] == "num", n["raw"].try_cast("double"))


def _typed(n: Column, number: Column, pos: Column) -> Column:
    """Field struct of a leaf whose number was worked out beforehand."""
    k = n["kind"]
    is_num, is_list = number.isNotNull(), k.isin("dict", "list")
    kind = F.when(is_num, "num").when(is_list, "list").otherwise(k)
    shown = (
        F.when(k == "null", F.lit(None).cast("string"))
        .when(k == "bool", F.when(n["raw"] == "true", "True").otherwise("False"))
        .when((k == "num") | ~is_num, n["raw"]).otherwise(S.plain_number_text(number))
    )
    lenient = S.let(n["raw"], S.lenient_number)
    return field_struct(pos, n["field"], kind, shown, F.when((k == "str") & ~is_num, lenient).otherwise(number),
                        F.when(k == "bool", n["raw"] == "true"))


def _last_wins(nodes: Column) -> Column:
    """One node per field: first position, last value."""
    return S.let(nodes, lambda a: keep_last(a, lambda n: n["field"]))


def _with_person_name(nodes: Column) -> Column:
    """Add or replace employee_name from the first and last name."""

    def get(a: Column, name: str) -> Column:
        hit = F.try_element_at(F.filter(a, lambda n: (n["field"] == name) & (n["kind"] == "str") & (n["raw"] != "")), F.lit(1))
        return hit["raw"]

    def made(full: Column) -> Column:
        return F.struct(
            F.lit("employee_name").alias("path"), F.lit("").alias("prefix"), F.lit("employee_name").alias("key"),
            F.lit("employee_name").alias("field"), F.lit("9" * ORDINAL).alias("group"), full.alias("raw"), F.lit("str").alias("kind"))

    def put(a: Column, full: Column) -> Column:
        exists = F.exists(a, lambda n: n["field"] == "employee_name")
        swapped = F.transform(a, lambda n: F.when(n["field"] == "employee_name", made(full)).otherwise(n))
        return F.when(full.isNull(), a).when(exists, swapped).otherwise(F.concat(a, F.array(made(full))))

    def full_name(a: Column) -> Column:
        first, last = get(a, "employee_first_name"), get(a, "employee_last_name")
        return F.when(first.isNotNull() | last.isNotNull(), S.strip(F.concat_ws(" ", first, last)))

    return S.let(full_name(nodes), lambda full: put(nodes, full))


def _renamed(nodes: Column, aliases: dict[str, str]) -> Column:
    """Rename aliased fields; a renamed field moves to the end unless the new name is present."""
    names = F.array(*[F.lit(a) for a in aliases])
    to = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])

    def by_alias_order(found: Column) -> Column:
        ordered = F.flatten(F.transform(names, lambda a: F.filter(found, lambda n: n["field"] == a)))
        return F.transform(ordered, lambda n: n.withField("field", F.element_at(to, n["field"])))

    def apply(found: Column) -> Column:
        kept = F.filter(nodes, lambda n: ~F.array_contains(names, n["field"]))
        return F.when(F.size(found) > 0, _last_wins(F.concat(kept, by_alias_order(found)))).otherwise(nodes)

    return S.let(F.filter(nodes, lambda n: F.array_contains(names, n["field"])), apply)


def arranged(d: DataFrame, keep_metadata: bool = False, extended_aliases: bool = False) -> DataFrame:
    """The leaves in ``_n`` as the nodes of the flat record: one per field, with the person's name, under the names of the rules."""
    aliases = {**V.FIELD_ALIASES, **(V.EXTENDED_ALIASES if extended_aliases else {})}
    n = F.col("_n")
    if not keep_metadata:
        d = settle(d, _n=F.filter(n, lambda x: ~x["path"].startswith("extraction_metadata.")))
    d = settle(d, _n=_last_wins(n))
    d = settle(d, _n=_with_person_name(n))
    return settle(d, _n=_renamed(n, aliases))


def flatten_payload(df: DataFrame, payload: str = "payload", keep_metadata: bool = False,
                    extended_aliases: bool = False, strict_ids: bool = False) -> DataFrame:
    """Add ``fields`` (the flat record) for a JSON payload column.

    ``keep_metadata=True`` lets ``extraction_metadata`` overwrite data fields of the same name, as the
    studied system does; by default that branch is left out. ``strict_ids=True`` keeps zip codes,
    account and control numbers and identifiers as text.
    """
    d = arranged(with_nodes(df, payload, "_n"), keep_metadata, extended_aliases)
    n = F.col("_n")

    def number(x: Column) -> Column:
        value = _number_of(x)
        if strict_ids:
            is_id = x["field"].rlike("(zip|zip_code|_ssn|_tin|tax_id|number)$") & (x["kind"] == "str")
            value = F.when(~is_id, value)
        return F.struct(x.alias("n"), value.alias("number"))

    # two small passes: the number of each leaf first, then the field around it; settled, as a filter on the fields would work them out again
    return settle(d, fields=F.transform(F.transform(n, number), lambda x, i: _typed(x["n"], x["number"], i))).drop("_n")


def dotted_leaves(df: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """Rows (path, raw, kind) with full dotted paths; list items carry their index."""
    d = with_nodes(df, payload, "_n", lists_of_scalars=True)
    return d.select(*keep, F.explode("_n").alias("n")).select(
        *keep, F.col("n.path").alias("path"), F.col("n.raw").alias("raw"), F.col("n.kind").alias("kind"))


# --- names and identities inside a payload ------------------------------------------------------------------
def _ends_with_any(k: Column, suffixes: list[str]) -> Column:
    return k.rlike("(" + "|".join(suffixes) + ")$")


def find_name(nodes: Column) -> Column:
    """First client name of a payload in depth-first order of its objects.

    Inside one object the order is: client-name keys, then first plus last name, then entity-name keys.
    An object is identified by the group path of its entries, so list items never take part.
    """
    def usable(n: Column) -> Column:
        k = F.lower(n["key"])
        named = (k == "name") | k.endswith("_name") | _ends_with_any(k, V.CLIENT_NAME_SUFFIXES + V.ENTITY_NAME_SUFFIXES)
        return ~n["group"].contains("-") & named

    # only the few name-like fields take part in the steps below
    return S.let(F.filter(nodes, usable), _first_name)


def _first_name(own: Column) -> Column:
    text = F.filter(own, lambda n: (n["kind"] == "str") & (S.strip(n["raw"]) != ""))

    def container(n: Column) -> Column:
        # groups are ordinals per level: the container is everything before the last one
        return F.regexp_replace(n["group"], r"[0-9]+$", "")

    def ranked(prio: int, hits: Column) -> Column:
        return F.transform(hits, lambda n: F.struct(
            container(n).alias("c"), F.lit(prio).alias("p"), n["group"].alias("g"), S.strip(n["raw"]).alias("v")))

    client = ranked(1, F.filter(text, lambda n: (F.lower(n["key"]) == "name") | _ends_with_any(F.lower(n["key"]), V.CLIENT_NAME_SUFFIXES)))
    entity = ranked(5, F.filter(text, lambda n: _ends_with_any(F.lower(n["key"]), V.ENTITY_NAME_SUFFIXES)))
    def people(i: int, prefix: str) -> Column:
        firsts = F.filter(own, lambda n: F.lower(n["key"]).endswith(f"{prefix}_first_name"))
        lasts = F.filter(own, lambda n: F.lower(n["key"]).endswith(f"{prefix}_last_name"))

        def pair(f: Column) -> Column:
            # the last key of each kind inside the object counts
            other = F.try_element_at(F.filter(lasts, lambda x: container(x) == container(f)), F.lit(-1))
            newest = F.try_element_at(F.filter(firsts, lambda x: container(x) == container(f)), F.lit(-1))
            ok = (newest["group"] == f["group"]) & (f["kind"] == "str") & (other["kind"] == "str") & (S.strip(f["raw"]) != "") & (S.strip(other["raw"]) != "")
            return F.when(ok, F.struct(container(f).alias("c"), F.lit(2 + i).alias("p"), f["group"].alias("g"),
                                       F.concat_ws(" ", S.strip(f["raw"]), S.strip(other["raw"])).alias("v")))

        return F.filter(F.transform(firsts, pair), lambda x: x.isNotNull())

    pairs = [people(i, p) for i, p in enumerate(V.PERSON_PREFIXES)]
    every = F.concat(client, *pairs, entity)
    return F.when(F.size(every) > 0, F.array_min(every)["v"])


def client_identity(nodes: Column) -> Column:
    """struct<name,tin> of the first object that names a client or an identifier, depth first."""
    text = F.filter(nodes, lambda n: (n["kind"] == "str") & (n["raw"] != ""))

    def container(n: Column) -> Column:
        return F.regexp_replace(n["group"], r"[0-9]+$", "")

    names = F.transform(F.filter(text, lambda n: (F.lower(n["key"]) == "name") | _ends_with_any(
        F.lower(n["key"]), V.CLIENT_NAME_SUFFIXES + V.ENTITY_NAME_SUFFIXES)),
        lambda n: F.struct(container(n).alias("c"), n["group"].alias("g"), S.strip(n["raw"]).alias("v")))
    tins = F.transform(F.filter(text, lambda n: F.lower(n["key"]).isin(V.IDENTITY_TIN_FIELDS)),
                       lambda n: F.struct(container(n).alias("c"), n["group"].alias("g"), S.strip(n["raw"]).alias("v")))
    where = F.least(F.array_min(names)["c"], F.array_min(tins)["c"])
    return F.when(where.isNotNull(), F.struct(
        F.array_min(F.filter(names, lambda x: x["c"] == where))["v"].alias("name"),
        F.array_min(F.filter(tins, lambda x: x["c"] == where))["v"].alias("tin")))


def normalise_form_type(raw: Column, available: list[str] | None = None) -> Column:
    """Canonical form type of a detected one.

    The list of form types is a fixed, small vocabulary, so the substring step is a CASE over it
    rather than a join.
    """
    forms = sorted(available or V.FORM_TYPES)
    u = F.upper(raw)
    exact = F.element_at(F.create_map(*[F.lit(x) for f in forms for x in (f.upper(), f)]), u)
    inside = None
    for f in forms:
        cond = u.contains(f.upper())
        inside = F.when(cond, F.lit(f)) if inside is None else inside.when(cond, F.lit(f))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
        .when(exact.isNotNull(), exact)
        .when(u.contains("K-1") | u.contains("1065"), F.lit("K-1 (1065)"))
        .when(u.contains("W2") | u.contains("W-2"), F.lit("W-2"))
        .otherwise(F.coalesce(inside, u))
    )
