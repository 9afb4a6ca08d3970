"""JSON text as an array of tokens on the row: leaves of payloads of any nesting, and payloads put together again after a patch.

A payload is cut into brackets, commas, colons, strings and bare words by one pattern without backtracking. ``leaves`` walks the
tokens once with a stack of open containers, so nesting costs a deeper stack and neither a larger plan nor another pass. ``rebuilt``
copies the tokens and puts new values in place of old ones, so order, numbers and untouched parts stay as they are.

The engine's own JSON parser calls itself for each level and can end the JVM on a text of many open brackets, JSON or not. Texts that nest
more than ``SAFE`` deep are therefore never given to it: their grammar is checked on the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar as S

SAFE = 64
_BACKSLASH, _QUOTE = "\x01", "\x02"
_TOKEN = r'"[^"]*+"|[\[\]{},:]|[^\s\[\]{},:"]++|"'
_FRAME = "struct<kind:string,path:string,prefix:string,key:string,field:string,group:string,n:int,text:string>"
_LEAF = "struct<path:string,prefix:string,key:string,field:string,group:string,text:string>"
_NAMED = "struct<c:string,k:string,g:string>"


def marked(text: Column) -> Column:
    """JSON text in which no string holds a quote: escaped backslashes and quotes are marked by control characters, which JSON does not have
    as they are; ``written`` puts them back."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def tokens(text: Column) -> Column:
    """Tokens of a JSON text as ``marked``."""
    return F.regexp_extract_all(marked(text), F.lit(_TOKEN), F.lit(0))


def written(text: Column) -> Column:
    """Text of tokens as it was in the payload."""
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def nesting(text: Column) -> Column:
    """How deep the brackets of a text go; brackets inside strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"', "")
    marks = F.regexp_replace(bare, r"[^\[\]{}]++", "")

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    return F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda state: state["top"])


def is_deep(text: Column) -> Column:
    """Whether the text nests more than SAFE deep; few texts have so many brackets, and only those are measured."""
    brackets = F.length(text) - F.length(F.replace(F.replace(text, F.lit("{"), F.lit("")), F.lit("["), F.lit("")))
    return F.coalesce(F.when(brackets > SAFE, nesting(text) > SAFE), F.lit(False))


def follows_grammar(text: Column) -> Column:
    """Whether the tokens of the text are one JSON value. Escapes inside strings are not looked at."""
    def step(state: Column, t: Column) -> Column:
        prev, stack = state["prev"], state["stack"]
        inner = F.right(stack, F.lit(1))
        value = (prev == "start") | prev.isin("[", ":") | ((prev == ",") & (inner == "["))
        in_key = (inner == "{") & prev.isin("{", ",")
        new = lambda prev, stack=stack: F.struct(F.lit(prev).alias("prev"), stack.alias("stack"))
        pop = F.substring(stack, F.lit(1), F.length(stack) - 1)
        bad = new("bad")
        word = t.rlike(r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$")
        return (
            F.when(prev == "bad", state)
            .when(t == "{", F.when(value, new("{", F.concat(stack, t))).otherwise(bad)).when(t == "[", F.when(value, new("[", F.concat(stack, t))).otherwise(bad))
            .when(t == "}", F.when((inner == "{") & prev.isin("{", "value"), new("value", pop)).otherwise(bad))
            .when(t == "]", F.when((inner == "[") & prev.isin("[", "value"), new("value", pop)).otherwise(bad))
            .when(t == ",", F.when((prev == "value") & (stack != ""), new(",")).otherwise(bad)).when(t == ":", F.when(prev == "key", new(":")).otherwise(bad))
            .when(t.startswith('"'), F.when(in_key, new("key")).when(value, new("value")).otherwise(bad))
            .otherwise(F.when(value & word, new("value")).otherwise(bad)))

    start = F.struct(F.lit("start").alias("prev"), F.lit("").alias("stack"))
    whole = lambda toks: F.aggregate(toks, start, step, lambda state: (state["prev"] == "value") & (state["stack"] == ""))
    closed = lambda toks: ~F.exists(toks, lambda t: t == '"')  # noqa: E731  a lone quote is a token of its own
    return F.coalesce(S.let(tokens(text), lambda toks: closed(toks) & whole(toks)), F.lit(False))


def is_valid(text: Column) -> Column:
    """Whether the text is one JSON value; false for null."""
    return F.when(is_deep(text), follows_grammar(text)).otherwise(F.try_parse_json(text).isNotNull())


def unquoted(token: Column) -> Column:
    """The string that a string token stands for."""
    return F.when(token.rlike(r"[\\\\\x01\x02]"), F.get(F.from_json(F.concat(F.lit("["), written(token), F.lit("]")), "array<string>"), F.lit(0))).otherwise(
        F.substring(token, F.lit(2), F.length(token) - 2))


def quoted(text: Column) -> Column:
    """The text as a JSON string, null as the JSON null."""
    listed = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def _opens(t: Column) -> Column:
    return t.isin("{", "[")


def _turn(t: Column) -> Column:
    return F.when(_opens(t), 1).when(t.isin("}", "]"), -1).otherwise(0)


def leaves(payload: Column, ordinal, bare_key, lists_of_scalars: bool) -> Column:
    """Array of (path, prefix, key, field, group, text): the leaves in document order, ``text`` their JSON.

    ``ordinal`` gives the fixed-width number of an entry, ``bare_key`` a key without its box prefix. Of a repeated key the last value counts,
    at the place of the first.
    """
    def frame(kind: str, path: Column, prefix: Column, group: Column, key: Column | None = None, field: Column | None = None, n=0, text: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), prefix.alias("prefix"), (none if key is None else key).alias("key"), (none if field is None else field).alias("field"),
                        group.alias("group"), F.lit(n).alias("n"), (none if text is None else text).alias("text"))

    def below(path: Column, name: Column) -> Column:
        return F.concat_ws(".", F.nullif(path, F.lit("")), name)

    def step(state: Column, x: Column) -> Column:
        t, after = x["t"], x["after"]
        stack, top = state["stack"], F.try_element_at(state["stack"], F.lit(-1))
        rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        empty = F.lit("")

        def to(*frames: Column, out: Column | None = None, named: Column | None = None) -> Column:
            return F.struct(F.concat(rest, F.array(*frames)).alias("stack") if frames else rest.alias("stack"),
                            (state["out"] if out is None else F.concat(state["out"], F.array(out))).alias("out"),
                            (state["named"] if named is None else F.concat(state["named"], F.array(named))).alias("named"))

        def leaf(path: Column, prefix: Column, key: Column, field: Column, group: Column, text: Column) -> Column:
            return F.struct(path.alias("path"), prefix.alias("prefix"), key.alias("key"), field.alias("field"), group.alias("group"), text.alias("text"))

        counted = top.withField("n", top["n"] + 1)
        # inside an object: a key, or the value of the key that waits in the frame
        k, group = top["key"], F.concat(top["group"], ordinal(top["n"]))
        path, field = below(top["path"], k), F.concat(top["prefix"], bare_key(k))
        done = counted.withField("key", F.lit(None).cast("string"))
        name = F.struct(top["group"].alias("c"), k.alias("k"), group.alias("g"))
        plain_list = frame("S", path, top["prefix"], group, k, field) if lists_of_scalars else frame("T", path, top["prefix"], group, k, field, 1, t)
        in_object = (
            F.when(t == "}", to()).when(k.isNull(), to(top.withField("key", unquoted(t))))
            .when(t == "{", to(done, frame("o", path, top["prefix"], F.concat(group, F.lit("."))), named=name))
            .when((t == "[") & (after == "{"), to(done, frame("L", path, empty, group, field=field), named=name))
            .when(t == "[", to(done, plain_list, named=name))
            .otherwise(to(done, out=leaf(path, top["prefix"], k, field, group, t), named=name)))
        # inside a list of objects: items of other kinds add nothing
        at = top["n"].cast("string")
        item = below(top["path"], at)
        in_objects = (
            F.when(t == "]", to())
            .when(t == "{", to(counted, frame("o", item, F.concat(top["field"], F.lit("_"), at, F.lit("_")), F.concat(top["group"], F.lit("-"), ordinal(top["n"]), F.lit(".")))))
            .when(t == "[", to(counted, frame("X", empty, empty, empty, n=1))).otherwise(to(counted)))
        # inside a list whose items are leaves of their own
        in_scalars = (
            F.when(t == "]", to()).when(t == "{", to(counted, frame("o", item, top["prefix"], F.concat(top["group"], F.lit(".")))))
            .when((t == "[") & (after == "{"), to(counted, frame("L", item, empty, top["group"], field=top["field"])))
            .when(t == "[", to(counted, frame("S", item, top["prefix"], top["group"], top["key"], top["field"])))
            .otherwise(to(counted, out=leaf(item, top["prefix"], top["key"], top["field"], top["group"], t))))
        # inside a list that is one leaf, or is left out
        depth, text = top["n"] + _turn(t), F.concat(top["text"], t)
        ended = F.when(top["kind"] == "X", to()).otherwise(to(out=leaf(top["path"], top["prefix"], top["key"], top["field"], top["group"], text)))
        in_text = F.when(depth == 0, ended).otherwise(to(top.withField("n", depth).withField("text", text)))
        root = F.when(t == "{", to(top, frame("o", empty, empty, empty))).when(t == "[", to(top, frame("L", empty, empty, empty, field=F.lit("item")))).otherwise(state)
        kind = top["kind"]
        return (F.when(kind.isin("T", "X"), in_text).when(t.isin(",", ":"), state).when(kind == "o", in_object).when(kind == "L", in_objects)
                .when(kind == "S", in_scalars).otherwise(root))

    def walked(toks: Column) -> Column:
        pairs = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), lambda t, after: F.struct(t.alias("t"), F.coalesce(after, F.lit("")).alias("after")))
        first = frame("r", F.lit(""), F.lit(""), F.lit(""))
        start = F.struct(F.array(first).cast(f"array<{_FRAME}>").alias("stack"), F.array().cast(f"array<{_LEAF}>").alias("out"), F.array().cast(f"array<{_NAMED}>").alias("named"))
        return F.aggregate(F.filter(pairs, lambda x: x["t"].isNotNull()), start, step)

    def last_of_each(state: Column) -> Column:
        name = lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))
        named = state["named"]
        unique = F.size(F.array_distinct(F.transform(named, name))) == F.size(named)
        same = lambda x: F.filter(named, lambda y: (y["c"] == x["c"]) & (y["k"] == x["k"]))
        ends = F.transform(named, lambda x: S.let(same(x), lambda a: F.struct(x["g"].alias("g"), F.get(a, F.lit(0))["g"].alias("first"), F.element_at(a, -1)["g"].alias("last"))))

        def settled(ends: Column) -> Column:
            old = F.filter(ends, lambda e: e["g"] != e["last"])
            moved = F.filter(ends, lambda e: (e["g"] == e["last"]) & (e["g"] != e["first"]))
            kept = F.filter(state["out"], lambda x: ~F.exists(old, lambda e: x["group"].startswith(e["g"])))
            width = F.length(ordinal(F.lit(0)))
            place = lambda x: F.aggregate(moved, x["group"], lambda g, e: F.when(x["group"].startswith(e["g"]), F.overlay(g, F.right(e["first"], width), F.length(e["g"]) - width + 1)).otherwise(g))
            tagged = F.transform(kept, lambda x, i: F.struct(place(x).alias("g"), i.alias("i"), x.alias("x")))
            return F.transform(F.array_sort(tagged), lambda y: y["x"].withField("group", y["g"]))

        every = F.when(unique, state["out"]).otherwise(S.let(ends, settled))
        return F.transform(every, lambda x: x.withField("text", written(x["text"])))

    return S.let(S.let(tokens(payload), walked), last_of_each)


def rebuilt(payload: Column, value_of) -> Column:
    """The payload with new values: ``value_of(key)`` gives a key's JSON text, or null where its value stays.

    Every key of every object at any depth is asked, the outermost first: inside a value that is replaced nothing is looked at. Order and all
    other values stay. A payload that is no JSON object is given back as it is.
    """
    def hit(toks: Column, i: Column) -> Column:
        t = F.get(toks, i)
        is_key = t.startswith('"') & (F.get(toks, i + 1) == ":")
        return F.when(is_key, value_of(unquoted(t)))

    def end_of(toks: Column, at: Column) -> Column:
        """The place behind the value that begins at ``at``."""
        def move(state: Column, t: Column) -> Column:
            depth, n = state["depth"] + _turn(t), state["n"] + 1
            return F.when(state["open"], F.struct(depth.alias("depth"), n.alias("n"), (depth > 0).alias("open"))).otherwise(state)

        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        return at + F.aggregate(F.slice(toks, at + 1, F.size(toks)), start, move, lambda state: state["n"])

    def put(toks: Column) -> Column:
        found = F.transform(toks, lambda t, i: F.struct((i + 2).alias("at"), hit(toks, i).alias("new")))
        spans = F.transform(F.filter(found, lambda x: x["new"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), end_of(toks, x["at"]).alias("end"), x["new"].alias("new")))

        def outermost(kept: Column, x: Column) -> Column:
            last = F.try_element_at(kept, F.lit(-1))
            return F.when(last.isNotNull() & (x["at"] < last["end"]), kept).otherwise(F.concat(kept, F.array(x)))

        kept = F.aggregate(spans, F.array().cast("array<struct<at:int,end:int,new:string>>"), outermost)

        def joined(kept: Column) -> Column:
            text = lambda a, b: F.array_join(F.slice(toks, a + 1, F.greatest(b - a, F.lit(0))), "")
            pieces = F.transform(kept, lambda x, i: F.concat(text(F.when(i > 0, F.get(kept, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0), x["at"]), x["new"]))
            tail = text(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)), F.size(toks))
            return written(F.concat(F.array_join(pieces, ""), tail))

        return F.when(F.size(spans) > 0, S.let(kept, joined)).otherwise(payload)

    return F.when(payload.rlike(r"^\s*\{") & is_valid(payload), S.let(tokens(payload), put)).otherwise(payload)
