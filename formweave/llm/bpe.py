"""Byte-level BPE with word ends: texts to token ids and back, by a tokenization automaton.

The tokenizer's file (JSON of the tokenizers library, read on the driver from a path that is a parameter) is compiled into a
``TokenAutomaton``; the automaton, some megabytes that depend on the vocabulary alone, is broadcast. In the tasks a text is normalised
and split into pieces, each piece's bytes become symbols, the last one marked as a word end, and the automaton gives its tokens. Texts of
ASCII and Latin-1 letters are normalised and split by one pattern; of other texts, the chunks between ASCII blanks that hold
other characters go through the library's own normaliser and splitter, so that its Unicode tables hold. Special tokens in
the text are one token each, as the library has it. Decoding emits the labels of the ids and joins them as the library does
for a tokenizer without a decoder: by one blank.

Null and empty texts have no tokens and decode to the empty text; null ids decode like an empty list. Repeated rows are encoded
each by itself; texts are never cut short, and a run of any length without a blank takes time in proportion to its length.
Columns other than the text are carried along.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from formweave.llm.bpe_automaton import TokenAutomaton

KNOWN = 400_000  # pieces that a worker keeps with their ids
TOGETHER = 64  # longer pieces are encoded one by one
WORDS = 8_000  # pieces that take their steps together
PORTION = 4 << 20  # characters of the texts that are cut at a time
_CHUNK = re.compile(r"[^ \t-\r]+")
_PLAIN = re.compile(r"[\t-\r -~À-ÿ]*")
_LETTERS = "a-zß-öø-ÿ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t-\r{_LETTERS}0-9]+")
_LIBRARY = "\0"  # begins the name of a piece that the library has split, in byte symbols
#: What the pattern above, blanks aside, stands for in the file. Fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CLOSED = 0x400  # added to the character of a symbol that ends a word


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints in Latin-1, else the next one free from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b if b in set(shown) else next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file's JSON."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        if model["type"] != "BPE" or not end or odd or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"not a plain BPE with word ends: {odd or model['type']}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that match more than their own text")
        closed = lambda t: t[: -len(end) - 1] + chr(ord(t[-len(end) - 1]) + _CLOSED) if t.endswith(end) and t != end else t
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = [(closed(u), closed(v)) for u, v in merges]
        made = {u + v for u, v in pairs}
        symbols = sorted(t for t in map(closed, model["vocab"]) if t not in made)
        if any(len(s) > 1 for s in symbols):
            raise ValueError("a token that no merge makes")
        self.automaton = TokenAutomaton(symbols, pairs, frozenset(s for s in symbols if ord(s) >= _CLOSED))
        ids = {closed(t): i for t, i in model["vocab"].items()}
        self.ids = np.array([ids[t] for t in self.automaton.tokens], "<u4")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: t for t, i in (*model["vocab"].items(), *self.special.items())}
        self.labels = [labels.get(i) for i in range(max(labels) + 1)]
        self.plain = _SPLIT in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.shell = json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self._open()

    def _open(self) -> None:
        self.known: dict[str, bytes] = {}
        self.library = None
        self.bytes_shown = dict(enumerate(_byte_symbols()))
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("automaton", "ids", "special", "labels", "plain", "shell")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _pieces(self, text: str) -> list[str]:
        """Names of the pieces of a text: special tokens and plain pieces as they are, others with a mark."""
        if self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [*self._between(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self._between(text[at:])
        return self._between(text)

    def _between(self, text: str) -> list[str]:
        if self.plain and _PLAIN.fullmatch(text):
            return _PIECE.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.shell)
        split, norm = self.library.pre_tokenizer.pre_tokenize_str, self.library.normalizer.normalize_str
        out = []
        for c in _CHUNK.findall(text):
            out += _PIECE.findall(c.lower()) if self.plain and _PLAIN.fullmatch(c) else [_LIBRARY + p for p, _ in split(norm(c))]
        return out

    def _closed(self, name: str) -> str:
        """The byte symbols of a piece, the last one as the end of a word."""
        p = name[1:] if name[0] == _LIBRARY else name if name.isascii() else name.encode().decode("latin-1").translate(self.bytes_shown)
        return p[:-1] + chr(ord(p[-1]) + _CLOSED)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for a, b in _portions(texts):
            cut = [self._pieces(t) if t else [] for t in texts[a:b]]
            pieces = set().union(*cut)
            new = [p for p in pieces if p not in known]
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(pieces)
            long, near = [], []
            for p in new:
                if p in self.special:
                    known[p] = self.special[p].to_bytes(4, "little")
                elif len(p) > TOGETHER:
                    known[p] = self.ids[self.automaton.encode(self._closed(p))].tobytes()
                    long.append(p)
                else:
                    near.append(p)
            for x in range(0, len(near), WORDS):
                some = near[x : x + WORDS]
                tokens, counts = self.automaton.encode_many([self._closed(p) for p in some])
                raw, ends = self.ids[tokens].tobytes(), (4 * np.cumsum(counts)).tolist()
                known.update(zip(some, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
            out += [b"".join(map(known.__getitem__, ps)) for ps in cut]
            for p in long:
                del known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """Labels of the ids, joined by a blank; ids that name no token are left out, as the library does."""
        labels = self.labels
        try:
            return " ".join([labels[i] for i in ids])
        except (IndexError, TypeError):
            return " ".join([labels[i] for i in ids if i is not None and 0 <= i < len(labels) and labels[i] is not None])


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PORTION characters; at least one text."""
    a = size = 0
    for k, t in enumerate(texts):
        if size >= PORTION:
            yield a, k
            a, size = k, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def codec(path: str) -> Codec:
    with open(path, encoding="utf-8") as f:  # on the driver; tasks get the compiled automaton
        return Codec(f.read())


def mapped(df: DataFrame, tokenizer: Codec, schema: StructType | str, run: Callable[[Codec, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``run`` over the batches of ``df`` with the broadcast tokenizer at hand, all in one pass."""
    known = df.sparkSession.sparkContext.broadcast(tokenizer)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield run(known.value, b)

    return df.mapInArrow(each, schema)


def _with(df: DataFrame, tokenizer: Codec, field: StructField, value: Callable[[Codec, pa.RecordBatch], pa.Array]) -> DataFrame:
    """``df`` and a column that ``value`` gives for each batch."""
    if field.name in df.columns:
        raise ValueError(f"there is a column {field.name}")
    run = lambda c, b: pa.record_batch([*b.columns, value(c, b)], names=[*b.schema.names, field.name])
    return mapped(df, tokenizer, StructType([*df.schema.fields, field]), run)


def id_lists(tokenizer: Codec, text: pa.Array) -> pa.ListArray:
    """Token ids of the texts of a batch."""
    runs = tokenizer.encode(text.to_pylist())
    ends = np.cumsum([0, *(len(r) // 4 for r in runs)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(runs), "<u4").astype(np.int32), pa.int32()))


def texts_of(tokenizer: Codec, ids: pa.ListArray) -> pa.Array:
    """Texts that the lists of token ids of a batch decode to."""
    return pa.array((tokenizer.decode(x.as_py() or []) for x in ids), pa.string())


def encoded(df: DataFrame, tokenizer: Codec, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows and columns, with the token ids of the text."""
    at = df.columns.index(text)
    return _with(df, tokenizer, StructField(out, ArrayType(IntegerType())), lambda c, b: id_lists(c, b.column(at)))


def decoded(df: DataFrame, tokenizer: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns, with the text that the token ids decode to."""
    at = df.columns.index(ids)
    return _with(df, tokenizer, StructField(out, StringType()), lambda c, b: texts_of(c, b.column(at)))
