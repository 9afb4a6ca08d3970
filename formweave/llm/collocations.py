"""Phrase collocations from weighted acyclic automata over words.

Each task cuts its texts into pieces and words, sorts word pointers, and builds one count automaton for the phrases of each slice of
its texts (``count_automaton``): languages, words, pairs, triples, each with its occurrences. The slice's automaton is cut
into ranges of a prefix (language and first two words, hashed), and Spark brings the parts of a range together, where their union adds the
counts; phrases below the limit go. So what is shuffled are automata, in which a frequent word, pair or repeated passage is one path per slice.
The number of ranges follows the bytes of all texts, so a range's union stays within a task.

Scores need the counts of the two parts of a phrase, for each cut. A range asks for the parts of all its phrases, each once however many
phrases hold it; the range where the part's prefix lives composes the asked phrases with its automaton and sends the counts back. Scores are
whole numbers in DECIMAL(38). Per language the ranking is a bounded top list, cut in each task before rows meet.

Null texts are empty, null languages ``und``. Repeated rows count each time. Texts without words add nothing; an empty table gives no rows.
Pieces never reach over a line end or punctuation. Ties rank by the bytes of the phrase. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm import words as W
from formweave.llm.count_automaton import CountAutomaton, merged_words, range_of
from formweave.llm.pointer_sort import Pointers, pointers
from formweave.llm.tables import stored
from formweave.llm.words import name_hashes

MAX_WORDS = 3
LEAST = 10
COVER = 50
TOP = 2000
SCALE = 1_000_000
SLICE = 5 << 20
RANGE_BYTES = 8 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
_INSIDE = W.byte_classes(separators=b" \t" + _ENDS)
_BREAKS = ~W.byte_classes(separators=_ENDS)
_PARTS = "range int, automaton binary"
_NO_CANDIDATES = pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "a": pa.array([], pa.int64()),
                           "cuts": pa.array([], pa.list_(pa.struct([("l", pa.int64()), ("r", pa.int64())])))})
_CANDIDATES = "lang string, phrase string, size int, a long, cuts array<struct<l: long, r: long>>"


def _of_slice(p: Pointers, lang: list[str], longest: int) -> CountAutomaton:
    """Counts of all phrases of the words of a slice; ``lang`` of each text."""
    order, heads = p.sorted()
    langs = pa.array(lang, pa.large_string()).cast(pa.large_binary()).dictionary_encode()
    words, (own, names) = merged_words([p.words(order[heads]), langs.dictionary])
    run = np.zeros(len(order), np.int64)
    run[heads[1:]] = 1
    label = np.empty(len(order), np.int64)
    label[order] = own[np.cumsum(run)]
    paths = [names[langs.indices.to_numpy()][p.text], label]
    for k in range(1, longest):
        on = np.full(len(label), -1)
        on[:-k] = np.where(p.piece[k:] == p.piece[:-k], label[k:], -1)
        paths.append(on)
    return CountAutomaton.counted(words, paths)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts of batches put together up to about SLICE bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from zip(t["lang"].chunks, t["text"].chunks, strict=True)
            held, size = [], 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from zip(t["lang"].chunks, t["text"].chunks, strict=True)


def range_automata(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = MAX_WORDS, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(range, automaton) with the phrases that occur ``least`` times or more, stored; and the number of ranges."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            names = langs.to_pylist()
            for a, b, p in pointers(texts, _INSIDE, SLICE, lower=W._LOWER, breaks=_BREAKS):
                if len(p.start):
                    for r, part in _of_slice(p, names[a:b], longest).parts(n):
                        yield pa.record_batch([pa.array([r], pa.int32()), pa.array([part.to_bytes()], pa.binary())], names=["range", "automaton"])

    def unite(t: pa.Table) -> pa.Table:
        whole = CountAutomaton.union([CountAutomaton.from_bytes(x.as_py()) for x in t["automaton"]]).pruned(least)
        return pa.table({"range": pa.array([t["range"][0].as_py()], pa.int32()), "automaton": pa.array([whole.to_bytes()], pa.binary())})

    return stored(rows.mapInArrow(cut, _PARTS).groupBy("range").applyInArrow(unite, _PARTS), "phrase-automata"), n


def _asked(a: CountAutomaton) -> tuple[list[list[np.ndarray]], list[tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]]:
    """The distinct parts (labels by level) of all phrases of two words or more; and per number of words the phrases, their
    counts, and for each cut the places of the two parts in the list of all parts."""
    found = [(labels, weight) for level in range(2, len(a.levels)) for labels, weight in [a.phrases(level)]]
    pieces: dict[int, list[tuple[int, int, int, list[np.ndarray]]]] = {}
    for m, (labels, _) in enumerate(found):
        for k in range(1, len(labels) - 1):
            pieces.setdefault(k, []).append((m, k, 0, [labels[0], *labels[1 : k + 1]]))
            pieces.setdefault(len(labels) - 1 - k, []).append((m, k, 1, [labels[0], *labels[k + 1 :]]))
    parts, places, start = [], {}, 0
    for _, own in sorted(pieces.items()):
        columns = [np.concatenate(c) for c in zip(*(x[3] for x in own), strict=True)]
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            _, first, key = np.unique(key * (len(a.words) + 1) + c, return_index=True, return_inverse=True)
        parts.append([c[first] for c in columns])
        for (m, k, side, x), at in zip(own, np.split(key, np.cumsum([len(x[3][0]) for x in own])[:-1]), strict=True):
            places[m, k, side] = start + at
        start += len(first)
    return parts, [(labels, weight, [(places[m, k, 0], places[m, k, 1]) for k in range(1, len(labels) - 1)]) for m, (labels, weight) in enumerate(found)]


def _spelled(a: CountAutomaton, labels: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Languages, and phrases joined by blanks."""
    text = a.words.cast(pa.large_string())
    columns = [text.take(pa.array(x)) for x in labels]
    phrase = columns[1] if len(columns) == 2 else pc.binary_join_element_wise(*columns[1:], pa.scalar(" ", pa.large_string()))
    return columns[0].cast(pa.string()), phrase.cast(pa.string())


def candidates(automata: DataFrame, n: int) -> DataFrame:
    """(lang, phrase, size, a, cuts): every kept phrase of two words or more with the counts of its parts, cut after k words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = CountAutomaton.from_bytes(raw.as_py())
                names, at = name_hashes(a.words), 0
                for labels in _asked(a)[0]:
                    langs, parts = _spelled(a, labels)
                    number = np.arange(at, at + len(parts))
                    at += len(parts)
                    yield pa.record_batch([pa.array(range_of(labels, names, n), pa.int32()), pa.array(np.full(len(parts), source), pa.int32()), pa.array(number, pa.int64()), langs, parts],
                                          names=["range", "source", "number", "lang", "part"])

    def answer(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = np.zeros(asked.num_rows, np.int64)
        if mine.num_rows and asked.num_rows:
            found = CountAutomaton.from_bytes(mine["automaton"][0].as_py()).compose(asked["lang"].combine_chunks(), asked["part"].combine_chunks())
        return pa.table({"source": asked["source"], "number": asked["number"], "count": pa.array(found, pa.int64())})

    def join(mine: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows:
            a = CountAutomaton.from_bytes(mine["automaton"][0].as_py())
            count = np.zeros(answers.num_rows, np.int64)
            count[answers["number"].to_numpy()] = answers["count"].to_numpy()
            for labels, weight, cuts in _asked(a)[1]:
                m = len(labels) - 1
                langs, phrases = _spelled(a, labels)
                sides = [np.stack([count[c[side]] for c in cuts], axis=1).ravel() for side in (0, 1)]
                pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sides], ["l", "r"])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(weight) + 1) * (m - 1), pa.int32()), pairs)
                out.append(pa.table({"lang": langs, "phrase": phrases, "size": pa.array(np.full(len(weight), m), pa.int32()), "a": pa.array(weight, pa.int64()), "cuts": listed}))
        return pa.concat_tables(out) if out else _NO_CANDIDATES

    asked = automata.mapInArrow(ask, "range int, source int, number long, lang string, part string")
    counts = automata.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(answer, "source int, number long, count long")
    return automata.groupBy("range").cogroup(counts.groupBy("source")).applyInArrow(join, _CANDIDATES)


def words_of(automata: DataFrame) -> DataFrame:
    """(lang, n): occurrences of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(1):
                a = CountAutomaton.from_bytes(raw.as_py())
                labels, weight = a.phrases(0)
                yield pa.record_batch([a.words.take(pa.array(labels[0])).cast(pa.large_string()).cast(pa.string()), pa.array(weight, pa.int64())], names=["lang", "n"])

    return automata.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _score(a: Column, cut: Column, scale: int) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(cut["l"]) * wide(cut["r"]))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = MAX_WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP, scale: int = SCALE,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their worst cut, without those that a longer
    candidate holds in ``cover`` percent of its occurrences."""
    automata, n = range_automata(docs, text, lang, longest, least, range_bytes)
    found = stored(candidates(automata, n), "phrases")
    cuts = F.transform("cuts", lambda c, k: F.struct(_score(F.col("a"), c, scale).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    scored = found.select("lang", "phrase", "size", "a", F.array_min(cuts).alias("c")).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.concat_ws(" ", F.slice(w, i, s)))))
    held = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = kept.select("lang", "phrase", "a", "l", "r", "score", rank.cast("long").alias("rank")).where(F.col("rank") <= top)
    return best.join(words_of(automata), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
