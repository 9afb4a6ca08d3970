"""Count automata and collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from formweave.llm import collocations as C
from formweave.llm import q_collocations
from formweave.llm.count_automaton import CountAutomaton

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def automaton(phrases):
    """Phrases: language and words; every occurrence counts for all its beginnings."""
    words = sorted({w for p in phrases for w in p})
    place = {w: k for k, w in enumerate(words)}
    paths = [np.array([place[p[k]] if k < len(p) else -1 for p in phrases]) for k in range(4)]
    return CountAutomaton.counted(pa.array(words, pa.large_binary()), paths)


def contents(a):
    out = {}
    for level in range(len(a.levels)):
        labels, weight = a.phrases(level)
        words = a.words.to_pylist()
        for row, w in zip(zip(*labels, strict=True), weight.tolist(), strict=True):
            out[tuple(words[i] for i in row)] = w
    return out


def some(rng, n):
    return [(rng.choice([b"en", b"d\ne"]), *(rng.choice([b"a", b"b", b"\xc3\xa9", b"ab"]) for _ in range(rng.randint(1, 3)))) for _ in range(n)]


def want(phrases):
    return dict(Counter(p[:k] for p in phrases for k in range(1, len(p) + 1)))


@pytest.mark.parametrize("n", [1, 3, 50])
def test_automaton(n):
    rng = random.Random(n)
    left, right = some(rng, 300), some(rng, 200)
    a = CountAutomaton.from_bytes(automaton(left).to_bytes())
    assert contents(a) == want(left)
    assert contents(CountAutomaton.union([a, automaton(right)])) == want(left + right)
    parts = defaultdict(list)
    for phrases in (left, right):
        for r, part in automaton(phrases).parts(n):
            parts[r].append(CountAutomaton.from_bytes(part.to_bytes()))
    whole = {}
    for own in parts.values():
        for p, w in contents(CountAutomaton.union(own)).items():
            assert p not in whole  # a phrase lives in one range
            whole[p] = w
    assert whole == want(left + right)
    asked = [p for p in want(left) if len(p) > 1] + [(b"en", b"zz"), (b"fr", b"a"), (b"en", b"a", b"b", b"a", b"b")]
    got = a.compose(pa.array([p[0].decode() for p in asked]), pa.array([b" ".join(p[1:]).decode() for p in asked]))
    assert got.tolist() == [want(left).get(p, 0) for p in asked]
    least = a.pruned(12)
    assert contents(least) == {p: w for p, w in want(left).items() if w >= 12 or len(p) == 1}


def test_equal_endings_are_stored_once():
    tails = [(f"t{k:03d}".encode(),) for k in range(40)]
    alike = automaton([(b"en", f"w{k:02d}".encode(), b"x", *t) for k in range(50) for t in tails])
    apart = automaton([(b"en", f"w{k:02d}".encode(), b"x", *t) for k in range(50) for t in tails for _ in range(1 + (k * t[0][3]) % 5)])
    assert contents(CountAutomaton.from_bytes(alike.to_bytes())) == contents(alike)
    assert contents(CountAutomaton.from_bytes(apart.to_bytes())) == contents(apart)
    assert len(alike.to_bytes()) < len(apart.to_bytes())
    assert contents(CountAutomaton.from_bytes(CountAutomaton.counted(pa.array([], pa.large_binary()), [np.empty(0, np.int64)] * 4).to_bytes())) == {}


def brute(docs, least, top, cover=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(q != p and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def data():
    rng = random.Random(4)
    docs = []
    for k in range(150):
        words = [rng.choice(["Red", "hot", "iron", "Éa", "x'y", "9"]) + rng.choice(["", "", "", ",", ".", "\n", "!", "\x1f"]) for _ in range(rng.randint(0, 50))]
        docs.append((k, "  ".join(words), rng.choice(["en", "en", "de", None, ""]), "clash", 7))
    docs += [(800, None, "en", None, None), (801, "", "none", None, None), (802, "...", "none", None, None), (803, "very long text " * 8000, "en", None, None)]
    return docs + [(5, "one copied line of many rows", "en", None, None)] * 60


@pytest.mark.parametrize(("range_bytes", "size", "least", "top"), [(2000, 900, 4, 15), (1 << 30, 12 << 20, 10, 2000)])
def test_collocations(spark, monkeypatch, range_bytes, size, least, top):
    monkeypatch.setattr(C, "SLICE", size)
    docs = data()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = C.collocations(df, least=least, top=top, range_bytes=range_bytes)
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top)


def test_large_counts(spark):
    a, l, r = 3 * 10**14, 4 * 10**14, 5 * 10**15
    df = spark.createDataFrame([(a, (l, r))], "a long, c struct<l: long, r: long>")
    assert df.select(C._score(df.a, df.c, 10**6).alias("s")).first().s == 10**6 * a * a // (l * r)


def test_query_and_empty_table(spark, tmp_path):
    docs = data()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = q_collocations.op11(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, 10, 2000)
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
