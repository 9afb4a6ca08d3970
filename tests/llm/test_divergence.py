"""Pointer sort and the divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from formweave.llm import divergence as D
from formweave.llm import pointer_sort as P
from formweave.llm import q_divergence
from formweave.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, term string, count long"


@pytest.mark.parametrize("small", [4, 1 << 14])
def test_pointer_sort(monkeypatch, small):
    monkeypatch.setattr(P, "SMALL", small)
    rng = random.Random(2)
    inside = W.byte_classes(separators=b" \n")
    for _ in range(60):
        words = ["".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 20))) for _ in range(60)]
        words += [*words[:25], "abababab", "ababababa", "abababab\0", "abababab"]
        texts = [" ".join(words[:30]), None, "", "\n".join(words[30:])]
        ((a, b, p),) = P.pointers(pa.array(texts), inside, 1 << 20)
        order, heads = p.sorted()
        want = [w.encode() for w in words]
        assert (a, b) == (0, 4) and p.words(order).to_pylist() == sorted(want)
        assert p.words(order[heads]).to_pylist() == sorted(set(want))
        runs = np.split(order, heads[1:])
        assert all((np.diff(r) > 0).all() for r in runs)  # equal words in the order of the buffer
        assert [want[k] for r in runs for k in r] == sorted(want)


def test_pointers_end_with_texts_and_pieces():
    inside = W.byte_classes(separators=b" .")
    breaks = np.zeros(256, bool)
    breaks[ord(".")] = True
    ((_, _, p),) = P.pointers(pa.array(["ab cd.ef", "gh", ".i j"]), inside, 1 << 20, breaks=breaks)
    assert p.words(np.arange(6)).to_pylist() == [b"ab", b"cd", b"ef", b"gh", b"i", b"j"]
    assert p.text.tolist() == [0, 0, 0, 1, 2, 2]
    same = p.piece[1:] == p.piece[:-1]
    assert same.tolist() == [True, False, False, False, True]


def brute(docs, min_docs, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        share = lambda c, v=v, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}
        q, p = share(whole), {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -x, k + 1) for k, (x, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -x, k + 1) for k, (x, t) in enumerate(terms[:top])]
    return sorted(out)


def data():
    rng = random.Random(7)
    vocabulary = [rng.choice(["Été", "the", "x", "word"]) + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    docs = []
    for k in range(240):
        source = rng.choice(["hot", "hot", "a", "Z", "é", None, ""])
        words = [vocabulary[int(rng.paretovariate(0.9)) % 120] + rng.choice(["", ",", "9", ". "]) for _ in range(rng.randint(0, 60))]
        docs.append((k, " ".join(words), rng.choice(["en", "en", "de", None]), source, "clash", 1))
    docs += [(900, None, "en", "silent", None, None), (901, "12 34", "one", "only", None, None), (902, "b", "bare", "x", None, None), (903, "", "bare", "y", None, None)]
    docs += [(904, "same same words " * 9000, "en", "hot", None, None)] + [(5, "copied text of many rows", "en", "hot", None, None)] * 150
    return docs


@pytest.mark.parametrize(("min_docs", "block", "size"), [(3, 7, 1000), (30, 1024, 8 << 20)])
def test_audit(spark, monkeypatch, min_docs, block, size):
    monkeypatch.setattr(D, "SLICE", size)
    docs = data()
    audit = D.Audit(spark.createDataFrame(docs, SCHEMA).repartition(4), min_docs=min_docs)
    got = [(r.lang, r.source, part, r["item"], r.value, r.rank) for part, df in (("pair", audit.pair_reports(block)), ("term", audit.term_reports(5))) for r in df.collect()]
    assert sorted(got) == brute(docs, min_docs, 5)


def test_large_counts(spark):
    one = spark.createDataFrame([(9 * 10**17, 10**18, 10**9)], "c long, n long, v long")
    p = one.select(D._share(one.c, one.n, one.v, 5, 10**9).alias("p")).first().p
    assert p == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 5 * 10**9)


def test_query_and_empty_table(spark, tmp_path):
    docs = data()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = q_divergence.op12(spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(docs, 30, 50)
    empty = D.Audit(spark.createDataFrame([], SCHEMA))
    assert empty.pair_reports().collect() == [] and empty.term_reports().collect() == []
