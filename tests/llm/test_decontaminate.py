"""Benchmark decontamination against brute force."""

import random
import re

import pytest

from formweave.llm import decontaminate as D

DOCS = "doc_id long, text string, n_words string, items long"
ITEMS = "item_id long, text string, spans string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n):
    out = []
    for i, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for item, u, *_ in items:
            v = words(u)
            for g in {tuple(v[k:k + min(n, len(v))]) for k in range(max(1, len(v) - n + 1))} if v else ():
                for a in range(len(w) - len(g) + 1):
                    if tuple(w[a:a + len(g)]) == g:
                        hit.update(range(a, a + len(g)))
                        ids.add("null" if item is None else str(item))
        out.append((i, len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=str)


def data():
    rng = random.Random(3)
    word = lambda: rng.choice(["Über", "the", "a", "on", "x9", "naïve"]) + rng.choice("ABCdef")
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 14, 25]))), None) for k in range(12)]
    items += [(None, items[4][1], None), (3, "another text of an item with the id three", None), (50, None, None), (51, "... !!", None)]
    docs = [(k, ", ".join(word() for _ in range(40)) + " - " + (rng.choice(items)[1] or "").upper() + "; " + " ".join(word() for _ in range(30)), None, None) for k in range(40)]
    docs += [(90, None, None, None), (91, "", "x", 1), (None, items[5][1], None, None), docs[0], docs[0], (92, "plain " * 30000 + (items[6][1] or ""), None, None)]
    return docs, items


@pytest.mark.parametrize(("n", "block"), [(10, D.BLOCK_BYTES), (4, 200)])
def test_scan(spark, n, block):
    docs, items = data()
    got = D.scan(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), n=n, block_bytes=block).collect()
    got = [(r.doc_id, r.n_words, [p for a, b in r.spans for p in range(a, b)], r["items"]) for r in got]
    assert sorted(got, key=str) == brute(docs, items, n)


def test_removal(spark):
    docs, items = data()
    want = {(i, bool(h)) for i, _, h, _ in brute(docs, items, 10)}
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    kept = D.without_documents(d, b)
    assert kept.schema == d.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, hit in want if not hit}
    cut = D.without_spans(d, b)
    assert cut.count() == len(docs)
    assert not [r for r in D.scan(cut, b).collect() if len(r.spans) and r.doc_id == 92]


def test_empty(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.scan(d, b).collect() == []
    docs, _ = data()
    assert all(not r["items"] for r in D.scan(spark.createDataFrame(docs, DOCS), b).collect())
