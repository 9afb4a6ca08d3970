"""Substring dedup and its index against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from formweave.llm import substring as S
from formweave.llm.fm_index import repeated_windows

SCHEMA = "doc_id long, text string, key string, start string, spans long"


def brute(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = {p for a in range(len(w) - window + 1) if seen[tuple(w[a:a + window])] > 1 for p in range(a, a + window)}
        out.append((i, len(w), sorted(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["é", "b", "the", "X"]) + str(rng.randint(0, 99))
    passages = [[word() for _ in range(n)] for n in (9, 10, 11, 40, 70)]
    rows = []
    for i in range(60):
        t = [word() for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, 2):
            at = rng.randint(0, len(t))
            t[at:at] = p if rng.random() < 0.7 else [*p[:20], word(), *p[21:]]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(t), None, None, None))
    rows += [(100, None, None, None, None), (101, "", "k", "s", 1), (102, "a " * 300, None, None, None), (103, "x y z " * 2000, None, None, None),
             (104, rows[4][1], None, None, None), rows[8], rows[8], (None, "lone text without an id", None, None, None), (5, "same id, other text " * 5, None, None, None)]
    return rows


@pytest.mark.parametrize(("window", "crowd"), [(10, 256), (10, 2), (35, 1), (3, 256)])
def test_mark(spark, window, crowd):
    rows = corpus()
    got = S.mark(spark.createDataFrame(rows, SCHEMA).repartition(4), window=window, crowd=crowd).collect()
    got = [(r.doc_id, r.n_words, [p for a, b in r.spans for p in range(a, b)], r.kept) for r in got]
    assert sorted(got, key=str) == brute(rows, window)


def test_empty(spark):
    assert S.mark(spark.createDataFrame([], SCHEMA)).collect() == []
    got = S.mark(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()
    assert [(r.doc_id, r.n_words, r.spans, r.kept) for r in got] == [(1, 0, [], "")]


def test_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        window, top, weights = int(rng.integers(2, 7)), int(rng.integers(1, 40)), rng.integers(1, 3, rng.integers(1, 12))
        parts = []
        for _ in weights:
            s = rng.integers(1, top + 1, rng.integers(1, 30))
            parts.append(np.concatenate([s, parts[rng.integers(len(parts))], s[:2]]) if parts and rng.random() < 0.5 else s)
        seen = Counter()
        for s, n in zip(parts, weights, strict=True):
            for i in range(len(s) - window + 1):
                seen[tuple(s[i:i + window])] += n
        want = np.concatenate([[i + window <= len(s) and seen[tuple(s[i:i + window])] > 1 for i in range(len(s) + 1)] for s in parts])
        text, ends = np.concatenate([np.append(s, 0) for s in parts]), np.cumsum([len(s) + 1 for s in parts]) - 1
        assert (repeated_windows(text, ends, weights, window) == want).all()
