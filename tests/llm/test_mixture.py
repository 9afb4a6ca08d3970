"""Pareto mixture: targets against the round-by-round rule, words near the targets, edge cases."""

import random
import re
from collections import defaultdict

import pytest

from formweave.llm import mixture as M

SCHEMA = "doc_id long, text string, source string, size long, copies string, target double"


def by_rounds(sizes, weights, most):
    """sizes: {source: words}; shares are dealt by weight, and what lies above a limit is dealt again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), list(names)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in open_:
            out[s] += w[s] * share
        for s in open_:
            if out[s] > most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
        open_ = [s for s in open_ if out[s] < most * sizes[s]]
    return out


def corpus(sources, n, seed=0):
    rng = random.Random(seed)
    pick = [s for s, k in sources for _ in range(k)]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 10, 50, 200])) + rng.choice(["", "\n"]), rng.choice(pick), 1, "x", 0.0) for i in range(n)]
    return [*rows, (None, "a b", None, None, None, None), (5, None, "b", 1, "x", 0.0), rows[7], rows[7], (90000, "v " * 30000, "hot", 1, "x", 0.0)]


@pytest.mark.parametrize("sources", [[("hot", 30), ("a", 3), ("é", 1), ("𝄞", 1), (None, 2)], [("tiny", 1), ("a", 90), ("b", 90)]])
def test_mix(spark, sources):
    rows = corpus(sources, 3000)
    got = M.copies(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target, ids = defaultdict(int), defaultdict(int), {}, defaultdict(set)
    for i, t, s, *_ in rows:
        sizes[s] += words(t)
        ids[i].add(s)
    want = by_rounds(sizes, M.WEIGHTS, M.MOST)
    assert sorted(r.size for r in got) == sorted(words(t) for _, t, *_ in rows)
    for r in got:
        s, = [x for x in ids[r.doc_id] if sizes[x] == r.source_size] or [None]
        assert 0 <= r.copies <= M.MOST and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        taken[s] += r.copies * r.size
        target[s] = r.target
    largest = defaultdict(int)
    for _, t, s, *_ in rows:
        largest[s] = max(largest[s], words(t))
    assert not [(s, taken[s], target[s], sizes[s], largest[s]) for s in target if abs(taken[s] - target[s]) > largest[s] / 2]
    again = M.copies(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.th, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = M.mixed(spark.createDataFrame(rows, SCHEMA))
    assert mixed.columns == ["doc_id", "text", "source", "size", "copies", "target"]
    assert sum(words(r.text) for r in mixed.collect()) == sum(taken.values())


def test_small_tables(spark):
    assert M.copies(spark.createDataFrame([], SCHEMA)).collect() == []
    got = M.copies(spark.createDataFrame([(1, None, None, 1, "x", 0.0), (2, "", "a", 1, "x", 0.0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 2
    got = M.copies(spark.createDataFrame([(1, "one two", "a", 1, "x", 0.0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(2, 2.0, 1)]


def test_plan_has_no_python(spark):
    plan = M.copies(spark.createDataFrame([(1, "one two", "a", 1, "x", 0.0)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
