"""Each stage of the pipeline against brute force on its own input."""

import os
from collections import Counter, defaultdict

import pytest
from test_decontaminate import brute as leaks
from test_jaccard import brute as components
from test_mixture import by_rounds

import __spark_entry__ as E
import corpus_pipeline as P
from formweave.llm import mixture as M
from formweave.llm import q_quality, quality
from formweave.llm.tables import stored, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, states = docs.columns, [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        states.append(stored(stage(spark, states[-1], SF), f"stage{k}"))
        assert states[-1].columns[: len(columns)] == columns
        assert (k == len(P.STAGES) - 1) == (states[-1].columns != columns)
    rows = [[tuple(r) for r in s.select("doc_id", "text", "source").collect()] for s in states]
    score = {r.doc_id: r.score for r in quality.score(docs, q_quality.model(spark, docs, SF)).collect()}
    assert Counter(r[0] for r in rows[1]) == Counter(i for i, s in score.items() if s >= 0.5)
    assert Counter(r[0] for r in rows[2]) == Counter({i for i, n, c in components(rows[1]) if i == c})
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert Counter(r[0] for r in rows[3]) == Counter(i for i, _, hit, _ in leaks(rows[2], items, 10) if not hit)
    sizes, took = defaultdict(int), defaultdict(int)
    for _, t, s in rows[3]:
        sizes[s] += len(t.split())
    for _, t, s in rows[4]:
        took[s] += len(t.split())
    want = by_rounds(sizes, M.WEIGHTS, M.MOST)
    largest = max(len(t.split()) for _, t, _ in rows[3])
    assert all(abs(took[s] - want[s]) <= largest / 2 for s in want)
    assert max(Counter(r[0] for r in rows[4]).values()) <= M.MOST
    assert Counter(r[0] for r in rows[5]) == Counter(r[0] for r in rows[4])
    held = Counter()
    for r in states[5].collect():
        held[r.shard] += len(r.text.encode()) + 1
    assert max(held.values()) - min(held[s] for s in range(8)) <= 3 * max(len(t.encode()) for _, t, _ in rows[4])


def test_registered():
    ours = E._corpus("QUERIES")
    assert set(ours) == {"pipeline", *(k for k in ours if k.startswith("op"))}
    assert sorted(int(k[2:].split("_")[0]) for k in ours if k != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "", None, None, None)]])
def test_small_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stored(stage(spark, docs, SF), f"small{k}")
    assert docs.count() <= 3


def test_clashing_columns(spark):
    """Extra columns keep their names and values, whatever they are called."""
    extra = ["_id", "th", "shard", "copies", "node", "label", "score", "spans", "size"]
    rows = [(i, f"some words of text number {i} and a few more of them " * 3, "en", f"s{i % 2}", 5, *[f"{c}{i}" for c in extra]) for i in range(6)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for k, (_, stage) in enumerate(P.STAGES):
        if k:  # the labels of the small data say nothing about these texts
            docs = stored(stage(spark, docs, SF), f"clash{k}")
    assert docs.columns[-2:] == ["size", "shard_"]
    assert docs.count() and all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in extra)
