"""The passage attention model: gradients, held-out accuracy, edge cases."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from formweave.llm import quality as Q

DOCS = "doc_id long, text string, score string, id long, y string"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_gradient():
    rng = np.random.default_rng(0)
    w = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "d": np.float64(0.3)}
    x, n, y = rng.normal(size=(9, 5)), np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = Q._forward(w, x, n)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = Q._gradient(w, x, n, y)
    for k in w:
        flat = np.atleast_1d(w[k])
        for i in range(min(flat.size, 6)):
            old, got = np.array(w[k], copy=True), []
            for s in (1e-6, -1e-6):
                new = np.atleast_1d(old.copy()).reshape(-1)
                new[i] += s
                w[k] = new.reshape(np.shape(old)) if np.ndim(old) else new[0]
                got.append(loss())
            w[k] = old if np.ndim(old) else old[()]
            assert abs((got[0] - got[1]) / 2e-6 - np.atleast_1d(g[k]).reshape(-1)[i]) < 1e-6


def test_passages_cover_the_text():
    text = pa.array(["", None, "  ", "one", " ".join(f"w{i}" for i in range(200)), "é!" * 5000, "a b " * 3000])
    rows = list(Q.passages(text))
    assert sum(b - a for a, b, *_ in rows) == 7
    n = np.concatenate([r[3] for r in rows])
    assert n.tolist() == [1, 1, 1, 1, 4, 1, 94]
    x = np.concatenate([r[2] for r in rows])
    assert np.isfinite(x).all() and x.shape[1] == Q.FEATURES
    assert np.allclose((x[3:, : Q._CLASSES] ** 2).sum(axis=1), 1, atol=1e-5)


def corpus(n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 400))]
        if not good:
            at = rng.randrange(len(words))
            words[at : at + 80] = [w.upper() + "!!" for w in words[at : at + 80]]
        docs.append((i, " ".join(words), None, 1, None))
        labels.append((i, int(good), 0, None))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (None, None, None, None, None), (900, "", None, None, None), docs[0]], DOCS).repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1, 0, None), (5000, 1, 0, None), (3, None, None, None)], LABELS)
    model = Q.train(d, lab, where=F.col("id") % 3 != 1)
    got = Q.score(d, model).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(by[i] >= 0.5) == bool(q) for i, q, *_ in labels if i % 3 == 1]
    assert sum(held) / len(held) > 0.9
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    kept = Q.accepted(d, model)
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {k for k, s in by.items() if s >= 0.5}
    again = Q.train(d.repartition(5), lab, where=F.col("id") % 3 != 1)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)


def test_bounds_take_whole_rows(spark, monkeypatch):
    """Every passage of a taken row trains; rows past the bound are left out whole, equal rows count once."""
    seen = []
    monkeypatch.setattr(Q, "fit", lambda bags, y: seen.append((sorted(map(len, bags)), len(y))))
    long = [(k, f"w{k} " * (64 * 70 * (k + 1)), None, None, None) for k in range(3)]
    d = spark.createDataFrame([*long, *long[:1] * 200, (3, "short", None, None, None)], DOCS).repartition(4)
    lab = spark.createDataFrame([(k, k % 2, 0, None) for k in range(4)], LABELS)
    Q.train(d, lab)
    Q.train(d, lab, most_passages=75)
    Q.train(d, lab, most_passages=1)
    assert seen[0] == ([1, 70, 140, 210], 4)
    assert sum(seen[1][0]) <= 75 or len(seen[1][0]) == 1
    assert len(seen[2][0]) == 1


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b", None, None, None)], DOCS)
    assert [r.score for r in Q.score(d, Q.train(d, spark.createDataFrame([], LABELS))).collect()] == [0.5]
    assert [r.score for r in Q.score(d, Q.train(d, spark.createDataFrame([(1, 1, 0, None)], LABELS))).collect()] == [1.0]
    assert Q.score(spark.createDataFrame([], DOCS), Q.Model(0.5)).collect() == []
