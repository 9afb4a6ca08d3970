"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is the bag of its passages of ``PASSAGE`` words (with what lies between; a text without words is one passage). Each
passage is described by shares of byte classes and by word statistics, standardised, and encoded by a tanh layer. Gated
attention (tanh times sigmoid, softmax over the bag) weighs the encoded passages; a logistic unit scores their weighted mean.
All layers are trained together on the log loss of document labels.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the least hash of the id, as far as all their passages together
number at most ``PASSAGES``; every passage of such a row is read. Both bounds are arguments of ``train`` and limit what reaches the driver. Scoring reads whole texts, every passage, and has no
shuffle. Equal rows train once; rows without a label or an id train nothing. Without labels of both classes the score is their share (0.5 if none).
Null texts count as empty, and are scored as such. Only the text enters a score. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formweave.llm import words as W
from formweave.llm.tables import stored

PASSAGE, SAMPLE, PASSAGES = 64, 6000, 200_000
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b";:", b"!", b"?", b"|", b"%", b"*", b"#", b"$", b"&", b"@", b"\"'`", b"()[]{}", b"-_", b"/\\", b"<>=+~^"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:192], _CLASS[192:] = len(_GROUPS) + 1, len(_GROUPS) + 2
_CLASSES = len(_GROUPS) + 3
FEATURES = _CLASSES + 8


def passages(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of rows a to b - 1: features of their passages and the number of passages of each row."""
    for a, b, w in W.words(text):
        count = w.count()
        n = np.maximum(1, -(-count // PASSAGE))
        total = int(n.sum())
        first = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(b - a), n)
        nth = np.arange(total) - first[row]
        at = w.first[row] + nth * PASSAGE  # the first word of each passage
        size = np.minimum(w.first[row + 1] - at, PASSAGE)
        begin = np.where(nth == 0, w.begin[row], w.start[np.minimum(at, max(len(w.start) - 1, 0))] if len(w.start) else w.begin[row])
        length = np.diff(np.append(begin, w.begin[-1]))
        of_byte, of_word = np.repeat(np.arange(total), length), np.repeat(np.arange(total), size)
        share = np.bincount(of_byte * _CLASSES + _CLASS[w.data], minlength=total * _CLASSES).reshape(total, _CLASSES) / np.maximum(length, 1)[:, None]
        per = np.maximum(size, 1)
        long = (w.end - w.start).astype(np.float64)
        mean = np.bincount(of_word, long, total) / per
        spread = np.sqrt(np.maximum(np.bincount(of_word, long**2, total) / per - mean**2, 0))
        key = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=total) / per
        lead = w.data[w.start]
        upper = np.bincount(of_word, (lead >= 65) & (lead <= 90), total) / per
        tail = w.data[w.end - 1] if len(w.end) else lead
        odd_end = np.bincount(of_word, _CLASS[tail] > 2, total) / per
        same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])])[: len(w.hash)]
        lines = share[:, 4] * length
        more = [np.log1p(mean), np.log1p(spread), distinct, upper, odd_end, np.bincount(of_word, same, total) / per, np.log1p(length / (lines + 1)), size / PASSAGE]
        yield a, b, np.column_stack([np.sqrt(share), *more]).astype(np.float32), n


@dataclass
class Model:
    """Weights of the network; ``prior`` is the score where nothing was learned."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict | None = None

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(n), self.prior)
        return _forward(self.weights, (x - self.mean) / self.scale, n)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, n: np.ndarray) -> dict:
    first, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[of])
    alpha = e / np.add.reduceat(e, first)[of]
    z = np.add.reduceat(alpha[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "of": of, "first": first}


def _gradient(w: dict, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
    s = _forward(w, x, n)
    of, h, t, g, alpha = (s[k] for k in ("of", "h", "t", "g", "alpha"))
    out = (s["p"] - y) / len(y)
    dz = out[:, None] * w["c"]
    dalpha = (dz[of] * h).sum(axis=1)
    de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, s["first"])[of])
    dt, dg = de[:, None] * w["a"] * g * (1 - t**2), de[:, None] * w["a"] * t * g * (1 - g)
    dh = (alpha[:, None] * dz[of] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": s["z"].T @ out, "d": out.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Train on one array of passages per document."""
    if len(bags) == 0 or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(bags) else 0.5)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"W": init(every.shape[1], hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "a": init(gate), "c": init(hidden), "d": np.float64(0)}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    bags = [(x - mean) / scale for x in bags]
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            take, step = order[k : k + batch], step + 1
            g = _gradient(w, np.concatenate([bags[i] for i in take]), np.array([len(bags[i]) for i in take]), labels[take])
            for key in w:
                d = g[key] + decay * w[key]
                m[key], v[key] = 0.9 * m[key] + 0.1 * d, 0.999 * v[key] + 0.001 * d**2
                w[key] = w[key] - rate * (1 - epoch / epochs) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return Model(float(labels.mean()), mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, most_passages: int = PASSAGES) -> Model:
    """Fit on at most ``sample`` labelled rows with at most ``most_passages`` passages together; ``where`` (over ``id``) leaves rows out."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    if where is not None:
        rows = rows.where(where)
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(rows), "id").select("id", "y", "text")  # at most `sample` labels

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, out = [], []
            for _, _, x, n in passages(batch.column(2)):
                size += n.tolist()
                out += [p.tobytes() for p in np.split(x, np.cumsum(n)[:-1])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["id", "y", "k", "x"])

    kind = dict(known.dtypes)["id"]
    coded = stored(known.mapInArrow(encode, f"id {kind}, y double, k long, x binary").select(F.xxhash64("id").alias("h"), "id", "y", F.xxhash64("x").alias("xh"), "k", "x"), "bags")
    key = ["h", "id", "y", "xh"]
    # a row has a passage at least, so so many rows decide; they are numbers only
    first = coded.select(*key, "k").distinct().orderBy(*key).limit(most_passages)
    upto = first.withColumn("sum", F.sum("k").over(Window.orderBy(*key))).withColumn("nth", F.row_number().over(Window.orderBy(*key)))
    last = upto.where((F.col("sum") <= most_passages) | (F.col("nth") == 1)).agg(F.max(F.struct(*key)).alias("m")).first().m
    if last is None:
        return fit([], np.empty(0))
    within = F.struct(*key) <= F.struct(*[F.lit(last[c]).cast(dict(coded.dtypes)[c]).alias(c) for c in key])
    got = coded.where(within).dropDuplicates(key).orderBy(*key).select("x", "y").collect()
    return fit([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got], np.array([min(max(r.y, 0.0), 1.0) for r in got]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``score`` (0 to 1)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [known.value.scores(x, n) for _, _, x, n in passages(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(p) if p else [], pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows with a score of ``least`` or more, all columns unchanged."""
    at, known = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [known.value.scores(x, n) for _, _, x, n in passages(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(p) >= least)) if p else batch

    return docs.mapInArrow(run, docs.schema)
