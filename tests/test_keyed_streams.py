"""Keyed state with expiry: verdicts of out-of-order batches equal the batch form, and the hot state stays small."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from formweave.operators import ledger as L
from formweave.session import shared_dir
from formweave.streaming.keyed import ExpiringState, LiveSessions, StageGate
from formweave.streaming.streams import SlidingCounts

T0 = datetime(2026, 3, 1)
ALLOWED = {"extracted": ["uploaded", "extracted"], "corrected": ["extracted", "corrected"]}
SCHEMA = "key string, ts timestamp, seq long, stage string"


def events(n, seed):
    """Bursts per key over two weeks, a hot key with a third of the rows, equal times; some rows without key or time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 25)}"
        ts = T0 + timedelta(hours=rng.randint(0, 14 * 24), minutes=rng.choice([0, 5, 20, 31]))
        rows.append((key, ts, i, rng.choice(["uploaded", "extracted", "corrected", "exported", None])))
    return [*rows, (None, T0, n, "extracted"), ("k1", None, n + 1, "extracted")]


def batches(rows, seed, parts=5):
    rng = random.Random(seed)
    out = [[] for _ in range(parts)]
    for r in rows:
        out[rng.randrange(parts)].append(r)
    return [*out[:2], [], *out[2:], out[0][:5]]  # an empty batch, and events that come again


def feed(spark, table, rows):
    dealt = batches(rows, 4)
    for n, b in enumerate(dealt):
        df = spark.createDataFrame(b, SCHEMA)
        table.write(df, n)
        if n == 3:
            table.write(df, n)  # a batch that is run again
    return table.read(spark, len(dealt))


def test_live_sessions(spark):
    rows = events(400, 1)
    got = {(r.key, r.seq): r.live for r in feed(spark, LiveSessions(shared_dir(spark, "t-live"), "key", 60 * 24 * 3), rows).collect()}
    first = {}
    for k, ts, *_ in rows:
        if k is not None and ts is not None:
            first[k] = min(first.get(k, ts), ts)
    assert got == {(k, i): ts <= first[k] + timedelta(days=3) for k, ts, i, _ in rows if k is not None and ts is not None}
    assert 0 < sum(got.values()) < len(got)


def test_stage_gate(spark):
    rows = events(400, 2)
    got = feed(spark, StageGate(shared_dir(spark, "t-gate"), "key", ALLOWED, 60 * 24), rows)
    whole = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None], SCHEMA)
    shown = lambda df: sorted(map(tuple, df.select("key", "ts", "seq", "prev_stage", "stage").collect()), key=str)
    want = shown(L.transitions(whole, "key", ALLOWED))
    assert want and shown(got) == want


def test_hot_state_is_bounded(spark):
    """New keys come with every batch, and only those of the last span are written again; late events still find the expired ones."""
    state = ExpiringState(shared_dir(spark, "t-state"), "key", {"first": (F.min("ts"), F.min)}, F.col("first") + F.expr("interval 1 hour"), fan=3)
    for n in range(8):
        rows = [(f"b{n}-{i}", T0 + timedelta(hours=n, minutes=i)) for i in range(20)]
        if n == 7:
            rows += [("b1-3", T0), ("b2-4", T0 + timedelta(days=9)), ("late", T0)]
        change = {r.key: r for r in state.advance(spark.createDataFrame(rows, "key string, ts timestamp"), n).collect()}
        if n < 7:
            assert state.hot_rows(spark, n).count() <= 40
    assert change["b1-3"].before.first == T0 + timedelta(hours=1, minutes=3) and change["b1-3"].after.first == T0
    assert change["b2-4"].before.first == change["b2-4"].after.first == T0 + timedelta(hours=2, minutes=4)
    assert change["late"].before is None and change["late"].after.first == T0


def test_sliding_counts(spark):
    rows = events(300, 3)
    table = SlidingCounts(shared_dir(spark, "t-panes"), {"key": F.col("key")}, "6 hours", 4, fan=2)
    dealt = batches(rows, 5)[:-1]
    for n, b in enumerate(dealt):
        table.write(spark.createDataFrame(b, SCHEMA), n)
    got = {(r.key, r.window_start): r.n for r in table.read(spark, len(dealt)).collect()}
    df = spark.createDataFrame([r for r in rows if r[1]], SCHEMA)
    want = {(r.key, r.w.start): r["count"] for r in df.groupBy("key", F.window("ts", "24 hours", "6 hours").alias("w")).count().collect()}
    assert got == want
    assert {r.key for r in table._merged(spark, table.runs(spark, len(dealt))).select("key").distinct().collect()} == {r[0] for r in rows}
