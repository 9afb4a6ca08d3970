"""Ledger, clients, text layout and streams on small fixtures, some against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from formweave.operators import clients as CL
from formweave.operators import layout as LY
from formweave.operators import ledger as L
from formweave.operators import text as TX
from formweave.operators import views as W
from formweave.streaming import streams as ST
from formweave.streaming.ledger_stream import LedgerStream

T0 = dt.datetime(2026, 1, 1)
SUB = "client_name string, document_type string, source string, tax_year int, stage string, status string, cpa string, provider string, ts timestamp, seq bigint"


def subs(spark, rows):
    return spark.createDataFrame([(n, d, s, 2025, st, status, cpa, p, T0 + dt.timedelta(hours=h), i) for i, (n, d, s, st, status, cpa, p, h) in enumerate(rows)], SUB)


def test_ledger_fixture(spark):
    rows = [("Ann", "W-2", "a.pdf", "AI Processing", "EXTRACTED", "J", "p1", 0), ("Ann", "W-2", "a.pdf", "AI Processing", "EXTRACTED", None, "p2", 5), ("ann ", "W-2", "a.pdf", "Validation", "VALIDATED", None, None, 40)]
    p = L.prepare(subs(spark, rows))
    h = L.history(p)
    got = [(r["upload_count"], r["version"], r["content_changed"]) for r in h.orderBy("ts").collect()]
    assert got == [(1, 1, True), (2, 1, False), (3, 2, True)]
    c = L.with_canonical(L.current(h), L.canonical_names(p)).collect()
    assert len(c) == 1 and c[0]["client_name"] == "Ann" and c[0]["cpa"] == "J" and c[0]["provider"] is None and c[0]["status"] == "VALIDATED"
    assert L.document_log(h).count() == 2 and L.audit_trail(h).count() == 3


def _random_rows(n, seed=3):
    r = random.Random(seed)
    hot = lambda: r.random() < 0.4
    return [("Hot Client" if hot() else f"Client {r.randint(1, 6)}", r.choice(["W-2", "1040"]), r.choice(["a", "b"]), r.choice(["AI Processing", "Validation"]), r.choice(["EXTRACTED", "VALIDATED"]), r.choice([None, "x", "y"]), None, r.randint(0, 60)) for _ in range(n)]


def brute(rows):
    state, out = {}, {}
    for i, (n, d, s, st, status, cpa, _, h) in sorted(enumerate(rows), key=lambda x: (x[1][7], x[0])):
        k = (n.lower(), d)
        prev = state.get(k)
        content = (s, st, status)
        changed = prev is None or prev["content"] != content
        new = {"content": content, "n": (prev["n"] if prev else 0) + 1, "v": (prev["v"] if prev else 0) + int(changed), "cpa": cpa if cpa is not None else (prev["cpa"] if prev else None)}
        state[k] = new
        out[i] = (new["n"], new["v"], changed, new["cpa"])
    return out


@pytest.mark.parametrize("chunk", ["hour", "day"])
def test_ledger_against_brute_force(spark, chunk):
    rows = _random_rows(300)
    h = L.history(L.prepare(subs(spark, rows)), chunk)
    assert {r["seq"]: (r["upload_count"], r["version"], r["content_changed"], r["cpa"]) for r in h.collect()} == brute(rows)


@pytest.mark.parametrize("late", [False, True])
def test_stream_ledger_equals_batch(spark, tmp_path, late):
    rows = sorted(_random_rows(120, 9), key=lambda r: r[7])
    s = LedgerStream(str(tmp_path / "led"), compact_every=2, chunk="day")
    d = L.prepare(subs(spark, rows))
    # in order of time, or dealt so that most batches bring events older than the state
    part = (lambda b: F.floor(F.col("seq") / 24) == b) if not late else (lambda b: F.col("seq") * 7 % 5 == b)
    for b in range(5):
        s.process(d.where(part(b)), b)
    s.process(d.where(part(4)), 4)  # a batch run again gives the same result
    got = {r["seq"]: (r["upload_count"], r["version"], r["content_changed"], r["cpa"]) for r in s.history(spark).collect()}
    assert got == brute(rows)


def test_merged_stream_forgets_nothing(spark, tmp_path):
    """A key first seen years before its copies, in a later batch, still counts as the first."""
    rows = [("a", "2024-05-01", 1), ("b", "2024-05-01", 2), ("a", "2020-01-01", 3), ("c", "2024-05-02", 4), ("a", "2024-05-01", 5), ("b", "2024-09-01", 6)]
    src = tmp_path / "in"
    for k, n, i in rows:
        spark.createDataFrame([(k, n, i)], "k string, t string, i int").selectExpr("k", "cast(t as timestamp) as ts").coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    first = {r.k: str(r.first_ts)[:10] for r in ST.first_seen(str(tmp_path / "f"), {"k": F.col("k")}).run(stream()).collect()}
    assert first == {"a": "2020-01-01", "b": "2024-05-01", "c": "2024-05-02"}
    counts = {(r.k, str(r.w.start)[:10]): r.n for r in ST.counted(str(tmp_path / "c"), {"k": F.col("k")}, "1 day").run(stream()).collect()}
    assert counts == {("a", "2024-05-01"): 2, ("b", "2024-05-01"): 1, ("a", "2020-01-01"): 1, ("c", "2024-05-02"): 1, ("b", "2024-09-01"): 1}


def test_status_update_and_as_of(spark):
    p = L.prepare(subs(spark, [("Ann", "W-2", "a", None, None, None, None, 0), ("Ann", "W-2", "a", "Validation", None, None, None, 9)]))
    doc = p.first()["document_id"]
    u = spark.createDataFrame([(doc, "APPROVED", T0 + dt.timedelta(hours=5), 100), ("DOC-NONE", "X", T0, 101)], "document_id string, status string, ts timestamp, seq bigint")
    h = L.history(p.unionByName(L.status_updates(u, p)))
    assert [(r["kind"], r["version"], r["content_changed"]) for r in h.orderBy("ts").collect()] == [("submit", 1, True), ("status", 1, None), ("submit", 2, True)]
    assert L.as_of(h, F.lit(T0 + dt.timedelta(hours=6))).first()["status"] == "APPROVED"


def test_containment_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randint(1, 7)))
    cl = [(i, T0 + dt.timedelta(days=r.randint(0, 5)), r.choice([None, word()]), r.choice([None, word()]), r.choice([None, word()]), r.choice([None, word()])) for i in range(60)]
    c = spark.createDataFrame([(str(i), t, a, b, x, y) for i, t, a, b, x, y in cl], "id string, created_at timestamp, first_name string, last_name string, business_name string, trust_name string")
    names = sorted({word() for _ in range(80)} | {"a", "ab", "zzz"})
    got = {x["name_key"]: x["client_id"] for x in CL.contained_names(spark.createDataFrame([(n,) for n in names], "name_key string"), c).collect()}
    want = {}
    for n in names:
        k = n.lower().strip()
        if not k:
            continue
        for tier in range(3):
            hits = [(t, str(i)) for i, t, a, b, x, y in cl for full in [((a or "") + " " + (b or "")) if tier == 0 else (x if tier == 1 else y)] if full and k in full.lower()]
            if hits:
                want[k] = min(hits)[1]
                break
    assert got == want


def test_line_fold_against_brute_force(spark):
    w = spark.createDataFrame([(1, 1, "a", 5.0, 1.0), (1, 1, "b", 1.0, 8.0), (1, 1, "c", 2.0, 10.0)], "doc_id int, page int, text string, x0 double, y0 double")
    assert [r["line_text"] for r in LY.ocr_lines(w).orderBy("line").collect()] == ["b  a", "c"]
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, page int")
    assert [r["page_text"] for r in LY.ocr_page_text(w, pages).orderBy("page").collect()] == ["[Page 1 of 2]\nb  a\nc", "[Page 2 of 2 — no text detected]"]
    r = random.Random(1)
    rows = [(d, p, f"w{i}", float(i), round(r.random() * 60, 1)) for i, (d, p) in enumerate((r.randint(1, 2), r.randint(1, 3)) for _ in range(200))]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, y0 double")

    def fold(words, keys, tol):
        out, cur, anchor = [], [], None
        for x in sorted(words, key=lambda q: (*[q[k] for k in keys], q[4], q[3])):
            if anchor is None or abs(x[4] - anchor) > tol:
                if cur:
                    out.append(cur)
                cur, anchor = [x], x[4]
            else:
                cur.append(x)
        return out + [cur]

    want = set()
    for d in (1, 2):
        for line in fold([x for x in rows if x[0] == d], [1], 5):
            want.add((d, line[0][1], "  ".join(f"[{x[3]:.0f}] {x[2]}" for x in sorted(line, key=lambda q: q[3]))))
    got = {(x["doc_id"], x["page"], x["line_text"]) for x in LY.digital_lines(df, page_break=False).collect()}
    assert got == want


def test_segments_and_gate(spark):
    pg = spark.createDataFrame([(1, i, "OMB No. 1545-0008" if i in (0, 2, 5) else "text") for i in range(7)], "doc_id int, page int, text string")
    for span in (2, 4096):
        assert sorted((r[1], r[2]) for r in TX.form_segments(pg, span).collect()) == [(0, 1), (2, 4), (5, 6)]
    texts = ["OMB No. 1545-0008 xxxx", "form w-2 and nothing else", "Form 1099 - INT in 2024", "123456789", "wages employer 12 ssn box 3 and Internal  Revenue Service"]
    g = {r["i"]: r for r in TX.gate(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert [(g[i]["score"], g[i]["is_tax_form"]) for i in range(5)] == [(40, True), (25, False), (35, True), (0, False), (25, False)]
    assert g[2]["form_type"] == "1099 - INT" and g[3]["rejection_reason"].startswith("Insufficient")
    two = spark.createDataFrame([(1, 0, "padding text long enough to count as a page of text Form W-"), (1, 1, "2 wage statement of the year")], "doc_id int, page int, text string")
    assert TX.gate_pages(two).first()["form_type"] is not None  # found across the page break


def test_feed_and_grouping(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i) if i > 1 else None) for i in range(70)]
    feed = W.activity_feed(spark.createDataFrame(rows, "seq int, ts timestamp")).collect()
    assert len(feed) == 60 and feed[0]["seq"] == 69
    g = spark.createDataFrame([(0, "ANN LEE", "W-2", "CPA Review", "approved", 90, True), (1, "Ann Lee", "1040", "AI Processing", "exception", 81, True), (2, "ann  lee", "1098", "?", "pending", None, False)], "pos int, name string, form string, stage string, status string, conf bigint, from_ledger boolean")
    r = W.grouped_clients(g).first()
    assert (r["n_forms"], r["display_name"], r["status"], r["stage"], r["avg_conf"]) == (3, "Ann Lee", "exception", "CPA Review", 86)


def test_upload_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"x": 1}))
    (src / "b.json").write_text("{broken")
    q = ST.upload_stream(spark, str(src)).writeStream.foreachBatch(ST.split_batches(str(tmp_path / "good"), str(tmp_path / "bad"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["source"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a.json"]
    assert [r["source"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b.json"]


def test_lines_against_the_fold(spark):
    """Line by line as the rule is written: inside pages, and over page changes with pages of one top and of many."""
    import random

    from formweave.operators import layout as LY

    rng, rows = random.Random(4), []
    for d in range(9):
        for p in range(1, rng.choice([1, 3, 9]) + 1):
            for k in range(rng.choice([1, 1, 2, 30])):
                top = rng.choice([10.0, 12.5, 15.0, 20.0]) if d % 3 == 0 else rng.randint(0, 400) * 0.5 + rng.choice([0, 0.1])
                rows.append((d, p, f"w{k}", float(rng.randint(0, 300)), top, 0.9))
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, y0 double, confidence double").repartition(3)

    def folded(page_break):
        out = {}
        n = 2 if page_break else 1
        for key in sorted({r[:n] for r in rows}):
            anchor, line = None, 0
            for r in sorted((r for r in rows if r[:n] == key), key=lambda r: (r[1], r[4])):
                far = anchor is not None and (r[4] - anchor[1] if page_break else abs(r[4] - anchor[1])) > 5.0
                if anchor is None or far:
                    anchor, line = (r[1], r[4]), line + 1
                out.setdefault((r[0], anchor[0], line), []).append((r[3], r[4], f"[{round(r[3])}] {r[2]}"))
        return {k: "  ".join(c for *_, c in sorted(v)) for k, v in out.items()}

    for page_break in (True, False):
        got = {(r.doc_id, r.page, r.line): r.line_text for r in LY.digital_lines(df, page_break=page_break).collect()}
        assert got == folded(page_break)


def test_sessions_under_late_events(spark, tmp_path):
    """Batches in any order, a late event that joins two sessions, a batch that runs twice, a null key: as if all came at once."""
    import random
    from datetime import datetime, timedelta

    from formweave.streaming.streams import SessionTable

    rng, t0 = random.Random(5), datetime(2026, 1, 1)
    events = [(rng.choice(["a", "a", "b", "c", None]), t0 + timedelta(seconds=60 * rng.randint(0, 4000)), i) for i in range(400)]
    events += [("d", t0, 1), ("d", t0 + timedelta(minutes=40), 2), ("d", t0 + timedelta(minutes=20), 3), ("e", t0, 4), ("e", t0 + timedelta(minutes=30), 5), ("f", None, 6)]
    rng.shuffle(events[:400])
    table = SessionTable(str(tmp_path), "k", 1800.0, full_every=3)
    size, schema = 37, "k string, ts timestamp, i int"
    batches = [events[a : a + size] for a in range(0, len(events), size)]
    for n, rows in enumerate(batches):
        table.write(spark.createDataFrame(rows, schema), n)
        if n == 4:
            table.write(spark.createDataFrame(rows, schema), n)
    got = sorted(((r.k, r.started, r.ended, r.n_events) for r in table.read(spark, len(batches)).collect()), key=str)
    want = []
    for k in {e[0] for e in events}:
        at, run = sorted(e[1] for e in events if e[0] == k and e[1]), []
        for t in [*at, None]:
            if run and (t is None or t - run[-1] >= timedelta(minutes=30)):
                want.append((k, run[0], run[-1] + timedelta(minutes=30), len(run)))
                run = []
            run.append(t)
    assert got == sorted(want, key=str)
    assert [(g[0], g[3]) for g in got if g[0] in ("d", "e")] == [("d", 3), ("e", 1), ("e", 1)]


def test_merged_runs_by_level(spark, tmp_path):
    """After many batches few runs are read; a merge that did not finish, and a batch that runs twice, lose nothing."""
    import os

    from pyspark.sql import functions as F

    from formweave.streaming.streams import MergedTable

    table = MergedTable(str(tmp_path), {"k": F.col("k")}, {"n": (F.count("*"), F.sum), "first": (F.min("v"), F.min)}, fan=3)
    batch = lambda n: spark.createDataFrame([(j % 4, n * 10 - j) for j in range(n % 5 + 1)], "k int, v int")
    total = 20
    for n in range(total):
        table.write(batch(n), n)
        if n in (8, 11):
            table.write(batch(n), n)
    want = {}
    for n in range(total):
        for j in range(n % 5 + 1):
            c, v = want.get(j % 4, (0, 10**9))
            want[j % 4] = (c + 1, min(v, n * 10 - j))
    read = lambda: {r.k: (r.n, r.first) for r in table.read(spark, total).collect()}
    assert read() == want
    runs = table.runs(spark, total)
    assert len(runs) <= 2 * 3 and not os.path.exists(table._folder(0, 0)) and not os.path.exists(table._folder(1, 0))
    table.write(batch(total), total)  # a merge to level 1 ends here: its parts stay until the next batch
    os.remove(f"{table._folder(1, 6)}/_SUCCESS")
    assert len(table.runs(spark, total + 1)) > len(runs) - 2
    n = total
    for j in range(n % 5 + 1):
        c, v = want.get(j % 4, (0, 10**9))
        want[j % 4] = (c + 1, min(v, n * 10 - j))
    assert {r.k: (r.n, r.first) for r in table.read(spark, total + 1).collect()} == want


def test_surviving_clients(spark):
    import random

    from formweave.operators.clients import surviving_clients

    rng = random.Random(6)
    arrows = {i: rng.randint(0, 300) for i in range(300) if rng.random() < 0.7} | {1000 + i: 1001 + i for i in range(70)} | {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000}
    rows = [(a, b, 5) for a, b in arrows.items()] + [(a, 77, 1) for a in list(arrows)[:20]] + [(5000, None, 1), (5001, 5001, 1), (None, 3, 1)]
    got = {r.client_id: (r.survivor, r.cyclic) for r in surviving_clients(spark.createDataFrame(rows, "client_id long, merged_into long, merged_at int")).collect()}
    arrows = {a: b for a, b in arrows.items() if a != b}

    def end(a):
        seen = set()
        while a in arrows and a not in seen:
            seen.add(a)
            a = arrows[a]
        return (None, True) if a in arrows else (a, False)

    selves = [a for a, b, _ in rows if a is not None and a == b]
    for a in selves:  # a merge into oneself is none: an earlier one of the same client counts
        if a < 300 and (a, 77, 1) in rows:
            arrows[a] = 77
    assert got == {a: end(a) for a in arrows}
    assert surviving_clients(spark.createDataFrame([], "client_id long, merged_into long")).collect() == []


def test_long_names_that_begin_alike(spark):
    """Names over the limit, all with the same first characters: what meets is what is contained, and few other rows."""
    from formweave.operators.clients import contained_names

    head = "the very long family trust of the "
    clients = [(i, f"2026-01-{i % 28 + 1:02d}", None, None, f"{head}{i:04d} house and its heirs", f"x {head}{i % 50:04d}" if i % 3 else None) for i in range(400)]
    names = [f"{head}{i:04d} house" for i in range(0, 500, 2)] + [f" {head.upper()}{i:04d}" for i in range(20)] + [head.strip(), "house", "nobody", "", None]
    df = spark.createDataFrame(clients, "id int, created_at string, first_name string, last_name string, business_name string, trust_name string")
    got = {r.name_key: (r.client_id, r.tier) for r in contained_names(spark.createDataFrame([(n,) for n in names], "name_key string"), df).collect()}
    want = {}
    for n in {(n or "").lower().strip() for n in names} - {""}:
        hit = [(t, c[1], c[0]) for c in clients for t, full in enumerate((" ", c[4], c[5])) if full and n in full.lower()]
        if hit:
            want[n] = (min(hit)[2], min(hit)[0])
    assert got == want


def test_bulk_load_of_one_document(spark):
    """A third of the log is one document within one hour, many events at one time: several chunks, and the state as by time units."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from formweave.operators import ledger as L

    rng, t0 = random.Random(9), datetime(2026, 3, 1)
    rows = [("Busy", "W-2", t0 + timedelta(seconds=i // 50), i, rng.choice("ab"), rng.choice([None, "x", "y"])) for i in range(1500)]
    rows += [(f"C{rng.randint(0, 40)}", "1040", rng.choice([None, t0 + timedelta(hours=rng.randint(0, 300))]), 5000 + i, rng.choice("ab"), rng.choice([None, "z"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "client_name string, document_type string, ts timestamp, seq long, source string, cpa string").repartition(5)
    prepared = L.prepare(df)
    shown = lambda chunk: sorted(map(tuple, L.history(prepared, chunk).select("document_id", "ts", "seq", "upload_count", "version", "content_changed", "cpa").collect()), key=str)
    assert shown("rows") == shown("hour")
    cut = L._chunked(prepared, ["document_id"], "rows").where("client_name = 'Busy'").groupBy("chunk").agg(F.count("*").alias("n")).collect()
    assert len(cut) > 1 and max(r.n for r in cut) < 1200
