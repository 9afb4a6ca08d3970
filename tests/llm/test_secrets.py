"""Secret scan against brute force."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from formweave.llm import secrets as S

SCHEMA = "doc_id long, text string, spans string, assign string, s long"
BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def peak(s, w):
    return max((-sum(c / w * math.log2(c / w) for c in Counter(s[i:i + w]).values()) for i in range(len(s) - w + 1)), default=-1.0)


def brute(t):
    t, out = t or "", []
    for k, kind in enumerate(("assign", "access", "hex")):
        for m in BASE[kind].finditer(t):
            if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= {"access": 18, "hex": 16}[kind]:
                out.append((m.start(), k, m.end()))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
        if len(m[0]) < S.WINDOW or any(re.search(p, m[0]) for p in S.ALLOW) or any(s <= m.start() and e >= m.end() for s, k, e in out if k < 3):
            continue
        if peak(m[0], S.WINDOW) >= next(b for p, b in S.LIMITS if re.search(p, m[0])) - 1e-9:
            out.append((m.start(), 3, m.end()))
    return [f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def corpus():
    rng = random.Random(9)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    bits = [lambda: "password = '" + some(b64, rng.randint(3, 30)) + "'", lambda: rng.choice(["Token:", "API_KEY=", "apikey = \"", "tOkEn  :  ", "secret=token="]) + some(b64, rng.randint(1, 25)), lambda: "AKIA" + some("ABCDEFGHIJ0123456789", rng.randint(8, 20)),
            lambda: some("0123456789abcdef", rng.randint(10, 45)), lambda: some("0123456789ABCDEF", rng.randint(18, 45)), lambda: some(b64, rng.randint(15, 60)), lambda: some("ab1", 30), lambda: "𝄞é über", lambda: "plain words and more", lambda: "token=secret: \"abcdefghijklmnop\"",
            lambda: "AKIAAKIA" + some("AB1", 5), lambda: "2024-01-02/2024-01-05-0001", lambda: "path/to/some/file-0001/index2", lambda: "configuration_version_parameter_12", lambda: "exampleKey" + some(b64, 20)]
    texts = [rng.choice([" ", "\n", ", ", ""]).join(rng.choice(bits)() for _ in range(rng.randint(0, 12))) for _ in range(250)]
    texts += [None, "", "w " * 60000 + "token=" + "a1B2" * 6, "passwordpassword:" + "x" * 12]
    return [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "secret=" + "q" * 20, None, None, None), (3, texts[3], None, None, None)]


def test_scan(spark):
    rows = corpus()
    got = S.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = sorted((str(r.doc_id), ",".join(f"{x.kind}:{x.s}:{x.e}" for x in r.spans)) for r in got)
    assert got == sorted((str(i), ",".join(brute(t))) for i, t, *_ in rows)
    assert {s.split(":")[0] for _, x in got for s in x.split(",") if s} == set(S.KINDS)
    texts = {i: t for i, t, *_ in rows}
    for r in S.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        assert all(texts[r.doc_id][x.s : x.e] == x.t for x in r.spans)


def test_recall(spark):
    """Random base64 keys, most of which have slashes, and keys around a placeholder are found; paths and placeholders are not."""
    rng = random.Random(12)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = [k for n in (20, 40, 88, 200, 400) for k in ("".join(rng.choice(b64) for _ in range(n)) for _ in range(200))]
    more = ["".join(rng.choice(b64) for _ in range(30)) + "7" + x + "".join(rng.choice(b64) for _ in range(30)) for x in ("xxxxxx", "abcdefghij", "Example", "/a/b/c/")]
    known = ["path/to/some/file-0001/index2", "/usr/share/doc/python3/examples/2024/", "src/main/java/com/fastParser/v2/Reader", "example_key_0123456789", "xxxxxxxxxxxxxxxxxxxx1234", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    rows = [(i, f"see {k} end", None, None, None) for i, k in enumerate([*keys, *more, *known])]
    got = {r.doc_id: any(x.kind == "entropy" and (x.s, x.e) == (4, len(rows[r.doc_id][1]) - 4) for x in r.spans) for r in S.scan(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
    letters = ["".join(rng.choice(b64[:52]) for _ in range(40)) for _ in range(100)]
    words = ["incomprehensibilities", "getUserAccountByPhoneNumber", "state-of-the-art-technologies", "src/main/java/com/fastParser/Reader", "-" * 30]
    free = [(i, f"see {k} end", None, None, None) for i, k in enumerate([*letters, *words])]
    seen = {r.doc_id for r in S.scan(spark.createDataFrame(free, SCHEMA)).collect() if any(x.kind == "entropy" for x in r.spans)}
    assert len([i for i in seen if i < 100]) >= 90 and not [i for i in seen if i >= 100]
    found = {n: [got[i] for i, k in enumerate(keys) if len(k) == n] for n in (20, 40, 88, 200, 400)}
    assert all(all(found[n]) for n in (40, 88, 200, 400)) and sum(found[20]) >= 0.9 * len(found[20])
    assert all(got[len(keys) + i] for i in range(len(more)))
    assert not any(got[len(keys) + len(more) + i] for i in range(len(known)))
    long = ["ab/" * 1000 + "c1", "0" * 3000 + "g", "x" * 3000 + "1y", "Abc" * 500 + "1!", "/a1" * 1000]
    assert S.scan(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(long)], SCHEMA)).where("size(spans) >= 0").collect() != []


def test_long_runs(spark):
    """Runs of a megabyte, and of many words, pieces and signs, end in time in proportion to their length and do not end the engine."""
    import time

    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    runs = ["".join(rng.choice(b64) for _ in range(1 << 20)), "Abc" * 300000 + "1", "ab/c1/" * 150000, "ab_Cd-" * 150000 + "x1", "example0" * 100000, "ab_" * 300000 + "12", "/" * 500000 + "a1b", "Ab" * 400000]
    df = spark.createDataFrame([(i, f"key {t} end", None, None, None) for i, t in enumerate(runs)], SCHEMA).repartition(8)
    began = time.time()
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.spans] for r in S.scan(df).collect()}
    assert time.time() - began < 120
    assert ("entropy", 4, 4 + (1 << 20)) in got[0] and not any(got[i] for i in range(1, 7))


def test_entropy(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab01XYZ+/=-") for _ in range(n)),) for n in (1, 19, 20, 21, 40, 90)] + [("a" * 50,), ("ab" * 30,)]
    got = {r.s: r.h for r in spark.createDataFrame(rows, "s string").select("s", S.peak_entropy(F.col("s")).alias("h")).collect()}
    assert all(abs(got[s] - peak(s, S.WINDOW)) < 1e-9 for s, in rows)


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.scan(df).collect() == []
    plan = S.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
