"""Fingerprints: the next row and the edited text, and the neighbour search against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from formweave.llm import simhash as S

SCHEMA = "doc_id long, text string, th string, bucket string, next_text string"


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice(["é𝄞", "ab", "the", "Xy"]) + str(rng.randint(0, 500))
    rows = [(i * 7, " ".join(word() for _ in range(rng.choice([0, 1, 2, 40, 300]))), None, None, None) for i in range(150)]
    rows += [(2001, None, None, None, None), (2002, "", "t", "b", "n"), (2003, "w " * 40000, None, None, None), (2004, "W " * 40000, None, None, None)]
    rng.shuffle(rows)
    return [*rows, (None, "no id", None, None, None)]


def test_compared(spark):
    rows = corpus()
    got = {r.doc_id: r for r in S.compared(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, t, *_), (j, u, *_) in zip(line, [*line[1:], line[0]], strict=True):
        t, u, r = t or "", u or "", got[i]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bits = lambda h: bin(int(h, 16))[2:].zfill(S.BITS)
        same = lambda a, b: sum(x == y for x, y in zip(bits(a), bits(b), strict=True)) / S.BITS
        assert abs(r.near_edited - same(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - same(r.fingerprint, got[j].fingerprint)) < 1e-9
        assert r.fingerprint == S.fingerprints(pa.array([t]))[0].tobytes().hex()
    assert got[2003].fingerprint == got[2004].fingerprint
    assert got[2001].fingerprint == got[2002].fingerprint == "0" * 32


def test_votes():
    """Bits against a plain count of votes; likeness falls as texts differ more."""
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 400)}" for _ in range(600)]
    texts = [" ".join(words), " ".join([*words[:540], *(f"x{i}" for i in range(60))]), " ".join([*words[:300], *(f"y{i}" for i in range(300))]), " ".join(f"z{i}" for i in range(600))]
    p = S.fingerprints(pa.array(texts))
    near = [S.likeness(p[:1], p[k : k + 1])[0] for k in range(4)]
    assert near[0] == 1 > near[1] > near[2] > near[3] and near[3] < 0.7
    pair = pa.array(["a b"])
    (_, _, w), = S.W.words(pair)
    h, _ = w.windows(2)
    term = (h >> np.uint64(24)) & np.uint64((1 << 40) - 1)
    assert S.fingerprints(pair)[0].tobytes() == np.stack([S.W.mix(term, 41), S.W.mix(term, 42)], axis=1).view(np.uint8).tobytes()


def test_near(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(128) for _ in range(60)]
    for p in prints[:40]:
        for _ in range(3):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 6))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, f"{p:032x}", signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, hi long, lo long")
    for radius, blocks in ((3, 4), (4, 6), (0, 1)):
        got = {(r.fingerprint, r.other, r.distance) for r in S.near(df, df, radius, blocks).collect()}
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius}
        assert got == want
    counted = {r.doc_id: r.n_within for r in S.with_neighbours(df, F.col("doc_id") % 50 == 0).collect()}
    assert counted == {i: sum((p ^ q).bit_count() <= S.RADIUS for q in prints) - 1 if i % 50 == 0 else None for i, p in enumerate(prints)}


def test_empty_and_single(spark):
    assert S.compared(spark.createDataFrame([], SCHEMA)).collect() == []
    r, = S.compared(spark.createDataFrame([(5, "abcd ef", None, None, None)], SCHEMA)).collect()
    assert (r.n_chars, r.edited_sha256) == (7, hashlib.sha256(b"abcdabc").hexdigest())
    twice = S.compared(spark.createDataFrame([(5, "abc", None, None, None)] * 2, SCHEMA)).collect()
    assert [r.edited_sha256 for r in twice] == [hashlib.sha256(b"aba").hexdigest()] * 2


def test_recall(spark):
    """Near copies of texts, by brute force over 5-word shingles: pairs of similarity 0.8 or more are neighbours, unrelated texts are not."""
    rng = random.Random(8)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = []
    for k in range(120):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([100, 250, 600]))]
        edited = list(words)
        for _ in range(1 if k % 2 else 200):
            tried = list(edited)
            tried[rng.randrange(len(tried))] = f"x{rng.randint(0, 3000)}"
            a, b = shingles(words), shingles(tried)
            if len(a & b) < 0.8 * len(a | b):
                break
            edited = tried
        texts += [words, edited]
    prints = S.fingerprints(pa.array([" ".join(w) for w in texts]))
    _, hi, lo = S._columns(prints)
    rows = list(zip(range(len(texts)), hi.to_pylist(), lo.to_pylist(), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, hi long, lo long")
    got = {r.doc_id: r.n_within for r in S.with_neighbours(df, F.lit(True)).collect()}
    sets = [shingles(w) for w in texts]
    want = {i: sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert set(want.values()) == {1}
    assert all(got[i] == 1 for i in want if i // 2 % 2)  # one word changed
    assert sum(got.values()) >= 0.97 * len(texts) and max(got.values()) == 1


def test_block_reach():
    """No pair within the radius can differ by more than the reach in every block; blocks cover all bits."""
    for radius, blocks in ((20, 9), (20, 8), (3, 4), (12, 5), (0, 1), (2, 6)):
        tables = S.block_reach(radius, blocks)
        assert sum(reach + 1 for _, _, reach in tables) == radius + 1 and len(tables) == min(blocks, radius + 1)
        assert all(reach >= 0 and a < b for a, b, reach in tables)


def test_block_tables(spark):
    """Few and many blocks, crowded keys, copies and ids that are null against brute force."""
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(8)]
    prints = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 14))) for _ in range(120)] + base * 3 + [0, 0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)] + [(None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, hi long, lo long")
    every = [*prints, 0]
    for blocks, part in ((9, 7), (9, 1000), (8, 20)):
        got = sorted((str(r.doc_id), r.n_within) for r in S.with_neighbours(df, F.col("doc_id") % 2 == 0, blocks=blocks, part=part).collect() if r.doc_id is not None and r.doc_id % 2 == 0)
        assert got == sorted((str(i), sum((p ^ q).bit_count() <= S.RADIUS for q in every) - 1) for i, p in enumerate(prints) if i % 2 == 0)


def test_string_ids_and_few_comparisons(spark):
    """Ids of any type; of random fingerprints few meet in a table."""
    rng = random.Random(10)
    prints = [rng.getrandbits(128) for _ in range(2000)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), 20)) for p in prints[:40]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(f"d{i}", signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)], "doc_id string, hi long, lo long")
    got = {r.doc_id: r.n_within for r in S.with_neighbours(df, F.col("doc_id").endswith("7")).collect()}
    assert got == {f"d{i}": sum((p ^ q).bit_count() <= S.RADIUS for q in prints) - 1 if i % 10 == 7 else None for i, p in enumerate(prints)}
    cut = lambda p, a, b: (p >> (128 - b)) & ((1 << (b - a)) - 1)
    met = sum(any((cut(p, a, b) ^ cut(q, a, b)).bit_count() <= r for a, b, r in S.block_reach(S.RADIUS, S.BLOCKS)) for p in prints[:50] for q in prints)
    assert met < 0.04 * 50 * len(prints)
