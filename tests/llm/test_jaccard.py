"""The n-gram Jaccard join against brute force."""

import random
import re

import pytest

from formweave.llm import jaccard as J

SCHEMA = "doc_id long, text string, lang string, node string, label string"


def brute(rows, size=5, percent=80):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    sets = [{tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 300))
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(80)]
    texts = [None, "", " \n ", "one", "One", "two words", "a b c d", "A b\tc d", "word " * 5000]
    for _ in range(25):  # near copies of one text, none of them the text itself
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    for _ in range(25):  # one passage in otherwise different texts
        t = [word() for _ in range(rng.randint(5, 90))]
        at = rng.randrange(len(t))
        texts.append(" ".join(t[:at] + passage + t[at:]))
    texts += [texts[12], texts[12].upper(), texts[40], " ".join(passage), " ".join([*passage, "x"])] * 2
    rows = [(i, t, None, "n", "l") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], (None, "null id", None, None, None), (7, "repeated id with another text", None, None, None)]


@pytest.mark.parametrize(("frequent", "long"), [(64, 64), (6, 4), (1000, 4)])
def test_components(spark, frequent, long):
    rows = corpus(frequent + long)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in J.classes(docs, frequent_from=frequent, long=long).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("tile", [7, 512])
def test_every_link(spark, monkeypatch, tile):
    """All links and their numbers per row against brute force, where nearly all columns are long."""
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t, *_ in rows]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    want = sorted(((str(r[0]), sum(linked(a, b) for k, b in enumerate(sets) if k != i)) for i, (r, a) in enumerate(zip(rows, sets, strict=True))))
    assert sorted((str(r.doc_id), r.n_links) for r in J.counted(docs, frequent_from=6, long=4).collect()) == want
    _, links = J.links(docs, frequent_from=6, long=4)
    links = [tuple(r) for r in links.collect()]
    every = list(set(sets))
    overlaps = sorted(len(a & b) for i, a in enumerate(every) for b in every[:i] if linked(a, b))
    assert len({(a, b) for a, b, _ in links}) == len(links) and all(a < b for a, b, _ in links)
    assert sorted(n for *_, n in links) == overlaps
    spanning = J.join(docs, frequent_from=6, long=4)[1].count()
    assert spanning <= len(links)


def test_empty_table(spark):
    assert J.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_texts_without_words(spark):
    got = J.classes(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_keep_one(spark):
    rows = corpus(11)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    got = [tuple(r)[:2] for r in kept.collect()]
    alone = {c for _, n, c in brute(rows[:-1]) if n and c is not None}  # the last row repeats an id, and is linked to nothing
    assert sorted(i for i, t in got if i is not None and (t or "").split()) == sorted([*alone, 7])
    assert len([1 for i, t in got if not (t or "").split()]) == sum(n == 0 for _, n, _ in brute(rows))
    assert (None, "null id") in got
