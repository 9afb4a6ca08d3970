"""URL filter: parsing and rules against brute force, scores against a dense computation."""

import random

import numpy as np
import pytest

from formweave.llm import urls as U

SCHEMA = "page_id long, url string, html string, host string, rule string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:k], rest[k:]
    j = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:j]


def brute_rule(host, path, rules=U.RULES):
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def dense(edges, seeds, hosts):
    at = {h: i for i, h in enumerate(hosts)}
    out = []
    for kind in (0, 1):
        m = np.zeros((len(hosts), len(hosts)))
        for s, d in edges:
            a, b = (at[s], at[d]) if kind == 0 else (at[d], at[s])
            m[b, a] = 1
        m = m / np.maximum(m.sum(axis=0), 1)
        v = np.zeros(len(hosts))
        for h, k, n in seeds:
            if k == kind:
                v[at[h]] = n
        r = np.linalg.solve(np.eye(len(hosts)) - U.DAMPING * m, v) if v.sum() else v
        out.append(r / r.sum() if r.sum() else r)
    return out


def corpus():
    rng = random.Random(4)
    hosts = ["a.example.com", "WWW.example.com", "example.com", "x.net", "b.x.net", "site.org", "blog.site.org", "other.org", "far.de", "blog.far.de", "notcom", "éa.org"]
    rows = []
    for i in range(300):
        h = rng.choice([*hosts, "site.org", "site.org"])
        path = rng.choice(["", "/", "/en/1", "/en", "/fr/2", "/es/", "/de/x.html"]) + rng.choice(["", "?a=/en/", "#x", "?q://z"])
        to = rng.choice(["", '<a class="k" href="https://X.net/p">', "<A HREF='//other.org?x'>", '<a href="/local">', "<a href=http://far.de>", '<link href="http://evil.net/">'])
        rows.append((i, f"{rng.choice(['http', 'https'])}://{h}{path}", f"<p>{to}</p>", "h", None))
    rows += [(900, None, None, None, None), (901, "no scheme.com/en/", "<a href='http://x.net'>", None, None), (902, "://", "", None, None), (903, "http://x.net/fr/a://b", None, None, None), (None, "http://COM/", None, None, None)]
    return [*rows, rows[5], rows[5], (904, "http://far.de/" + "y" * 90000, "<a href='http://site.org/'>" * 3000, None, None)]


def test_judge(spark):
    rows = corpus()
    got = U.judge(spark.createDataFrame(rows, SCHEMA).repartition(4), U.rules(spark)).collect()
    assert len(got) == len(rows)
    seeds, known = {}, {}
    for _, u, *_ in rows:
        h, p = parse(u)
        rule, v = brute_rule(h, p)
        known[h] = True
        if v:
            seeds[h, int(v == "block")] = seeds.get((h, int(v == "block")), 0) + 1
    edges = set()
    for _, u, html, *_ in rows:
        for mark, to in (("X.net/p", "x.net"), ("//other.org?x", "other.org"), ("<a href=http://far.de>", "far.de"), ("<a href='http://x.net'>", "x.net"), ("<a href='http://site.org/'>", "site.org")):
            if html and mark in html:
                edges.add((parse(u)[0], to))
    for h in known:
        parent = h.split(".", 1)[-1]
        if parent != h and "." in parent and parent in known:
            edges |= {(h, parent), (parent, h)}
    edges = {(a, b) for a, b in edges if a != b and a and b}
    hosts = sorted({*known, *(x for e in edges for x in e)} - {""})
    trust, distrust = dense(edges, [(h, k, n) for (h, k), n in seeds.items()], hosts)
    by = {h: (t, d) for h, t, d in zip(hosts, trust, distrust, strict=True)} | {"": (0.0, 0.0)}
    ids = {}
    for i, u, *_ in rows:
        ids.setdefault(i, u)
    for r in got:
        h, p = parse(ids[r.page_id])
        rule, v = brute_rule(h, p)
        t, d = by[h]
        assert (r.host, r.path, r.rule) == (h, p, rule)
        assert abs(r.trust - t) < 5e-3 and abs(r.distrust - d) < 5e-3
        assert r.verdict == (v or ("block" if d > 0 and d >= U.RATIO * t else "allow"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_far_hosts(spark):
    """Hosts 45 links away from the only seed are reached; many copies of a graph get the scores of one copy, as shares."""
    n = 45
    edges = spark.createDataFrame([(f"h{i}", f"h{i - 1}") for i in range(1, n + 1)], "src string, dst string")
    got = {r.host: r.distrust for r in U.propagate(edges, spark.createDataFrame([("h0", 1, 1)], "host string, kind int, weight long")).collect()}
    whole = sum(U.DAMPING**i for i in range(n + 1))
    assert got.keys() == {f"h{i}" for i in range(n + 1)}
    assert all(abs(got[f"h{i}"] * whole / U.DAMPING**i - 1) < 1e-6 for i in range(n + 1))


def test_copies(spark):
    """A million copies: what a host holds is far below any fixed limit, the verdicts are those of one copy."""
    links = [("h1", "h0"), ("h2", "h1"), ("h3", "h2"), ("h4", "h3"), ("h5", "h4"), ("h6", "h5"), ("a", "h2"), ("a", "b"), ("b", "a"), ("h6", "a")]
    edges = spark.createDataFrame(links, "src string, dst string")
    seeds = [("h0", 1, 1), ("b", 0, 1)]
    one = {r.host: r for r in U.propagate(edges, spark.createDataFrame(seeds, "host string, kind int, weight long")).collect()}
    apart = [("o%d" % k, k, 999_999) for k in (0, 1)]  # all other copies' seeds, without links
    many = {r.host: r for r in U.propagate(edges, spark.createDataFrame(seeds + apart, "host string, kind int, weight long")).collect()}
    assert set(one) == set(many) - {"o0", "o1"} and one["h6"].distrust > 0
    for h, r in one.items():
        assert (many[h].distrust > 0) == (r.distrust > 0) and (many[h].distrust >= many[h].trust) == (r.distrust >= r.trust)
        assert abs(many[h].distrust / many["h0"].distrust - r.distrust / one["h0"].distrust) < 1e-6


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA), U.rules(spark)).collect() == []
    r, = U.judge(spark.createDataFrame([(1, "http://a.org", None, None, None)], SCHEMA), U.rules(spark)).collect()
    assert (r.rule, r.verdict, r.trust) == (None, "allow", 0.0)


@pytest.mark.parametrize("url", ["http://www.example.com/en/x", "http://m.example.com/en/x", "http://example.com/de/", "http://q.net/es/1", "http://q.net/en/1"])
def test_rules(spark, url):
    r, = U.judge(spark.createDataFrame([(1, url, None, None, None)], SCHEMA), U.rules(spark)).collect()
    assert (r.rule, r.verdict if r.rule else None) == brute_rule(*parse(url))
