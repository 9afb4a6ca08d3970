"""URL filter: rules by host and path, and link-graph propagation for the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end.
A url that is null or has no ``://`` has neither. A rule fits its host and all subdomains where the path starts with the
rule's; the longest rule (host and path) wins, a block before an allow of the same length.

Pages without a rule get the verdict of their host. Hosts are linked by the absolute links of their pages, and a host and the
host above it (one label less), where both have pages, link to each other. Trust starts at the hosts with allowed pages and
follows the links (personalised PageRank); distrust starts at the hosts with blocked pages and follows them backwards. Both
start in proportion to the pages and are scaled to a sum of one. A host is blocked when its distrust is positive and at least
``RATIO`` times its trust, else allowed. Each round is a join of the links with the scores and a sum by target; rounds end
when in ``STEP`` of them no host is new and no score moves by more than ``TOLERANCE`` of itself, so neither the number of hosts
nor their distance from a seed matters. What is missing falls by ``DAMPING`` a round, so rounds do end. Mass that hosts without
links lose would return to the seeds; scaling at the end has the same result.

Equal rows are judged one by one. Without seeds every page without a rule is allowed. Null html has no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.tables import stored

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, STEP, TOLERANCE, RATIO = 0.85, 6, 1e-7, 1.0
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), *_ASCII)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules(spark: SparkSession, given: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(given), "verdict string, host string, path string")


def _above(host: Column) -> Column:
    """The host and all hosts above it."""
    return F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda i: F.array_join(F.slice(F.split(host, r"\."), i, F.size(F.split(host, r"\."))), "."))


def ruled(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``rule`` (host and path of the winning rule, or null) and ``ruling`` to rows with ``host`` and ``path``."""
    hosts = pages.select("host").distinct()
    mine = hosts.select("host", F.explode(_above(F.col("host"))).alias("_of")).where("_of <> ''")
    mine = mine.join(known.select(F.col("host").alias("_of"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")), "_of")
    mine = mine.groupBy("host").agg(F.collect_list(F.struct(F.length(F.concat("_of", "_path")).alias("n"), (F.col("_verdict") == "block").alias("b"), F.concat("_of", "_path").alias("rule"), F.col("_path").alias("p"), F.col("_verdict").alias("v"))).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["p"])))
    return pages.join(mine, "host", "left").withColumn("_best", best).select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.v").alias("ruling"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src``, ``dst`` host pairs, from rows with ``host`` and the html."""
    out = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1)))).alias("dst"))
    out = out.select("src", F.translate("dst", *_ASCII).alias("dst"))
    hosts = pages.select("host").distinct()
    up = hosts.select("host", F.substring_index("host", ".", -1).alias("top"), F.expr("substring(host, instr(host, '.') + 1)").alias("parent")).where("parent <> host and parent <> top")
    up = up.join(hosts.select(F.col("host").alias("parent")), "parent").select("host", "parent")
    every = out.union(up.select("host", "parent")).union(up.select("parent", "host"))
    return every.where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``host``, ``trust``, ``distrust``, from ``seeds`` (``host``, ``kind`` 0 for trust and 1 for distrust, ``weight``)."""
    both = edges.select(F.lit(0).alias("kind"), "src", "dst").union(edges.select(F.lit(1), "dst", "src"))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("_n"))
    both = stored(both.join(degree, ["kind", "src"]).select("kind", "src", "dst", (damping / F.col("_n")).alias("share")), "links")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("_all"))
    start = stored(seeds.join(total, "kind").select("kind", "host", ((1 - damping) * F.col("weight") / F.col("_all")).alias("score")), "seeds")
    scores = start
    while True:
        before = scores
        for _ in range(STEP):
            flow = scores.select("kind", F.col("host").alias("src"), "score").join(both, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score"))
            scores = flow.union(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        every = scores.select("kind", "host", "score", F.lit(0.0).alias("_old")).union(before.select("kind", "host", F.lit(0.0), "score"))
        scores = every.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("_old").alias("_old")).select("kind", "host", "score", F.abs(F.col("score") - F.col("_old")).alias("moved"))
        scores = stored(scores, "scores")
        if scores.where(F.col("moved") > TOLERANCE * F.col("score")).isEmpty():  # a new host has moved by its whole score
            break
    whole = scores.groupBy("kind").agg(F.sum("score").alias("_all"))
    scores = scores.join(whole, "kind").withColumn("score", F.col("score") / F.col("_all"))
    pick = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(pick(0).alias("trust"), pick(1).alias("distrust"))


def judge(pages: DataFrame, known: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of the host."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = stored(ruled(rows, known), "ruled")
    edges = links(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), "html")
    seeds = rows.where("ruling is not null").groupBy("host", (F.col("ruling") == "block").cast("int").alias("kind")).agg(F.count("*").alias("weight"))
    scores = propagate(edges, seeds).where("host <> ''")
    out = rows.join(scores, "host", "left").select(*rows.columns, F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= ratio * F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
