"""Sharding by balanced label propagation.

Documents with equal texts are linked through a hub; a group with more than 1 / ``PARTS`` of a shard's bytes has several hubs
and its members are dealt over them. Labels (shards) start at random, but neighbouring hubs of a large group together. In each round a hub takes the label that holds most
of its bytes (Spark joins and sums), and its other members ask to move there. Quotas limit the moves between each pair of
shards: what moves both ways may be exchanged, and beyond that a shard takes what its capacity (mean load and ``SLACK``)
still holds. Requests are granted hub by hub until a quota is used up, by running sums over many tasks.

The law is ``bytes``: sizes near equal. So the hubs and single documents are then laid on one line by label, and the line is cut
in equal lengths: at most shards - 1 hubs are cut. Within a label small documents lie at both ends, so a cut falls between
small ones and shard sizes differ by about one small document.

A document's size is the bytes of its text and one more; null texts count as empty, and all empty texts are one group. Equal
rows share a vertex. Null ids are allowed. With fewer rows than shards some shards stay empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.llm.tables import running, stored, unit_hash

SHARDS, ROUNDS, SLACK, PARTS = 8, 4, 0.05, 8


def _quotas(flows: dict[tuple[int, int], int], loads: dict[int, int], capacity: float) -> dict[tuple[int, int], int]:
    """Bytes that may move from one shard to another: exchanges, and a share of the room left."""
    swap = {k: min(n, flows.get(k[::-1], 0)) for k, n in flows.items()}
    over = {t: sum(n - swap[k] for k, n in flows.items() if k[1] == t) for _, t in flows}
    room = {t: max(0.0, capacity - loads.get(t, 0)) for _, t in flows}
    return {(s, t): int(swap[s, t] + (min(1.0, room[t] / over[t]) * (n - swap[s, t]) if over[t] else 0)) for (s, t), n in flows.items()}


def propagate(vertices: DataFrame, shards: int, total: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``hub``, ``label`` per hub, from ``vertices`` (``v``, ``hub``, ``bytes``, ``first``: the label to start with, or null)."""
    spark = vertices.sparkSession
    choice = F.max_by("label", F.struct("bytes", F.xxhash64("hub", "label"))).alias("label")
    start = vertices.select("v", "hub", "bytes", F.coalesce("first", F.pmod(F.xxhash64("v", F.lit("start")), F.lit(shards))).cast("int").alias("label"))
    many = start.groupBy("hub").agg(F.count("*").alias("k"), F.min("label").alias("label"), F.sum("bytes").alias("bytes"))
    single = stored(many.where("k = 1").select("hub", "label", "bytes"), "single")
    linked = stored(start.join(many.where("k > 1").select("hub"), "hub"), "linked")
    fixed = {r.label: r.n for r in single.groupBy("label").agg(F.sum("bytes").alias("n")).collect()}  # one number per shard
    for _ in range(rounds):
        held = linked.groupBy("hub", "label").agg(F.sum("bytes").alias("bytes"))
        asked = linked.join(held.groupBy("hub").agg(choice).withColumnRenamed("label", "want"), "hub")
        asked = stored(asked, "asked")
        flows = {(r.label, r.want): r.n for r in asked.groupBy("label", "want").agg(F.sum("bytes").alias("n")).collect()}  # shards * shards numbers
        loads = dict(fixed)
        for (s, _), n in flows.items():
            loads[s] = loads.get(s, 0) + n
        flows = {k: n for k, n in flows.items() if k[0] != k[1]}
        if not flows:
            break
        quotas = spark.createDataFrame([(*k, n) for k, n in _quotas(flows, loads, total / shards * (1 + slack)).items()], "label int, want int, quota long")
        movers = asked.where("label <> want").withColumn("_u", unit_hash(F.col("hub"), F.lit("move")))
        moved = running(movers, ["label", "want"], ["_u", "hub", "v"], {"before": F.col("bytes")}).join(F.broadcast(quotas), ["label", "want"])  # shards * shards rows
        moved = moved.select("hub", "v", "bytes", F.when(F.col("before") + F.col("bytes") <= F.col("quota"), F.col("want")).otherwise(F.col("label")).alias("label"))
        linked = stored(asked.where("label = want").select("hub", "v", "bytes", "label").union(moved), "linked")
    return single.select("hub", "label").union(linked.groupBy("hub", "label").agg(F.sum("bytes").alias("bytes")).groupBy("hub").agg(choice))


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, slack: float = SLACK, parts: int = PARTS) -> DataFrame:
    """Per row: ``doc_id``, ``th`` (hash of the text), ``size``, ``text_crc32``, ``shard``, ``slot`` (0, 1, ... within the shard)."""
    body: Column = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.xxhash64(body).alias("g"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = stored(rows.withColumn("v", F.xxhash64("doc_id", "g")), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "th", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    limit = max(1, total // (shards * parts))
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).select("g", F.ceil(F.col("bytes") / limit).cast("long").alias("hubs"))  # shards * parts groups at most
    rows = rows.join(F.broadcast(groups), "g", "left").withColumn("_part", F.pmod(F.xxhash64("v", F.lit("hub")), F.coalesce("hubs", F.lit(1))))
    rows = rows.withColumn("hub", F.xxhash64("g", "_part")).withColumn("first", F.when(F.col("hubs").isNotNull(), F.pmod(F.pmod(F.xxhash64("g", F.lit("first")), F.lit(shards)) + F.floor(F.col("_part") / parts), F.lit(shards))))
    rows = stored(rows.drop("hubs", "_part"), "rows")
    labels = propagate(rows.groupBy("v", "hub", "first").agg(F.sum("size").alias("bytes")), shards, total, rounds, slack)
    # all members of a hub have one size, so a hub is a stretch of the line, and a row's place in it follows from its number
    hubs = rows.groupBy("hub", "g").agg(F.sum("size").alias("bytes")).join(labels, "hub")
    half = F.least(F.log2(F.col("bytes").cast("double")) / 96, F.lit(0.4999))
    hubs = hubs.withColumn("_u", (F.col("label") + F.when(F.xxhash64("g", F.lit("side")) % 2 == 0, half).otherwise(1 - 1e-9 - half)) / shards).withColumn("_all", F.lit(0))
    hubs = running(hubs, ["_all"], ["_u", "g", "hub"], {"from": F.col("bytes")}).select("hub", "from")
    placed = running(rows.withColumn("_u", unit_hash(F.col("v"), F.lit("place"))), ["hub"], ["_u", "v"], {"nth": F.lit(1)}).join(hubs, "hub")
    middle = (F.col("from") + F.col("nth") * F.col("size")) * 2 + F.col("size")
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / (2 * total)), F.lit(shards - 1)).cast("int"))
    placed = running(placed.withColumn("_u", unit_hash(F.col("v"), F.lit("slot"))), ["shard"], ["_u", "v"], {"slot": F.lit(1)})
    return placed.select("doc_id", "th", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """The rows of ``docs`` with their shard in a last column; it is called ``shard``, or ``shard_`` where that name is taken."""
    while name in docs.columns:
        name += "_"
    put = assign(docs, shards, doc_id, text).groupBy("doc_id", "th").agg(F.min("shard").alias("__shard")).withColumnRenamed("doc_id", "__id").withColumnRenamed("th", "__th")
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    return docs.join(put, on).select(*[docs[c] for c in docs.columns], F.col("__shard").alias(name))
