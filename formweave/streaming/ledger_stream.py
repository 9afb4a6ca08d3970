"""The ledger as a stream: each micro-batch continues from a log-structured state.

A batch reads the state of the buckets that its documents fall in, runs the same chunked scan as the batch ledger
and writes the new state of the touched documents. Every event is kept in a log. A document that gets an event older
than its state is run again from the log, and its new history replaces the old one, so the ledger equals that of
a batch whatever the order of arrival. Output folders carry the batch number and are overwritten as a whole, so a batch that is
run again after a failure gives the same result. Every few batches the state is written in full, which bounds how
many deltas a batch has to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L

STATE_COLUMNS = "document_id string, client_key string, document_type string, upload_count bigint, version bigint, sig string, cpa string, due_date string, confidence_score double, local_json_path string, client_id string, status string, last_ts timestamp"
BUCKETS = 16


def _bucket() -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


class LedgerStream:
    def __init__(self, path: str, compact_every: int = 20, chunk: str = "hour"):
        self.path, self.every, self.chunk = path.rstrip("/"), compact_every, chunk

    def _base(self, batch: int) -> int:
        """Number of the newest batch before this one that holds a full state, or -1."""
        return ((batch - 1) // self.every) * self.every if batch > 0 else -1

    def state(self, spark: SparkSession, before: int, buckets: list[int] | None = None) -> DataFrame | None:
        """Latest state per document from all batches before the given one, of all or of some buckets."""
        if before <= 0:
            return None
        base = self._base(before)
        parts = []
        if base > 0:
            parts.append(spark.read.schema(STATE_COLUMNS + ", bucket int").parquet(f"{self.path}/full/batch={base}").withColumn("batch", F.lit(base)))
        deltas = [f"{self.path}/state/batch={b}" for b in range(base + 1 if base > 0 else 0, before)]
        if deltas:
            parts.append(spark.read.option("basePath", f"{self.path}/state").schema(STATE_COLUMNS + ", batch int, bucket int").parquet(*deltas))
        d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if buckets is not None:
            d = d.where(F.col("bucket").isin(buckets))
        cols = [c.split()[0] for c in STATE_COLUMNS.split(", ")]
        rest = [c for c in cols if c not in L.DOCUMENT]
        return d.groupBy(*L.DOCUMENT).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*L.DOCUMENT, "r.*")

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        df.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={number}")

    def process(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of prepared submissions."""
        spark, columns = batch.sparkSession, batch.columns
        self._write(batch, "events", number)
        batch = spark.read.schema(batch.schema).parquet(f"{self.path}/events/batch={number}").select(*columns)
        buckets = sorted(r[0] for r in batch.select(_bucket()).distinct().collect())  # BUCKETS numbers at most
        old, again = self.state(spark, number, buckets), None
        if old is not None:
            old = old.join(batch.select(*L.DOCUMENT).distinct(), L.DOCUMENT, "left_semi")
            behind = batch.join(old.select(*L.DOCUMENT, "last_ts"), L.DOCUMENT).where("ts is null or ts <= last_ts").select(*L.DOCUMENT).distinct()
            behind.write.mode("overwrite").parquet(f"{self.path}/behind/batch={number}")
            behind = spark.read.schema("document_id string, client_key string, document_type string").parquet(f"{self.path}/behind/batch={number}")
            if not behind.isEmpty():
                log = spark.read.option("basePath", f"{self.path}/events").parquet(*[f"{self.path}/events/batch={b}" for b in range(number + 1)])
                log = log.where(F.col("bucket").isin(buckets)).select(*columns)
                again = L.history(log.join(behind, L.DOCUMENT, "left_semi"), self.chunk).withColumn("rewrite", F.lit(True))
            batch, old = batch.join(behind, L.DOCUMENT, "left_anti"), old.join(behind, L.DOCUMENT, "left_anti")
        hist = L.history(batch, self.chunk, old).withColumn("rewrite", F.lit(False))
        if again is not None:
            hist = hist.unionByName(again)
        hist = hist.drop("at")
        self._write(hist, "history", number)
        fresh = spark.read.schema(hist.schema).parquet(f"{self.path}/history/batch={number}").select(*hist.columns).withColumn("at", F.struct("ts", "seq"))
        names = [c.split()[0] for c in STATE_COLUMNS.split(", ")]
        self._write(L.running_state(fresh).select(*names), "state", number)
        if number > 0 and number % self.every == 0:
            full = self.state(spark, number)
            newer = spark.read.schema(STATE_COLUMNS).parquet(f"{self.path}/state/batch={number}").select(*names)
            self._write(full.join(newer.select(*L.DOCUMENT), L.DOCUMENT, "left_anti").unionByName(newer), "full", number)

    def start(self, submissions: DataFrame, **trigger):
        """Run over a streaming DataFrame of raw submissions."""
        return (
            L.prepare(submissions).writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint").trigger(**trigger).start())

    def history(self, spark: SparkSession) -> DataFrame:
        """History of all documents; of a document that was run again, what came before is replaced."""
        every = spark.read.option("basePath", f"{self.path}/history").parquet(f"{self.path}/history")
        since = every.where("rewrite").groupBy(*L.DOCUMENT).agg(F.max("batch").alias("since"))
        kept = every.join(since, L.DOCUMENT, "left").where("since is null or batch >= since")
        return kept.drop("since", "rewrite", "bucket")
