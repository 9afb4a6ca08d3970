"""Keyed state with expiry for streams whose events may come in any order: fixed sessions and stage gating.

The state of a key is a row of aggregates that merge. It is hot while its expiry time lies at or after the clock, the latest event
time that any batch brought, and each batch writes the hot rows anew; so what is written again per batch is bounded by the keys alive in one expiry
span, not by all keys ever seen. An expired row goes to a cold table of runs merged by level, which is asked only for keys of the batch
that are not hot. Nothing is forgotten: an event that comes after the expiry of its key finds the cold row.

All folders carry the number of their batch, a batch reads only folders before its own and overwrites its own, so a batch that is run again
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..fixed_values import DEFAULTS
from ..operators.ledger import with_previous
from .streams import MergedTable

BUCKETS = 16


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


class ExpiringState:
    """State rows per ``key`` with an expiry time.

    ``parts`` names each value, its aggregate over the events of a batch, and how values merge; ``expires`` is the expiry
    time by these values. A row whose expiry is null stays hot.
    """

    def __init__(self, path: str, key: str, parts: dict[str, tuple], expires: Column, fan: int = 8):
        self.path, self.key, self.parts, self.expires = path.rstrip("/"), key, parts, expires
        self.cold = MergedTable(f"{self.path}/cold", {key: F.col(key)}, {k: (merge(k), merge) for k, (_, merge) in parts.items()}, fan)

    def _kept(self, rows: DataFrame, label: str, number: int) -> DataFrame:
        path = f"{self.path}/{label}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _state(self, spark: SparkSession, number: int, schema: StructType) -> DataFrame:
        full = StructType([*schema.fields, StructField("expired", IntegerType())])
        return spark.read.schema(full).parquet(f"{self.path}/state/batch={number}")

    def _hot(self, spark: SparkSession, number: int, schema: StructType) -> DataFrame:
        return self._state(spark, number, schema).where("expired = 0").drop("expired")

    def _clock(self, spark: SparkSession, number: int):
        return spark.read.parquet(f"{self.path}/clock/batch={number}").first()[0] if number >= 0 else None

    def advance(self, batch: DataFrame, number: int) -> DataFrame:
        """Take in a batch (``key``, ``ts`` and the columns of the aggregates). Per key of the batch: the state ``before`` it, null for a new key, and ``after`` it."""
        spark, key = batch.sparkSession, self.key
        partial = [p.alias(k) for k, (p, _) in self.parts.items()]
        new = self._kept(batch.groupBy(key).agg(*partial, F.max("ts").alias("_ts")), "new", number)
        # one row: the latest time of the batch, kept for the batches to come
        was = self._clock(spark, number - 1)
        now = new.agg(F.greatest(F.max("_ts"), F.lit(was).cast("timestamp")).alias("clock"))
        now.write.mode("overwrite").parquet(f"{self.path}/clock/batch={number}")
        now, new = self._clock(spark, number), new.drop("_ts")
        schema = new.schema
        known = rest = None
        if number > 0:
            hot, keys = self._hot(spark, number - 1, schema), new.select(F.col(key).alias("_k"))
            missing = keys.join(hot.select(F.col(key).alias("_h")), _same("_k", "_h"), "left_anti")
            cold = self.cold.read(spark, number).join(missing, _same(key, "_k"), "left_semi")
            known = hot.join(keys, _same(key, "_k"), "left_semi").unionByName(cold).withColumn("_old", F.lit(True))
            rest = hot.join(keys, _same(key, "_k"), "left_anti")
        both = new.withColumn("_old", F.lit(False))
        both = both if known is None else both.unionByName(known)
        values = F.struct(*[F.col(p) for p in self.parts])
        change = both.groupBy(key).agg(*[merge(k).alias(k) for k, (_, merge) in self.parts.items()], F.any_value(F.when(F.col("_old"), values), F.lit(True)).alias("before"))
        change = self._kept(change.select(key, values.alias("after"), "before"), "change", number)
        state = change.select(key, "after.*")
        state = state if rest is None else state.unionByName(rest)
        expired = F.coalesce(self.expires < F.lit(now).cast("timestamp"), F.lit(False)).cast("int")
        state.withColumn("expired", expired).write.mode("overwrite").partitionBy("expired").parquet(f"{self.path}/state/batch={number}")
        self.cold.write(self._state(spark, number, schema).where("expired = 1").drop("expired"), number)
        return change

    def hot_rows(self, spark: SparkSession, number: int) -> DataFrame:
        """The hot rows after a batch."""
        return spark.read.parquet(f"{self.path}/state/batch={number}").where("expired = 0").drop("expired")


class _Verdicts:
    """A stream whose batches leave verdicts on events, in folders by batch and bucket of the key."""

    path: str
    key: str

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")

    def _log(self, spark: SparkSession, before: int, schema: StructType) -> DataFrame:
        """The verdicts of the batches before a number, with ``bucket`` and ``batch``."""
        full = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])
        return spark.read.schema(full).option("basePath", f"{self.path}/verdicts").parquet(*[f"{self.path}/verdicts/batch={n}" for n in range(before)])

    def _put(self, rows: DataFrame, number: int) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/verdicts/batch={number}")

    def _asked(self, log: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        """The log's rows of some keys; only their buckets are read."""
        buckets = [r[0] for r in keys.select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS numbers at most
        return log.where(F.col("bucket").isin(buckets)).join(keys, _same(self.key, name))

    def write(self, batch: DataFrame, number: int) -> None:
        raise NotImplementedError

    def run(self, stream: DataFrame) -> DataFrame:
        """Feed everything available, and return the verdicts that stand."""
        last = [-1]

        def write(batch: DataFrame, number: int) -> None:
            self.write(batch, number)
            last[0] = number

        q = stream.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        return self.read(stream.sparkSession, last[0] + 1)

    def read(self, spark: SparkSession, batches: int) -> DataFrame:
        raise NotImplementedError


class LiveSessions(_Verdicts):
    """Whether each event of a session came within a fixed time from the session's first event.

    Events are (``key``, ``ts``, ``seq``); a (key, seq) names an event, and one that comes again is the same event. Events without key or time are
    left out. An event that turns out to be the first of its session moves the expiry back: the logged events between the new and the
    old expiry are no longer live, and their verdicts are written again. A verdict only ever turns from live to not live.
    """

    def __init__(self, path: str, key: str, minutes: int = DEFAULTS.session_minutes):
        self.path, self.key = path.rstrip("/"), key
        self.life = F.make_dt_interval(mins=F.lit(minutes))
        self.state = ExpiringState(f"{self.path}/sessions", key, {"first": (F.min("ts"), F.min)}, F.col("first") + self.life)

    def write(self, batch: DataFrame, number: int) -> None:
        events = batch.where(F.col(self.key).isNotNull() & F.col("ts").isNotNull()).select(self.key, "ts", "seq")
        change = self.state.advance(events, number)
        ends = change.select(F.col(self.key).alias("_s"), (F.col("after.first") + self.life).alias("_end"), (F.col("before.first") + self.life).alias("_old"))
        rows = events.join(ends, _same(self.key, "_s")).select(self.key, "ts", "seq", (F.col("ts") <= F.col("_end")).alias("live"))
        if number > 0:
            moved = ends.where("_end < _old")
            late = self._asked(self._log(batch.sparkSession, number, StructType(rows.schema.fields)), moved, "_s")
            late = late.where("live AND ts > _end AND ts <= _old").select(self.key, "ts", "seq", F.lit(False).alias("live"))
            rows = rows.unionByName(late)
        self._put(rows, number)

    def read(self, spark: SparkSession, batches: int) -> DataFrame:
        """(key, ts, seq, live) after so many batches."""
        rows = spark.read.option("basePath", f"{self.path}/verdicts").parquet(*[f"{self.path}/verdicts/batch={n}" for n in range(batches)])
        return rows.groupBy(self.key, "ts", "seq").agg(F.bool_and("live").alias("live"))


class StageGate(_Verdicts):
    """Steps of a process (``key``, ``ts``, ``seq``, ``stage``) held against the stages that each may follow.

    The state of a key is its last step. A batch whose steps all come after it needs nothing else; a step that comes late takes its place among
    the logged steps of its key, and the step that now follows it is judged again. Only the buckets of such keys are read. State expires
    ``minutes`` after the last step. (key, ts, seq) names a step; steps without a key or time are left out.
    """

    def __init__(self, path: str, key: str, allowed: dict[str, list[str]], minutes: int = DEFAULTS.session_minutes):
        self.path, self.key, self.allowed = path.rstrip("/"), key, allowed
        self.state = ExpiringState(f"{self.path}/tails", key, {"tail": (F.max(F.struct("ts", "seq", "stage")), F.max)},
                                   F.col("tail.ts") + F.make_dt_interval(mins=F.lit(minutes)))

    def _refused(self) -> Column:
        bad = F.lit(False)
        for stage, froms in self.allowed.items():
            bad = bad | (F.coalesce(F.col("stage") == stage, F.lit(False)) & ~F.coalesce(F.col("prev_stage").isin(froms), F.lit(False)))
        return bad

    def write(self, batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, self.key
        steps = batch.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "ts", "seq", "stage")
        change = self.state.advance(steps, number)
        at = F.struct("ts", "seq")
        rows = steps.withColumn("fresh", F.lit(True))
        if number > 0:
            begins = steps.groupBy(key).agg(F.min(at).alias("_begin")).withColumnRenamed(key, "_s")
            known = change.where("before IS NOT NULL").select(key, F.col("before.tail").alias("_tail"))
            known = known.join(begins, _same(key, "_s")).withColumn("_late", F.col("_begin") <= F.struct("_tail.ts", "_tail.seq"))
            known.write.mode("overwrite").parquet(f"{self.path}/known/batch={number}")
            known = spark.read.schema(known.schema).parquet(f"{self.path}/known/batch={number}")
            tails = known.where("NOT _late").select(key, "_tail.*")
            schema = StructType([f for f in rows.schema.fields if f.name != "fresh"] + [StructField("prev_stage", rows.schema["stage"].dataType)])
            logged = self._asked(self._log(spark, number, schema), known.where("_late").select("_s", "_begin"), "_s")
            logged = logged.select(key, "ts", "seq", "stage", (at < F.col("_begin")).alias("_past"))
            past = logged.where("_past").groupBy(key).agg(F.max(F.struct("ts", "seq", "stage")).alias("p")).select(key, "p.*")
            after = logged.where("NOT _past").drop("_past").dropDuplicates([key, "ts", "seq"])
            context = tails.unionByName(past).unionByName(after)
            context = context.join(steps.select(F.col(key).alias("_s"), F.col("ts").alias("_ts"), F.col("seq").alias("_seq")),
                                   _same(key, "_s") & (F.col("ts") == F.col("_ts")) & _same("seq", "_seq"), "left_anti")  # a step that came again
            rows = rows.unionByName(context.withColumn("fresh", F.lit(False)))
        rows = rows.dropDuplicates([key, "ts", "seq"]).withColumn("step", F.struct("stage", "fresh"))
        judged = with_previous(rows, key, "step", "hour").where("fresh OR prev.fresh").select(key, "ts", "seq", "stage", F.col("prev.stage").alias("prev_stage"))
        self._put(judged, number)

    def read(self, spark: SparkSession, batches: int) -> DataFrame:
        """Steps that are refused after so many batches: (key, ts, seq, prev_stage, stage)."""
        rows = spark.read.option("basePath", f"{self.path}/verdicts").parquet(*[f"{self.path}/verdicts/batch={n}" for n in range(batches)])
        newest = rows.groupBy(self.key, "ts", "seq").agg(F.max(F.struct("batch", "stage", "prev_stage")).alias("v"))
        return newest.select(self.key, "ts", "seq", "v.prev_stage", "v.stage").where(self._refused())
