"""Streaming counterparts of the event, upload and session operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import DEFAULTS, Thresholds


def read_parquet_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """File stream over parquet files of a folder; the schema is taken from the files once."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Payload files as they arrive, with a mark for text that is no JSON object."""
    d = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    parsed = F.try_parse_json("value")
    return d.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("payload"),
                    (parsed.isNull() | ~F.trim("value").startswith("{")).alias("broken"))


def split_batches(good_path: str, bad_path: str, flag: str = "broken"):
    """foreachBatch writer that puts broken rows aside, one folder per batch so that a retry overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(~F.col(flag)).drop(flag).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        batch.where(flag).drop(flag).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")

    return write


def _closed_runs(cells: DataFrame, key: str, gap: float) -> DataFrame:
    """Join (key, first, last, n) that lie less than ``gap`` seconds apart."""
    before = Window.partitionBy(key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    seconds = lambda c: F.unix_micros(c)
    opens = F.coalesce(seconds(F.col("first")) - seconds(F.max("last").over(before)) >= int(gap * 1_000_000), F.lit(True))
    d = cells.withColumn("_opens", opens.cast("long")).withColumn("_run", F.sum("_opens").over(upto))
    return d.groupBy(key, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_run")


def activity_sessions(events: DataFrame, key: str, gap: float = 1800.0) -> DataFrame:
    """(key, first, last, n): runs of activity closed by a gap of ``gap`` seconds.

    Events of one key in one cell of the gap's length are less than a gap apart, so they are counted together first, map side: a busy key is
    as many rows as it has cells, however many events.
    """
    cell = F.floor(F.unix_micros("ts") / int(gap * 1_000_000))
    cells = events.where("ts IS NOT NULL").groupBy(key, cell.alias("_cell")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return _closed_runs(cells.drop("_cell"), key, gap)


class SessionTable:
    """Activity sessions of a stream as a table of disjoint intervals per key; no watermark, so an event counts however late it comes.

    A batch is first reduced to its own intervals. Those and the stored intervals of the same keys are joined where they touch: a late event may
    widen a session or close the gap between two. The batch's folder holds all intervals of the keys that it touched; every ``full_every``
    batches it holds all keys, and reading begins at the last such folder. A batch that is run again reads only folders before its own
    and overwrites its own.
    """

    def __init__(self, path: str, key: str, gap: float = 1800.0, full_every: int = 8):
        self.path, self.key, self.gap, self.full_every = path.rstrip("/"), key, gap, full_every

    def _stored(self, spark: SparkSession, before: int) -> DataFrame | None:
        """The latest intervals of every key from the folders before a batch."""
        if before <= 0:
            return None
        start = (before - 1) // self.full_every * self.full_every
        parts = [spark.read.parquet(f"{self.path}/out/batch={n}").withColumn("_batch", F.lit(n)) for n in range(start, before)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        newest = rows.groupBy(self.key).agg(F.max("_batch").alias("_batch"))
        return rows.join(newest.withColumnRenamed(self.key, "_k"), F.col(self.key).eqNullSafe(F.col("_k")) & (rows["_batch"] == newest["_batch"])).select(self.key, "first", "last", "n")

    def write(self, batch: DataFrame, number: int) -> None:
        new, old = activity_sessions(batch, self.key, self.gap), self._stored(batch.sparkSession, number)
        if old is not None:
            if number % self.full_every:
                touched = new.select(F.col(self.key).alias("_k")).distinct()
                old = old.join(touched, F.col(self.key).eqNullSafe(F.col("_k")), "left_semi")
            new = _closed_runs(old.unionByName(new), self.key, self.gap)
        new.write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Feed everything available, and return the sessions."""
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
        """Sessions after so many batches: (key, started, ended, n_events)."""
        gap = F.make_dt_interval(secs=F.lit(self.gap))
        rows = self._stored(spark, batches)
        if rows is None:
            raise ValueError("no batch has been written")
        return rows.select(self.key, F.col("first").alias("started"), (F.col("last") + gap).alias("ended"), F.col("n").alias("n_events"))


def fixed_sessions(events: DataFrame, minutes: int = DEFAULTS.session_minutes) -> DataFrame:
    """Events with the life of their session: a fixed time from its first event (batch form)."""
    created = events.groupBy("session_id").agg(F.min("ts").alias("created_at"))
    d = events.join(created, "session_id").withColumn("expires_at", F.col("created_at") + F.make_dt_interval(mins=F.lit(minutes)))
    return d.withColumn("live", F.col("ts") <= F.col("expires_at"))


class MergedTable:
    """A table that a stream feeds with partial aggregates, kept as runs that are merged by level.

    ``parts`` names each value, its aggregate within a batch, and how partial values are merged (``F.sum``, ``F.min`` ...).
    There is no engine state and no watermark: a row counts however late it comes, and a key is never forgotten.

    A batch leaves a run of level 0. When ``fan`` runs of a level are there they are merged to one of the next, so after n batches a reader
    scans fewer than ``fan`` runs per level, and each row is written again once per level. Which runs count follows from the number of batches: a
    merged run stands for its parts only once its folder is complete, so a merge that fails loses nothing; its parts go when a later batch begins,
    and a batch that is run again overwrites its own run and its own merges.
    """

    def __init__(self, path: str, keys: dict[str, Column], parts: dict[str, tuple], fan: int = 8):
        self.path, self.keys, self.parts, self.fan = path.rstrip("/"), keys, parts, fan

    def _folder(self, level: int, number: int) -> str:
        """The run of a level that holds batches number * fan^level and on."""
        return f"{self.path}/out/level={level}/run={number}"

    def _files(self, spark: SparkSession, folder: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def _complete(self, spark: SparkSession, folder: str) -> bool:
        fs, where = self._files(spark, f"{folder}/_SUCCESS")
        return fs.exists(where)

    def runs(self, spark: SparkSession, batches: int) -> list[str]:
        """The fewest complete runs that hold the first ``batches`` batches."""
        def cover(level: int, number: int) -> list[str]:
            if level == 0 or self._complete(spark, self._folder(level, number)):
                return [self._folder(level, number)]
            return [f for k in range(number * self.fan, (number + 1) * self.fan) for f in cover(level - 1, k)]

        out, at = [], 0
        while at < batches:
            level = 0
            while at % self.fan ** (level + 1) == 0 and at + self.fan ** (level + 1) <= batches:
                level += 1
            out += cover(level, at // self.fan**level)
            at += self.fan**level
        return out

    def _merged(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        rows = spark.read.parquet(*folders)
        return rows.groupBy(*self.keys).agg(*[merge(k).alias(k) for k, (_, merge) in self.parts.items()])

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        level = 1
        while number and number % self.fan**level == 0:  # the batch before is committed: what it merged is no longer needed in parts
            merged = number // self.fan**level - 1
            if self._complete(spark, self._folder(level, merged)):
                for k in range(merged * self.fan, (merged + 1) * self.fan):
                    fs, where = self._files(spark, self._folder(level - 1, k))
                    fs.delete(where, True)
            level += 1
        grouped = batch.groupBy(*[c.alias(k) for k, c in self.keys.items()])
        grouped.agg(*[partial.alias(k) for k, (partial, _) in self.parts.items()]).write.mode("overwrite").parquet(self._folder(0, number))
        level = 1
        while (number + 1) % self.fan**level == 0:
            run = (number + 1) // self.fan**level - 1
            parts = [self._folder(level - 1, k) for k in range(run * self.fan, (run + 1) * self.fan)]
            self._merged(spark, parts).write.mode("overwrite").parquet(self._folder(level, run))
            level += 1

    def run(self, stream: DataFrame) -> DataFrame:
        """Feed everything available, and return the merged table."""
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
        """The table after so many batches."""
        return self._merged(spark, self.runs(spark, batches))


def counted(path: str, keys: dict[str, Column], size: str) -> MergedTable:
    """Events per key and window ``w``; read with a filter on ``n`` it gives the windows over a limit."""
    return MergedTable(path, {**keys, "w": F.window("ts", size)}, {"n": (F.count("*"), F.sum)})


class SlidingCounts(MergedTable):
    """Events per key and sliding window of ``panes`` slides.

    What is kept is the count of each pane, the time from one slide to the next, so an event touches one pane however many windows hold it
    and however late it comes. Windows are summed from their panes when they are read.
    """

    def __init__(self, path: str, keys: dict[str, Column], slide: str, panes: int, fan: int = 8):
        super().__init__(path, {**keys, "pane": F.window("ts", slide)["start"]}, {"n": (F.count("*"), F.sum)}, fan)
        self.slide, self.panes, self.names = slide, panes, list(keys)

    def read(self, spark: SparkSession, batches: int) -> DataFrame:
        """(keys, window_start, n) for every window that holds an event."""
        back = F.explode(F.array(*[F.col("pane") - F.expr(f"interval {self.slide}") * k for k in range(self.panes)]))
        # panes first: their merged counts are few beside the events
        held = super().read(spark, batches).where("pane IS NOT NULL")
        return held.select(*self.names, back.alias("window_start"), "n").groupBy(*self.names, "window_start").agg(F.sum("n").alias("n"))


def first_seen(path: str, keys: dict[str, Column], time: str = "ts") -> MergedTable:
    """First time of each key."""
    return MergedTable(path, keys, {"first_ts": (F.min(time), F.min)})


def live_at(expires: Column, now: Column) -> Column:
    return expires > now
