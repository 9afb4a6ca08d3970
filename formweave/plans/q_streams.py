"""Registered queries: streams run over the event table to completion, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import keyed as K
from ..streaming import streams as ST
from ..streaming.ledger_stream import LedgerStream
from . import inputs as I
from . import q_context as QC
from . import q_ledger as QL

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql):
    QUERIES[name] = run
    ORACLE[name] = sql


PIECES = 6


def _shuffled(s, d):
    """The event table as files dealt by a hash, read one per micro-batch: events arrive far out of order."""
    folder = shared_dir(s, "pieces")
    events = I.table(s, d, "events").withColumn("piece", F.pmod(F.xxhash64("event_id"), F.lit(PIECES)))
    events.repartition(PIECES, "piece").write.partitionBy("piece").parquet(folder)
    stream = s.readStream.schema(events.drop("piece").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_ledger(s, d):
    raw = s.sql(QL.SUB_SQL, events=_shuffled(s, d))
    led = LedgerStream(shared_dir(s, "ledger"))
    q = led.start(raw, availableNow=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return led.history(s).select("document_id", "ts", "seq", "upload_count", "version", "content_changed")


_add("stream_ledger", stream_ledger, QL.ORACLE["ledger_versions"])
def _counted(s, d, label, keys, size):
    return ST.counted(shared_dir(s, label), {k: F.col(k) for k in keys}, size).run(_shuffled(s, d)).withColumn("window_start", F.col("w.start"))


_add("stream_attempts", lambda s, d: _counted(s, d, "attempts", ["user_id"], "3 days").where("n > 10").select("user_id", "window_start", F.col("n").alias("attempts")),
     "select user_id, time_bucket(interval '3 days', ts, timestamp '1970-01-01') as window_start, count(*) as attempts from events group by 1, 2 having count(*) > 10")
_add("stream_event_counts", lambda s, d: _counted(s, d, "counts", ["event_type"], "6 hours").select("window_start", "event_type", "n"),
     "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n from events group by 1, 2")
_add("stream_dedup", lambda s, d: ST.first_seen(shared_dir(s, "dedup"), {"doc_hash": F.col("props")}).run(_shuffled(s, d)),
     "select props as doc_hash, min(ts) as first_ts from events group by 1")
_add("stream_new_tins", lambda s, d: ST.first_seen(shared_dir(s, "tins"), {"client_id": F.col("user_id"), "tin": F.col("props")}).run(_shuffled(s, d)),
     "select user_id as client_id, props as tin, min(ts) as first_ts from events group by 1, 2")
_add("stream_sessions", lambda s, d: ST.first_seen(shared_dir(s, "sessions"), {"session_id": F.col("user_id")}).run(_shuffled(s, d)).select("session_id", F.col("first_ts").alias("created_at"), (F.col("first_ts") + F.expr("interval 30 minutes")).alias("expires_at")),
     "select user_id as session_id, min(ts) as created_at, min(ts) + interval '30' minute as expires_at from events group by 1")
_add("fixed_sessions", lambda s, d: ST.fixed_sessions(I.table(s, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH")).alias("session_id"), "ts", "event_id")).select("event_id", "session_id", "live"),
     "with e as (select event_id, ts, user_id || '-' || strftime(ts, '%Y%m%d%H') as session_id from events), c as (select session_id, min(ts) as c from e group by 1) select event_id, session_id, ts <= c + interval '30' minute as live from e join c using (session_id)")
_add("activity_sessions", lambda s, d: ST.SessionTable(shared_dir(s, "activity"), "user_id", 12 * 3600, full_every=4).run(_shuffled(s, d)),
     """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12' hour then 0 else 1 end as b from events), n as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
 select user_id, min(ts) as started, max(ts) + interval '12' hour as ended, count(*) as n_events from n group by user_id, sid""")
_add("stream_attempts_sliding", lambda s, d: ST.SlidingCounts(shared_dir(s, "panes"), {"user_id": F.col("user_id")}, "12 hours", 4).run(_shuffled(s, d)).where("n > 10").select(F.col("user_id").alias("doc_id"), "window_start", F.lit("SEC_EXCESS_ATTEMPTS").alias("code"), F.col("n").alias("attempts")),
     QC.ORACLE["excess_attempts_sliding"])


def stream_live_sessions(s, d):
    """Sessions by user and hour, live for 30 minutes from their first event, judged as events come in any order."""
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHH"))
    events = _shuffled(s, d).select(session.alias("session_id"), "ts", F.col("event_id").alias("seq"))
    return K.LiveSessions(shared_dir(s, "live"), "session_id").run(events).select(F.col("seq").alias("event_id"), "session_id", "live")


_add("stream_live_sessions", stream_live_sessions, ORACLE["fixed_sessions"])


def stream_transitions(s, d):
    """Steps that do not follow a stage they may follow, as a stream whose steps come in any order."""
    return K.StageGate(shared_dir(s, "gate"), "user_id", QL.ALLOWED, minutes=3 * 24 * 60).run(s.sql(QL._STAGE_SQL, events=_shuffled(s, d)))


_add("stream_transitions", stream_transitions, QL.ORACLE["status_transitions"])
