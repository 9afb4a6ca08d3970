"""Versioned document ledger as a segmented scan over the submission log.

A ledger document is one (client, document type). Its number is short (32 bits), so two documents may share one:
state is kept per client and type, never per number alone. Its running state (upload count, version, carried
values) is a prefix computation in time order. A plain window would put all submissions of a document
into one task, and one busy document, or one bulk load of it within an hour, can hold a large share of the
log. So the log is cut by rank: ranges of (document, time, sequence) that hold about as many rows each are
the chunks. Windows run inside (document, chunk), a small table of chunk totals, which carry the state from
chunk to chunk, is scanned per document, and the totals are joined back on the key the rows are partitioned by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalar as S
from ..session import shared_dir

CARRIED = ["cpa", "due_date", "confidence_score", "local_json_path", "client_id"]
OVERWRITTEN = ["stage", "status", "provider", "description", "tax_year"]
DOCUMENT = ["document_id", "client_key", "document_type"]  # what a document is known by; the number alone may stand for two
COLUMNS = {
    "provider": "string", "description": "string", "source": "string", "tax_year": "int", "stage": "string",
    "status": "string", "cpa": "string", "due_date": "string", "confidence_score": "double",
    "local_json_path": "string", "client_id": "string",
}


def _json_text(c: Column, number: bool = False) -> Column:
    body = F.to_json(F.struct(c.alias("v")))
    quoted = c.cast("string") if number else F.substring(body, 6, 1_000_000_000)
    return F.when(c.isNull(), F.lit("null")).otherwise(quoted if number else F.left(quoted, F.length(quoted) - 1))


def content_text(name: Column) -> Column:
    """Content of a submission as JSON with sorted keys; equal text means equal content."""
    return F.concat(
        F.lit('{"client_name": '), _json_text(name), F.lit(', "document_type": '), _json_text(F.col("document_type")),
        F.lit(', "source": '), _json_text(F.col("source")), F.lit(', "stage": '), _json_text(F.col("stage")),
        F.lit(', "status": '), _json_text(F.col("status")), F.lit(', "tax_year": '),
        _json_text(F.col("tax_year"), number=True), F.lit("}"),
    )


def document_id(client_key: Column, document_type: Column) -> Column:
    """Stable number of a (client, document type); of a few hundred thousand documents some share theirs."""
    return F.concat(F.lit("DOC-"), F.upper(F.left(F.sha2(F.concat_ws("|", client_key, document_type), 256), F.lit(8))))


def prepare(submissions: DataFrame) -> DataFrame:
    """Add keys and defaults to raw submissions (client_name, document_type, ts, seq [, other columns])."""
    d = submissions
    for c, t in COLUMNS.items():
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast(t))
    d = d.withColumns({
        "client_name": S.strip(F.coalesce("client_name", F.lit(""))),
        "document_type": F.coalesce("document_type", F.lit("Unknown")),
        "stage": F.coalesce("stage", F.lit("Document Submission")),
        "status": F.coalesce("status", F.lit("RECEIVED")), "kind": F.lit("submit"),
        # an empty path or client id never overwrites a stored one
        "local_json_path": F.nullif("local_json_path", F.lit("")), "client_id": F.nullif("client_id", F.lit("")),
    })
    d = d.withColumn("client_key", F.lower("client_name"))
    return d.withColumn("document_id", document_id(F.col("client_key"), F.col("document_type")))


def status_updates(updates: DataFrame, like: DataFrame) -> DataFrame:
    """Status events (document_id, status, ts, seq) shaped like prepared submissions, on the document among them that had the number first."""
    first = F.min_by(F.struct(*DOCUMENT[1:]), F.struct("ts", "seq"))
    owners = like.where("kind = 'submit'").groupBy("document_id").agg(first.alias("_own")).select("document_id", "_own.*")
    u = updates.join(owners, "document_id", "left").withColumn("kind", F.lit("status"))
    missing = [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns if c not in u.columns]
    return u.select(*[c for c in u.columns if c in like.columns], *missing).select(like.columns)


CHUNK_ROWS = 500_000


def _chunked(d: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """Add ``chunk``, a number that never falls along (keys, ts, seq): by rank, or by a unit of time.

    ``rows`` cuts the log in ranges of equal row counts and stores it, for the cut must not change when rows are read again. A unit of time
    needs no pass of its own; it suits a stream, whose batches are bounded. Events without a time come first, after an earlier state.
    """
    if chunk != "rows":
        return d.withColumn("chunk", F.coalesce(F.unix_micros(F.date_trunc(chunk, "ts")), F.lit(-(1 << 62)).cast("long")))
    spark, path = d.sparkSession, shared_dir(d.sparkSession, "log")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.count() // CHUNK_ROWS + 1)
    d.repartitionByRange(ranges, *keys, "ts", "seq").withColumn("chunk", F.spark_partition_id().cast("long")).write.parquet(path)
    return spark.read.schema(StructType([*d.schema.fields, StructField("chunk", LongType())])).parquet(path)


def history(prepared: DataFrame, chunk: str = "rows", prior: DataFrame | None = None) -> DataFrame:
    """Every event with upload_count, version, content_changed and carried values after the event.

    ``prior`` is an earlier ledger state (see ``running_state``); it enters as the oldest chunk total of its
    document, so a stream can continue where the last batch ended.
    """
    key = [*DOCUMENT, "chunk"]
    d = _chunked(prepared, DOCUMENT, chunk).withColumn("at", F.struct("ts", "seq"))
    submit = F.col("kind") == "submit"
    # the client name is constant per document up to case, so it does not take part in the comparison
    sig = F.when(submit, F.to_json(F.struct("source", "stage", "status", "tax_year"), {"ignoreNullFields": "false"}))
    d = d.withColumn("sig", sig)
    w = Window.partitionBy(*key).orderBy("ts", "seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("n_local", F.sum(submit.cast("long")).over(upto)).withColumn(
        "prev_sig", F.last("sig", ignorenulls=True).over(before))
    changed_here = submit & F.col("prev_sig").isNotNull() & (F.col("sig") != F.col("prev_sig"))
    local = local.withColumn("chg", changed_here.cast("long"))
    local = local.withColumns({
        "v_local": F.sum("chg").over(upto),
        **{f"l_{c}": F.last(c, ignorenulls=True).over(upto) for c in CARRIED},
    })

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"p_{c}")

    totals = local.groupBy(*key).agg(
        F.sum(submit.cast("long")).alias("n"), F.sum("chg").alias("n_chg"),
        F.min_by("sig", F.when(submit, F.col("at"))).alias("first_sig"),
        F.max_by("sig", F.when(submit, F.col("at"))).alias("last_sig"), *[latest(c) for c in CARRIED])
    if prior is not None:
        totals = totals.unionByName(prior.select(
            *DOCUMENT, F.lit(-(1 << 63)).cast("long").alias("chunk"), F.col("upload_count").alias("n"),
            (F.col("version") - 1).alias("n_chg"), F.col("sig").alias("first_sig"), F.col("sig").alias("last_sig"),
            *[F.col(c).alias(f"p_{c}") for c in CARRIED]))
    cw = Window.partitionBy(*DOCUMENT).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before_sig", F.last("last_sig", ignorenulls=True).over(cw)).withColumn(
        "first_chg", (F.col("first_sig").isNotNull() & ~F.col("first_sig").eqNullSafe(F.col("before_sig"))).cast("long"))
    totals = totals.select(
        *key, "first_chg", F.coalesce(F.sum("n").over(cw), F.lit(0)).alias("base_n"),
        F.coalesce(F.sum(F.col("n_chg") + F.col("first_chg")).over(cw), F.lit(0)).alias("base_v"),
        *[F.last(f"p_{c}", ignorenulls=True).over(cw).alias(f"c_{c}") for c in CARRIED])
    j = local.join(totals, key)
    first_submit = submit & F.col("prev_sig").isNull()
    started = F.when(F.col("n_local") > 0, F.col("first_chg")).otherwise(F.lit(0))
    out = j.withColumns({
        "upload_count": F.col("base_n") + F.col("n_local"),
        "version": F.col("base_v") + started + F.col("v_local"),
        "content_changed": F.when(submit, F.when(first_submit, F.col("first_chg") == 1).otherwise(F.col("chg") == 1)),
    })
    drop = ["chunk", "n_local", "prev_sig", "chg", "v_local", "first_chg", "base_n", "base_v",
            *[f"l_{c}" for c in CARRIED], *[f"c_{c}" for c in CARRIED]]
    # a status event on a document that does not exist yet has no effect
    return out.withColumns({c: F.coalesce(f"l_{c}", f"c_{c}") for c in CARRIED}).where("upload_count > 0").drop(*drop)


def running_state(hist: DataFrame) -> DataFrame:
    """What a later batch needs to continue: counters, last content, carried values, newest event time."""
    submit = F.col("kind") == "submit"
    g = hist.groupBy(*DOCUMENT).agg(
        F.max("upload_count").alias("upload_count"), F.max("version").alias("version"),
        F.max_by("sig", F.when(submit, F.col("at"))).alias("sig"), F.max_by(F.struct(*CARRIED), "at").alias("kept"),
        F.max_by("status", "at").alias("status"), F.max("ts").alias("last_ts"))
    return g.select(*DOCUMENT, "upload_count", "version", "sig", "kept.*", "status", "last_ts")


def canonical_names(prepared: DataFrame) -> DataFrame:
    """First spelling of each client name."""
    return prepared.where("kind = 'submit' and client_key <> ''").groupBy("client_key").agg(
        F.min_by("client_name", F.struct("ts", "seq", "client_name")).alias("canonical_name"))


def current(hist: DataFrame) -> DataFrame:
    """Latest state per document: first source, last stage/status/etc., carried values, counters."""
    submit = F.col("kind") == "submit"
    at, sub_at = F.col("at"), F.when(submit, F.col("at"))
    agg = hist.groupBy(*DOCUMENT).agg(
        F.min_by("client_name", sub_at).alias("client_name"), F.min_by(F.struct("source"), sub_at).alias("src"),
        F.max_by(F.struct(*[c for c in OVERWRITTEN if c != "status"]), sub_at).alias("last"),
        F.max_by("status", at).alias("status"), F.max_by(F.struct(*CARRIED), at).alias("kept"),
        F.max("upload_count").alias("upload_count"), F.max("version").alias("version"))
    return agg.select("document_id", "client_name", "client_key", "document_type", F.col("src.source").alias("source"),
                      "last.*", "status", "kept.*", "upload_count", "version")


def repaired_names(submissions: DataFrame) -> DataFrame:
    """(document_id, client_name): a stored name that is a document number or ``Unknown`` gives way to the next name that comes.

    Off by default: documents here are found by the client's name, so this matters where submissions bring their ``document_id``. The first proper
    name stays; without one the last name that came stands. One aggregate that combines map side.
    """
    name = S.strip(F.coalesce("client_name", F.lit("")))
    place = F.struct("ts", "seq")
    proper = (name != "") & ~name.startswith("DOC-") & (name != "Unknown")
    # an empty first name is no placeholder: it stays
    first_empty = F.min_by(name == "", place)
    agg = submissions.groupBy("document_id").agg(
        F.min_by(name, F.when(proper, place)).alias("proper"), F.max_by(name, F.when(name != "", place)).alias("last"), first_empty.alias("empty"))
    return agg.select("document_id", F.when(F.col("empty"), F.lit("")).otherwise(F.coalesce("proper", "last")).alias("client_name"))


def with_canonical(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Replace the client name by its first spelling and add the content hash."""
    d = docs.join(names, "client_key", "left").withColumn("client_name", F.coalesce("canonical_name", "client_name"))
    return d.drop("canonical_name").withColumn("content_hash", F.sha2(content_text(F.col("client_name")), 256))


def document_log(hist: DataFrame) -> DataFrame:
    """Rows of the append-only log: content changes and status updates."""
    return hist.where((F.col("kind") == "status") | F.col("content_changed"))


def audit_trail(hist: DataFrame) -> DataFrame:
    """Audit entries as rows; status entries carry no counters. Kept long, since a trail has no size limit."""
    status = F.col("kind") == "status"
    return hist.select(
        "document_id", "ts", "seq", F.col("kind").alias("entry"), F.col("stage"), "status",
        F.when(~status, F.col("upload_count")).alias("upload_count"), F.when(~status, F.col("version")).alias("version"),
        "content_changed")


def escalate(ledger: DataFrame, escalations: DataFrame) -> DataFrame:
    """Link escalations to ledger documents: by id, else by exact client name and document type."""
    by_id = ledger.select("document_id", F.lit(True).alias("id_hit")).distinct()
    by_name = ledger.groupBy("client_name", "document_type").agg(F.min("document_id").alias("name_hit"))
    j = escalations.join(by_id, "document_id", "left").join(by_name, ["client_name", "document_type"], "left")
    linked = F.when(F.col("id_hit"), F.col("document_id")).otherwise(F.col("name_hit"))
    return j.withColumn("linked_document_id", linked).withColumn("ledger_linked", linked.isNotNull()).drop("id_hit", "name_hit")


def with_escalations(trail: DataFrame, linked: DataFrame) -> DataFrame:
    """Audit trail with the escalations that found a document (see ``escalate``) as entries of their own."""
    rows = linked.where("ledger_linked").select(F.col("linked_document_id").alias("document_id"), "ts", "seq", F.lit("exception_escalated").alias("entry"))
    return trail.unionByName(rows, allowMissingColumns=True)


def correction_history(events: DataFrame, key: str, allowed: dict[str, list[str]], stage: str = "corrected") -> DataFrame:
    """Accepted corrections per session, numbered from 1: those taken from a stage that allows them."""
    mine = events.where(F.col("stage") == stage)
    refused = transitions(events, key, {stage: allowed[stage]}).select(F.col(key).alias("_key"), F.col("ts").alias("_ts"), F.col("seq").alias("_seq"))
    on = F.col(key).eqNullSafe(F.col("_key")) & F.col("ts").eqNullSafe(F.col("_ts")) & (F.col("seq") == F.col("_seq"))
    accepted = mine.join(refused, on, "left_anti")
    return accepted.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("ts", "seq")))


def set_json_path(table: DataFrame, paths: DataFrame) -> DataFrame:
    """New local path per document where one is given."""
    p = paths.where("document_id <> '' and local_json_path <> ''").groupBy("document_id").agg(
        F.max_by("local_json_path", "ts").alias("new_path"))
    return table.join(p, "document_id", "left").withColumn("local_json_path", F.coalesce("new_path", "local_json_path")).drop("new_path")


def split_by_client(submissions: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict mode: accepted and rejected submissions by an exact client key."""
    key = clients.select("client_key").distinct()
    return submissions.join(key, "client_key", "left_semi"), submissions.join(key, "client_key", "left_anti")


def as_of(hist: DataFrame, when: Column) -> DataFrame:
    """Ledger state at a point in time."""
    return current(hist.where(F.col("ts") <= when))


def numbers_as_of(hist: DataFrame, when: Column) -> DataFrame:
    """State of each document number at a point in time; documents that share a number give the latest status and the highest counters."""
    return hist.where(F.col("ts") <= when).groupBy("document_id").agg(
        F.max_by("status", "at").alias("status"), F.max("upload_count").alias("upload_count"), F.max("version").alias("version"))


def with_previous(events: DataFrame, key: str, value: str, chunk: str = "rows") -> DataFrame:
    """Add ``prev``: the ``value`` of the event before, by (ts, seq); same chunked scan as the ledger."""
    cols = events.columns
    d = _chunked(events, [key], chunk).withColumn("at", F.struct("ts", "seq"))
    w = Window.partitionBy(key, "chunk").orderBy("ts", "seq")
    local = d.withColumn("_lag", F.lag(value).over(w)).withColumn("rn", F.row_number().over(w))
    last = local.groupBy(key, "chunk").agg(F.max_by(value, "at").alias("_last"))
    cw = Window.partitionBy(key).orderBy("chunk")
    last = last.select(F.col(key).alias("_key"), F.col("chunk").alias("_chunk"), F.lag("_last").over(cw).alias("before"))
    j = local.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    return j.select(*cols, F.when(F.col("rn") == 1, F.col("before")).otherwise(F.col("_lag")).alias("prev"))


def transitions(events: DataFrame, key: str, allowed: dict[str, list[str]], chunk: str = "rows") -> DataFrame:
    """Stage changes that are not allowed, with the previous stage."""
    j = with_previous(events, key, "stage", chunk).withColumnRenamed("prev", "prev_stage")
    bad = None
    for stage, froms in allowed.items():
        cond = (F.col("stage") == stage) & ~F.coalesce(F.col("prev_stage").isin(froms), F.lit(False))
        bad = cond if bad is None else bad | cond
    return j.where(bad).select(key, "ts", "seq", "prev_stage", "stage")
