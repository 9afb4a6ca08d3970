"""Roll-ups behind the filing views: grouped clients, boards, feeds and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalar as S
from .joins import split_join


# --- derivations ------------------------------------------------------------------------------------------
def ledger_status(status: Column) -> Column:
    u = F.upper(status)
    return (
        F.when(F.coalesce(status, F.lit("")) == "", "pending").when(u.isin("EXTRACTED", "VALIDATED"), "approved")
        .when(u == "RECEIVED", "processing").when(u == "ERROR", "exception").otherwise("processing"))


def upload_stage(status: Column, gate: Column, n_exceptions: Column, needs_review: Column) -> Column:
    return (
        F.when(status == "queued", "Queued").when(status == "processing", "AI Processing")
        .when(status == "error", F.when(gate, "Gate Rejected").otherwise("Error"))
        .when(status == "completed", F.when(n_exceptions > 0, "Exception Review").when(needs_review, "CPA Review").otherwise("Complete"))
        .otherwise("—"))


def upload_status(status: Column, n_exceptions: Column) -> Column:
    return (
        F.when(status == "queued", "pending").when(status == "processing", "processing").when(status == "error", "exception")
        .when(status == "completed", F.when(n_exceptions > 0, "exception").otherwise("approved")).otherwise("pending"))


def event_status(event: Column) -> Column:
    return S.lookup(V.EVENT_STATUS, event)


def board_column(stage: Column) -> Column:
    return S.lookup(V.STAGE_TO_COLUMN, stage, "AI Processing")


def summary_step(stage: Column) -> Column:
    return S.lookup(V.SUMMARY_STEP, stage, 0)


def display_severity(severity: Column) -> Column:
    u = F.upper(severity)
    return F.when(u.isin("CRITICAL", "BLOCKING"), "HIGH").when(u == "WARNING", "MEDIUM").otherwise("LOW")


def exception_type(code: Column) -> Column:
    c = F.upper(code)
    return (
        F.when(c.rlike("MISMATCH|VARIANCE|GT|LT|NEQ"), "Data Mismatch").when(c.rlike("MISSING|ZERO|BLANK|NULL"), "Missing Field")
        .when(c.rlike("CALC|MATH|SUM"), "Calculation Variance").when(c.rlike("IRS|FLAG|RULE|SALT"), "IRS Rule Flag")
        .when(c.rlike("YEAR|DATE|PRIOR"), "Prior Year Conflict").otherwise("Exception"))


CATEGORY_CHIPS = {  # fixed values: chip -> code fragments
    "Data Mismatch": "MISMATCH|NEQ|GT|LT|VARIANCE", "Missing Doc": "MISSING|ZERO|BLANK|NULL", "Calculation": "CALC|MATH|SUM",
    "IRS Flag": "IRS|FLAG|RULE|SALT",
}


def in_category(code: Column, chip: str) -> Column:
    return F.lit(True) if chip == "All Types" else F.upper(code).rlike(CATEGORY_CHIPS[chip])


def log_filter(action: Column, chip: str) -> Column:
    a = F.upper(F.coalesce(action, F.lit("")))
    return {"All": F.lit(True), "Errors": a.contains("ERROR"), "Warnings": a.contains("WARN"),
            "Completed": a.contains("COMPLETE") | a.contains("SUCCESS")}[chip]


def activity_action(kind: Column, status: Column) -> Column:
    return (
        F.when(kind == "exception_escalated", "Exception Escalated").when(status == "VALIDATED", "Validation Completed")
        .when(status == "EXTRACTED", "Document Ingested").when(status != "", F.replace(status, F.lit("_"), F.lit(" ")))
        .otherwise("Pipeline Update"))


def activity_actor(kind: Column) -> Column:
    return F.when(kind == "exception_escalated", "CPA").otherwise("System")


# --- grouped filing table -----------------------------------------------------------------------------------
def ledger_rows(ledger: DataFrame, *keep: str) -> DataFrame:
    """Ledger records shaped for the filing views."""
    return ledger.select(
        *keep,
        F.coalesce("client_name", "document_id").alias("name"), F.coalesce("document_type", F.lit("—")).alias("form"),
        F.coalesce("stage", F.lit("AI Processing")).alias("stage"), ledger_status(F.col("status")).alias("status"),
        S.confidence_percent(F.col("confidence_score")).alias("conf"), "document_id", F.lit(True).alias("from_ledger"))


def merge_live(ledger: DataFrame, live: DataFrame) -> DataFrame:
    """Ledger rows plus live rows that are in the ledger neither by document id nor by client name."""
    ids = ledger.where(F.col("document_id") != "").select("document_id").distinct()
    names = ledger.select(S.norm_name(F.col("name")).alias("_k")).distinct()
    rest = split_join(live.join(ids, "document_id", "left_anti").withColumn("_k", S.norm_name(F.col("name"))), names, "_k", "left_anti").drop("_k")
    return ledger.unionByName(rest)


def by_form_chip(rows: DataFrame, chip: str) -> DataFrame:
    return rows if chip == "All Types" else rows.where(F.col("form").contains(chip))


def grouped_clients(rows: DataFrame) -> DataFrame:
    """One row per client: number of forms, leading status, furthest stage, mean confidence, shown name.

    ``rows`` carry a ``pos`` for first-wins ties. All aggregates combine before the shuffle.
    """
    stage_rank = S.lookup({s: i for i, s in enumerate(V.STAGE_ORDER)}, F.col("stage"), -1)
    status_rank = S.lookup(V.STATUS_PRIORITY, F.col("status"), 0)
    caps = (F.col("name") == F.upper("name")).cast("int")
    g = rows.withColumn("client_key", S.norm_name(F.coalesce("name", F.lit("—")))).groupBy("client_key").agg(
        F.count("*").alias("n_forms"), F.min_by("name", F.struct(caps.alias("c"), F.col("pos"))).alias("display_name"),
        F.max_by("status", status_rank).alias("status"),
        F.min_by("stage", F.struct((-stage_rank).alias("r"), F.col("pos"))).alias("stage"),
        F.floor(F.sum("conf") / F.nullif(F.count("conf"), F.lit(0)) + 0.5).cast("bigint").alias("avg_conf"),
        F.max("from_ledger").alias("has_ledger"))
    return g


def with_lifecycle(groups: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return groups.join(lifecycle.withColumnRenamed("key", "client_key"), "client_key", "left").withColumn(
        "lifecycle_stage", F.coalesce("lifecycle_stage", F.lit("—")))


def board_counts(rows: DataFrame) -> DataFrame:
    """Cards per board column, empty columns included."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(i, c) for i, c in enumerate(V.STAGE_ORDER)], "col_order int, board_column string")
    n = rows.groupBy(board_column(F.col("stage")).alias("board_column")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(n, "board_column", "left").select("board_column", "col_order", F.coalesce("n", F.lit(0)).alias("n"))


def dashboard_counts(files: DataFrame) -> DataFrame:
    """Queued, processing, in exception review and complete files (status, n_exceptions)."""
    s, n = F.col("status"), F.col("n_exceptions")
    return files.agg(F.count_if(s == "queued").alias("queued"), F.count_if(s == "processing").alias("processing"),
                     F.count_if(n > 0).alias("exception_review"), F.count_if((s == "completed") & (n == 0)).alias("complete"))


# --- client page -------------------------------------------------------------------------------------------------
def document_rows(uploads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Uploads plus ledger rows whose document id no upload carries."""
    seen = uploads.where(F.col("document_id") != "").select("client_key", "document_id").distinct()
    rest = ledger.join(seen, ["client_key", "document_id"], "left_anti")
    return uploads.withColumn("kind", F.lit("upload")).unionByName(rest.withColumn("kind", F.lit("ledger")), allowMissingColumns=True)


def client_summary(rows: DataFrame) -> DataFrame:
    """Counts, stage and confidence per client (client_key, pos, kind, stage, conf, exceptions, validation, ts, action)."""
    rank = S.lookup(V.SUMMARY_STAGE_RANK, F.col("stage"), 0)
    # of equally advanced stages the first row's counts
    best = F.min_by(F.struct(rank.alias("r"), F.when(rank > 0, F.col("stage")).otherwise("Document Collection").alias("s")), F.struct(-rank, F.col("kind") != "upload", "pos"))
    upload = F.col("kind") == "upload"
    return rows.groupBy("client_key").agg(
        best.alias("b"), F.floor(F.sum("conf") / F.nullif(F.count("conf"), F.lit(0)) + 0.5).cast("bigint").alias("avg_confidence"),
        F.count("*").alias("total_docs"), F.count_if(upload).alias("uploaded"),
        F.count_if(~upload | (F.col("stage") != "Document Collection")).alias("processed"),
        F.count_if(F.col("validation") == "Validated").alias("validated"),
        F.count_if((F.coalesce("exceptions", F.lit(0)) > 0) | (F.col("validation") == "Needs review")).alias("needs_review"),
        F.sum(F.coalesce("exceptions", F.lit(0))).cast("bigint").alias("open_exceptions"),
        F.max_by("action", F.struct("ts", "action")).alias("latest_action"),
    ).select("*", F.col("b.s").alias("stage"), F.col("b.r").cast("bigint").alias("stage_rank")).drop("b")


def forms_text(rows: DataFrame) -> DataFrame:
    """The first four distinct forms per client (by first appearance), with a mark when there are more.

    Distinct (client, form) pairs are reduced first; ranking stops at the fifth form of a client.
    """
    pairs = rows.where(~F.coalesce(F.trim("form"), F.lit("")).isin("", "—")).groupBy("client_key", F.trim("form").alias("form")).agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("client_key").orderBy("pos", "form")
    top = pairs.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "form"))), lambda x: x["form"])
    g = top.groupBy("client_key").agg(listed.alias("l"))
    return g.select("client_key", F.concat(F.array_join(F.slice("l", 1, 4), ", "), F.when(F.size("l") > 4, ", ...").otherwise("")).alias("forms_text"))


def narrative(summary: DataFrame, forms: DataFrame) -> DataFrame:
    """Facts of the client overview as text lines."""
    d = summary.join(forms, "client_key", "left")
    n = lambda c: F.col(c).cast("string")
    return d.select(
        "client_key",
        F.concat(F.lit("Linked documents: "), n("total_docs"), F.lit(" ("), F.coalesce("forms_text", F.lit("mixed tax documents")), F.lit(")")).alias("documents_line"),
        F.when(F.col("needs_review") > 0, F.concat(n("needs_review"), F.lit(" document(s) require review, with "), n("open_exceptions"), F.lit(" open exception(s)")))
        .otherwise(F.concat(n("validated"), F.lit(" document(s) validated with no active exception backlog"))).alias("review_line"),
        F.when(F.col("avg_confidence").isNotNull(), F.concat(F.lit("Average confidence: "), n("avg_confidence"), F.lit("%")))
        .otherwise("Average confidence: still being established").alias("confidence_line"))


def latest_per_client(rows: DataFrame, *columns: str) -> DataFrame:
    """Newest row per client as a combinable maximum."""
    return rows.groupBy("client_key").agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("r")).select("client_key", "r.*")


def activity_feed(entries: DataFrame, limit: int = 60, per_client: bool = False) -> DataFrame:
    """Newest entries first, entries without a time last. The per-client form ranks with an early limit."""
    order = [F.desc_nulls_last("ts"), F.col("seq").asc()]
    if not per_client:
        return entries.orderBy(*order).limit(limit)
    w = Window.partitionBy("client_key").orderBy(*order)
    return entries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


# --- boards and reports ----------------------------------------------------------------------------------------------
def exception_board(docs: DataFrame) -> DataFrame:
    """Total, affected documents and mean document confidence, from rows with ``exceptions`` and ``document_confidence``.

    A code counts once per field of a document. One pass over the documents.
    """
    pairs = F.size(F.array_distinct(F.transform("exceptions", lambda e: F.struct(e["code"], e["field"])))).cast("bigint")
    cents = F.when(F.col("document_confidence") != 0, F.round(F.col("document_confidence") * 1000).cast("bigint"))
    rows = docs.select(F.nullif(pairs, F.lit(0)).alias("n"), cents.alias("c"))
    return rows.agg(F.sum("n").alias("total"), F.count("n").alias("affected"), F.floor(F.sum("c") / F.nullif(F.count("c"), F.lit(0)) / 10 + 0.5).cast("bigint").alias("avg_conf"))


def exception_rollup(exceptions: DataFrame) -> DataFrame:
    """Exception counts by category, form and severity with all subtotals."""
    # counted once before the cube copies rows to every subtotal
    counts = exceptions.groupBy("category", "form_type", "severity").count()
    return counts.cube("category", "form_type", "severity").agg(
        F.sum("count").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def filing_rollup(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("form", "stage", "name").count()
    return counts.rollup("form", "stage").agg(F.sum("count").alias("n_docs"), F.countDistinct("name").alias("n_clients"), F.grouping_id().cast("bigint").alias("level"))


def workload(rows: DataFrame) -> DataFrame:
    """Open documents and distinct clients per preparer."""
    per_client = rows.groupBy(F.coalesce("cpa", F.lit("—")).alias("cpa"), "client_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "VALIDATED").alias("open"))
    return per_client.groupBy("cpa").agg(
        F.sum("n").alias("n_docs"), F.count("client_name").alias("n_clients"), F.sum("open").alias("n_open"))


def session_stats(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions per stage: all and not yet expired."""
    live = F.col("expires_at") > now
    return sessions.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(live).alias("active"))


def field_quality(scores: DataFrame) -> DataFrame:
    """High (> .95), medium (.85 to .95) and low (< .85) fields per document."""
    s = F.col("score")
    return scores.groupBy("doc_id").agg(F.count_if(s > 0.95).alias("high"), F.count_if((s >= 0.85) & (s <= 0.95)).alias("medium"), F.count_if(s < 0.85).alias("low"))


def batch_summary(docs: DataFrame) -> DataFrame:
    """Automated, partial and manual documents by triage and review mark."""
    c, r = F.col("confidence"), F.col("needs_review")
    return docs.groupBy("form_type").agg(
        F.count_if((c == "HIGH") & ~r).alias("automated"), F.count_if((c != "LOW") & ~((c == "HIGH") & ~r)).alias("partial"),
        F.count_if(c == "LOW").alias("manual"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """Repeatable sample of n rows: smallest hashes of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


# --- reconciliation --------------------------------------------------------------------------------------------------
def w2_to_1040(w2: DataFrame, returns: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Wages and withholding of a client-year's W-2s against the return's lines."""
    m = lambda c: F.sum(S.money(F.col(c)))
    w = w2.groupBy("client_id", "tax_year").agg(m("wages").alias("w2_wages"), m("withheld").alias("w2_withheld"))
    j = w.join(returns, ["client_id", "tax_year"])
    near = lambda a, b: F.abs(F.col(a) - S.money(F.col(b))) <= tolerance
    return j.select("client_id", "tax_year", F.col("w2_wages").cast("double").alias("w2_wages"), "line_1a", F.col("w2_withheld").cast("double").alias("w2_withheld"), "line_33",
                    near("w2_wages", "line_1a").alias("wages_match"), near("w2_withheld", "line_33").alias("withholding_match"))


def autofill_income(docs: DataFrame, standard_deduction: float = 14600.0) -> DataFrame:
    """1040 income lines of a client-year from its source documents (form_type, amount, withheld)."""
    a = S.money(F.col("amount"))
    pick = lambda *forms: F.coalesce(F.sum(F.when(F.col("form_type").isin(*forms), a)), F.lit(0).cast("decimal(20,2)"))
    g = docs.groupBy("client_id", "tax_year").agg(
        pick("W-2").alias("wages"), pick("1099-INT").alias("interest"), pick("1099-DIV").alias("dividends"), pick("1099-B").alias("gains"),
        pick("1099-NEC", "1099-MISC").alias("business"), F.coalesce(F.sum(S.money(F.col("withheld"))), F.lit(0)).alias("withheld"))
    total = F.col("wages") + F.col("interest") + F.col("dividends") + F.col("gains") + F.col("business")
    d = g.withColumn("total_income", total)
    taxable = F.greatest(F.col("total_income") - F.lit(standard_deduction).cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    d = d.withColumn("taxable_income", taxable)
    money = ["wages", "interest", "dividends", "gains", "business", "withheld", "total_income", "taxable_income"]
    return d.select("client_id", "tax_year", *[F.col(c).cast("double").alias(c) for c in money])
