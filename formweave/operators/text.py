"""Gate scoring, routing and segmentation of document text. All map-side except per-document roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from .records import settle

# a match holds fewer units than this; a unit is a run of blanks and hyphens, a number, or another character
EDGE_UNITS = 64
_EDGE = rf"^(?:[\s-]++|[0-9]++|[^\s0-9-]){{0,{EDGE_UNITS}}}+"


def signals(text: Column) -> dict[str, Column]:
    """Raw findings of a text; each pattern is searched once."""

    def first(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    return {
        "omb_number": first(V.OMB_PATTERN), "form_type": F.upper(first(V.FORM_PATTERN)),
        "agency": text.rlike(V.AGENCY_PATTERN), "tax_year": first(V.YEAR_PATTERN).cast("int"),
        "keywords": F.regexp_count(text, F.lit(V.KEYWORD_PATTERN)),
    }


def verdict(df: DataFrame, length: Column, t: Thresholds = DEFAULTS) -> DataFrame:
    """Score and decision from finding columns; ``length`` is the trimmed text length."""
    w = V.GATE_WEIGHTS
    omb, form, year = F.col("omb_number"), F.col("form_type"), F.col("tax_year")
    agency, kw = F.coalesce("agency", F.lit(False)), F.coalesce("keywords", F.lit(0))

    def pts(cond: Column, name: str) -> Column:
        return F.when(cond, w[name]).otherwise(0)

    short = F.coalesce(length, F.lit(0)) < 10
    raw = pts(omb.isNotNull(), "omb") + pts(form.isNotNull(), "form") + pts(agency, "agency") + pts(year.isNotNull(), "year") + pts(kw >= 3, "keywords")
    score = F.when(short, 0).otherwise(raw)
    found = F.array_compact(F.array(
        F.concat(F.lit("OMB: "), omb), F.concat(F.lit("Form: "), form), F.when(agency, F.lit("IRS Agency identified")),
        F.concat(F.lit("Year: "), year.cast("string")), F.when(kw >= 3, F.concat(F.lit("IRS Keywords ("), kw.cast("string"), F.lit(")")))))
    keep = [c for c in df.columns if c not in ("omb_number", "form_type", "agency", "tax_year", "keywords")]

    def unless_short(c: Column) -> Column:
        return F.when(~short, c)

    return df.select(
        *keep, score.cast("int").alias("score"), (score >= t.gate_pass).alias("is_tax_form"), unless_short(form).alias("form_type"),
        unless_short(year).alias("tax_year"), unless_short(omb).alias("omb_number"),
        F.when(short, F.array().cast("array<string>")).otherwise(found).alias("signals_found"),
        F.when(short, "Insufficient text extracted to identify document.")
        .when(score < t.gate_pass, "Document recognition confidence too low.").alias("rejection_reason"))


def gate(df: DataFrame, text: str = "text", t: Thresholds = DEFAULTS) -> DataFrame:
    """Tax-form score of whole texts, one map-only pass."""
    body = F.coalesce(text, F.lit(""))
    cols = signals(body)
    d = settle(df, _len=F.length(S.strip(body)), **cols)
    return verdict(d, F.col("_len"), t).drop("_len")


def _edge(text: Column, side: str) -> Column:
    """The last or first units of a page text. A cut edge is closed with a word character, so no match begins or ends there."""
    if side == "tail":
        cut = F.regexp_extract(F.reverse(text), _EDGE, 0)
        return F.when(F.length(cut) < F.length(text), F.concat(F.lit("_"), F.reverse(cut))).otherwise(text)
    cut = F.regexp_extract(text, _EDGE, 0)
    return F.when(F.length(cut) < F.length(text), F.concat(cut, F.lit("_"))).otherwise(text)


def gate_pages(pages: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Gate of multi-page documents, equal to that of the pages joined by line feeds, without shuffling their text.

    Pages are searched where they are read; only findings and page edges of ``EDGE_UNITS`` units are shuffled, more than
    any match holds. The end of a page is put together with the beginnings of the pages that follow, up to the first that is
    longer than its edge. Blank pages belong to the page before them, as a longer break; gaps in the numbering do not matter.
    The first finding in page order wins and keyword counts add up; a keyword across pages counts where it begins.
    Text shorter than 50 characters fails open as a scan.
    """
    body = F.coalesce("text", F.lit(""))
    own = settle(pages, **signals(body), _len=F.length(S.strip(body)), _blank=~body.rlike(r"\S"), _tail=_edge(body, "tail"), _head=_edge(body, "head")).drop("text")
    in_order = Window.partitionBy("doc_id").orderBy("page")
    own = own.withColumn("_no", F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(in_order))
    blanks = own.where("_blank").groupBy("doc_id", "_no").agg(F.sort_array(F.collect_list(F.struct("page", F.concat(F.lit("\n"), "_head").alias("t")))).alias("_b"))
    blanks = blanks.select("doc_id", "_no", F.array_join("_b.t", "").alias("_sep"))
    solid = own.where("not _blank").join(blanks, ["doc_id", "_no"], "left").withColumn("_sep", F.coalesce("_sep", F.lit("")))
    head = F.struct(F.concat("_head", "_sep").alias("h"), (F.col("_head").endswith("_") & (F.col("_len") >= EDGE_UNITS)).alias("cut"))
    solid = solid.withColumn("_heads", F.collect_list(head).over(in_order.rowsBetween(1, EDGE_UNITS)))
    stop = F.array_position(F.transform("_heads", lambda x: x["cut"]), True).cast("int")
    heads = F.when(stop > 0, F.slice("_heads", F.lit(1), stop)).otherwise(F.col("_heads"))
    gaps = solid.where(F.size("_heads") > 0).select("doc_id", "page", "_tail", "_sep", F.array_join(F.transform(heads, lambda x: x["h"]), "\n").alias("_next"))
    window = F.concat(F.col("_tail"), F.col("_sep"), F.lit("\n"), F.col("_next"))
    gaps = settle(gaps, **signals(window))
    pattern = F.lit(V.KEYWORD_PATTERN)
    across = F.col("keywords") - F.regexp_count("_tail", pattern) - F.regexp_count("_next", pattern)
    gaps = gaps.withColumn("keywords", across)
    cols = ["doc_id", "page", "omb_number", "form_type", "agency", "tax_year", "keywords"]
    rows = own.select(*cols, "_len", F.lit(0).alias("_gap")).unionByName(
        gaps.select(*cols, F.lit(None).cast("int").alias("_len"), F.lit(1).alias("_gap")))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("page", "_gap"))).alias(c)

    page_len = F.when(F.col("_gap") == 0, F.col("_len"))
    g = rows.groupBy("doc_id").agg(
        first("omb_number"), first("form_type"), F.max("agency").alias("agency"), first("tax_year"),
        F.sum("keywords").cast("int").alias("keywords"), F.sum(page_len).alias("_len"), F.count_if(F.col("_gap") == 0).alias("page_count"),
        F.min_by("_len", F.when(F.col("_gap") == 0, F.col("page"))).alias("_first_len"))
    out = verdict(g, F.col("_len"), t)
    scan = F.col("_len") < 50
    out = out.withColumns({
        "is_tax_form": scan | F.col("is_tax_form"), "score": F.when(scan, -1).otherwise(F.col("score")),
        "form_type": F.when(~scan, F.col("form_type")), "tax_year": F.when(~scan, F.col("tax_year")), "omb_number": F.when(~scan, F.col("omb_number")),
        "rejection_reason": F.when(~scan, F.col("rejection_reason")),
        "gate_pdf_type": F.when(scan, "scanned").otherwise("digital"),
        "route": F.when(F.col("_first_len") > 50, "digital").otherwise("scanned"),
    })
    return out.drop("_len", "_first_len")


def route(first_page_text: Column) -> Column:
    """Digital when the first page holds more than 50 characters."""
    return F.when(F.length(S.strip(F.coalesce(first_page_text, F.lit("")))) > 50, "digital").otherwise("scanned")


def gate_envelope(gated: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Gate result record; a missing result fails open."""
    failed = F.col("score").isNull()
    return gated.select(
        "doc_id", F.coalesce("is_tax_form", F.lit(True)).alias("accepted"), F.coalesce("score", F.lit(-1)).alias("score"),
        F.lit(t.gate_pass).alias("threshold"), "form_type", "tax_year", "omb_number",
        F.when(failed, F.lit("gate unavailable, accepted unchecked")).when(
            ~F.col("is_tax_form"), F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(" below "), F.lit(str(t.gate_pass)))).alias("note"))


def page_counts(docs: DataFrame, pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Pages per document; without pages the number of images, else 1."""
    d = docs.select("doc_id").join(pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")), "doc_id", "left")
    fallback = F.lit(1)
    if images is not None:
        d = d.join(images.groupBy("doc_id").agg(F.count("*").alias("n_images")), "doc_id", "left")
        fallback = F.coalesce(F.nullif("n_images", F.lit(0)), F.lit(1))
    return d.select("doc_id", F.coalesce(F.nullif("n_pages", F.lit(0)), fallback).cast("bigint").alias("page_count"))


def form_segments(pages: DataFrame, span: int = 4096) -> DataFrame:
    """Page ranges of the forms in a document: a page with an OMB number after the first page opens a form.

    Only opening pages take part in the ordering, and the next opening page is found inside spans of pages
    first, so a very long document is not ordered in one task.
    """
    opens = (F.col("page") == 0) | F.col("text").rlike(V.OMB_PAGE_PATTERN)
    starts = pages.where(opens).select("doc_id", F.col("page").alias("start_page"), F.floor(F.col("page") / span).alias("span"))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    w = Window.partitionBy("doc_id", "span").orderBy("start_page")
    local = starts.withColumn("next_here", F.lead("start_page").over(w))
    heads = starts.groupBy("doc_id", "span").agg(F.min("start_page").alias("head"))
    heads = heads.select("doc_id", "span", F.lead("head").over(Window.partitionBy("doc_id").orderBy("span")).alias("next_span"))
    j = local.join(heads, ["doc_id", "span"]).join(last, "doc_id")
    end = F.coalesce(F.coalesce("next_here", "next_span") - 1, F.col("last_page"))
    return j.select("doc_id", "start_page", end.alias("end_page"))


def ocr_confidence(words: DataFrame, pages: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Page means and document min, mean, counts; a page without words counts as 0.0."""
    p = words.groupBy("doc_id", "page").agg((F.sum(F.col("confidence").cast("decimal(18,6)")) / F.count("*")).cast("double").alias("c"), F.count("*").alias("n"))
    d = pages.select("doc_id", "page").distinct().join(p, ["doc_id", "page"], "left").withColumn("c", S.round3(F.coalesce("c", F.lit(0.0))))
    g = d.groupBy("doc_id").agg(
        F.min("c").alias("min_confidence"), (F.sum(F.col("c").cast("decimal(18,3)")) / F.count("*")).cast("double").alias("avg"),
        F.count("*").alias("page_count"), F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("word_count"))
    return g.select("doc_id", "min_confidence", S.round3(F.col("avg")).alias("avg_confidence"), "page_count", "word_count",
                    (F.col("avg") < t.ocr_confidence).alias("low_confidence"))
