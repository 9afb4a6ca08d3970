"""Text lines from word boxes.

A line is anchored at the top of its first word and takes every following word within a tolerance of
that anchor. The anchor depends on the order, but only on the distinct tops: words with the same top
always share a line. The few distinct tops of a page are folded in one row; words are joined to their line on
the top and never gathered or given a page's tops. Lines that may run over page changes depend on all pages of a
document, which no row could hold: there each distinct top has one successor, the first later top beyond its
tolerance, the anchors are what is reached from the first top along these arrows, and arrows are doubled, so a
chain of n anchors takes log n joins; the number of arrows passed is the line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import shared_dir

OCR_TOLERANCE = 8.0  # fixed value: pixels
DIGITAL_TOLERANCE = 5.0  # fixed value: points


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _next_on_page(tops: DataFrame, tolerance: float, page: list[str]) -> DataFrame:
    """Add ``next``: the first top of the page that is more than the tolerance below."""
    slack = 1e-6 * max(1.0, tolerance)  # sums and differences of doubles round apart: near the bound the difference decides
    frame = lambda what, upto: F.expr(f"{what} over (partition by {', '.join(page)} order by y0 range between {tolerance + (slack if upto is None else -slack)}D following and {'unbounded' if upto is None else f'{upto}D'} following)")
    near = F.array_min(F.filter(frame("collect_list(y0)", tolerance + slack), lambda y: y - F.col("y0") > tolerance))
    far = frame("min(y0)", None)
    return tops.withColumn("next", F.coalesce(near, far))


def _next_over_pages(tops: DataFrame, tolerance: float) -> DataFrame:
    """Add ``to_page`` and ``next``: the successor may lie on a later page, where a top above counts too. Tops without one on their own page
    ask page after page; only those not yet answered go on."""
    own = _next_on_page(tops, tolerance, ["doc_id", "page"])
    pages = tops.groupBy("doc_id", "page").agg(F.min("y0").alias("least"), F.max("y0").alias("most"))
    pages = _stored(pages.withColumn("after", F.lead("page").over(Window.partitionBy("doc_id").orderBy("page"))), "pages")
    found = own.where("next IS NOT NULL").select("doc_id", "page", "y0", F.col("page").alias("to_page"), "next")
    last = own.where("next IS NULL").join(pages.select("doc_id", "page", "after"), ["doc_id", "page"])
    found, open_ = _stored(found, "found"), _stored(last.where("after IS NOT NULL").select("doc_id", "page", "y0", F.col("after").alias("at")), "asked")
    end = last.where("after IS NULL").select("doc_id", "page", "y0", F.lit(None).cast("int").alias("to_page"), F.lit(None).cast("double").alias("next"))
    done = [found, _stored(end, "ends")]
    while not open_.isEmpty():
        seen = open_.join(pages.select("doc_id", F.col("page").alias("at"), "least", "most", "after"), ["doc_id", "at"])
        first = F.abs(F.col("least") - F.col("y0")) > tolerance
        below = seen.where(~first & (F.col("most") - F.col("y0") > tolerance)).select("doc_id", "page", "y0", "at")
        there = tops.select("doc_id", F.col("page").alias("at"), F.col("y0").alias("other"))
        below = below.join(there, ["doc_id", "at"]).where(F.col("other") - F.col("y0") > tolerance).groupBy("doc_id", "page", "y0", "at").agg(F.min("other").alias("next"))
        done.append(_stored(seen.where(first).select("doc_id", "page", "y0", F.col("at").alias("to_page"), F.col("least").alias("next")).unionByName(
            below.select("doc_id", "page", "y0", F.col("at").alias("to_page"), "next")), "found"))
        rest = seen.where(~first & ~(F.col("most") - F.col("y0") > tolerance))
        done.append(_stored(rest.where("after IS NULL").select("doc_id", "page", "y0", F.lit(None).cast("int").alias("to_page"), F.lit(None).cast("double").alias("next")), "ends"))
        open_ = _stored(rest.where("after IS NOT NULL").select("doc_id", "page", "y0", F.col("after").alias("at")), "asked")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _numbered(tops: DataFrame, keys: list[str], node: list[str], to: list[str]) -> DataFrame:
    """Anchors with their line number, from 1: what is reached from the first ``node`` of each ``keys`` along the arrows ``to``."""
    at = [F.col(c) for c in node]
    first = tops.groupBy(*keys).agg(F.min(F.struct(*at)).alias("a")).select(*keys, *[F.col(f"a.{c}").alias(c) for c in node], F.lit(1).cast("long").alias("line"))
    reached, arrows, step = _stored(first, "anchors"), _stored(tops.where(F.col(to[-1]).isNotNull()), "arrows"), 1
    while not arrows.isEmpty():
        ahead = reached.join(arrows, [*keys, *node]).select(*keys, *[F.col(t).alias(c) for t, c in zip(to, node, strict=True)], (F.col("line") + step).alias("line"))
        reached = _stored(reached.unionByName(ahead), "anchors")
        second = arrows.select(*keys, *[F.col(c).alias(t) for c, t in zip(node, to, strict=True)], *[F.col(t).alias(f"_{t}") for t in to])
        arrows = _stored(arrows.join(second, [*keys, *to]).select(*keys, *node, *[F.col(f"_{t}").alias(t) for t in to]), "arrows")
        step *= 2
    return reached


def _anchors(tops: Column, tolerance: float) -> Column:
    """Tops that open a line, from sorted distinct tops."""
    return F.aggregate(
        tops, F.array().cast("array<double>"),
        lambda acc, y: F.when((F.size(acc) == 0) | (y - F.try_element_at(acc, F.lit(-1)) > tolerance), F.concat(acc, F.array(y))).otherwise(acc))


def with_lines(words: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """Words with their line anchor and line number (from 1) inside the page.

    The distinct tops of one page fit in a row: they are folded there, and words meet their line by an equi join on the top.
    """
    tops = words.select(*keys, F.col("y0").cast("double").alias("y0")).where("y0 IS NOT NULL").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("y0")).alias("tops"))

    def numbered(anchors: Column) -> Column:
        line = lambda y: F.size(F.filter(anchors, lambda a: a <= y))
        return F.transform("tops", lambda y: F.struct(y.alias("y0"), F.element_at(anchors, line(y)).alias("anchor"), line(y).cast("int").alias("line")))

    lines = tops.select(*keys, F.inline(S.let(_anchors(F.col("tops"), tolerance), numbered)))
    return words.join(lines, [*keys, "y0"])


def _line_text(words: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    order = F.struct("x0", "y0", cell.alias("cell"))
    return words.groupBy(*keys, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda w: w["cell"]), "  ").alias("line_text"))


def ocr_lines(words: DataFrame, tolerance: float = OCR_TOLERANCE) -> DataFrame:
    """(doc_id, page, line, line_text) of scanned pages."""
    return _line_text(with_lines(words, tolerance, ["doc_id", "page"]), ["doc_id", "page"], F.col("text"))


def ocr_page_text(words: DataFrame, pages: DataFrame, tolerance: float = OCR_TOLERANCE) -> DataFrame:
    """Structured text of every page, with its header; ``pages`` lists all (doc_id, page)."""
    total = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    lines = ocr_lines(words, tolerance).groupBy("doc_id", "page").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda x: x["line_text"]).alias("lines"))
    j = pages.select("doc_id", "page").distinct().join(total, "doc_id").join(lines, ["doc_id", "page"], "left")
    head = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    text = F.when(F.col("lines").isNull(), F.concat(head, F.lit(" — no text detected]"))).otherwise(
        F.concat(head, F.lit("]\n"), F.array_join("lines", "\n")))
    return j.select("doc_id", "page", text.alias("page_text"))


def digital_lines(words: DataFrame, tolerance: float = DIGITAL_TOLERANCE, page_break: bool = True) -> DataFrame:
    """(doc_id, page, line, line_text) of digital pages with '[x] text' cells.

    ``page_break=False`` lets a line run over a page change when the tops are close, as the studied system
    does: tops are then folded per document in page order, and a line belongs to the page it starts on.
    """
    cell = F.concat(F.lit("["), F.rint("x0").cast("bigint").cast("string"), F.lit("] "), F.col("text"))
    if page_break:
        return _line_text(with_lines(words, tolerance, ["doc_id", "page"]), ["doc_id", "page"], cell)
    at = words.withColumn("page", F.col("page").cast("int")).withColumn("y0", F.col("y0").cast("double"))
    tops = _stored(at.select("doc_id", "page", "y0").where("y0 IS NOT NULL").distinct(), "tops")
    anchors = _numbered(_next_over_pages(tops, tolerance), ["doc_id"], ["page", "y0"], ["to_page", "next"])
    marked = _stored(tops.join(anchors, ["doc_id", "page", "y0"], "left"), "marked")
    # inside a page the last anchor above counts; tops before a page's first anchor take the last one of the pages before
    upto = Window.partitionBy("doc_id", "page").orderBy("y0")
    lines = marked.select("doc_id", "page", "y0", F.last(F.when(F.col("line").isNotNull(), F.struct("line", "page")), True).over(upto).alias("own"))
    pages = marked.groupBy("doc_id", "page").agg(F.max(F.when(F.col("line").isNotNull(), F.struct("line", "page"))).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select("doc_id", "page", F.max("end").over(before).alias("held"))
    lines = lines.join(pages, ["doc_id", "page"]).select("doc_id", "page", "y0", F.coalesce("own", "held").alias("a"))
    d = at.join(lines, ["doc_id", "page", "y0"]).withColumn("line", F.col("a.line").cast("int")).withColumn("page", F.col("a.page"))
    return _line_text(d.drop("a"), ["doc_id", "page"], cell)
