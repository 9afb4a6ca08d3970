"""op9: all documents mixed to weights 1, 2, 3 of their sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import mixture as M
from formweave.llm.tables import table


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op9_mixing_sources": op9}

ORACLE = {
    "op9_mixing_sources": r"""
WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT none, name, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY none, name) - 1) % 3 + 1) AS w FROM s),
f AS (SELECT *, (3 * source_size)::DOUBLE / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * (sum(source_size) OVER (ORDER BY full_at, none, name ROWS UNBOUNDED PRECEDING) - source_size))::DOUBLE
    / (sum(w) OVER (ORDER BY full_at, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
t AS (SELECT none, name, source_size, least(w * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, none, name LIMIT 1), (3 * source_size)::DOUBLE) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r, floor(r)::BIGINT AS sure, r - floor(r) AS p, target - floor(r)::BIGINT * source_size AS rest FROM t),
k AS (SELECT d.*, p.* EXCLUDE (none, name), CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE u END AS rank FROM d JOIN p ON d.none = p.none AND d.name = p.name),
b AS (SELECT *, sum(size) OVER (PARTITION BY none, name ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM k),
e AS (SELECT *, size > 0 AND before + size / 2.0::DOUBLE <= rest AS extra FROM b),
g AS (SELECT none, name, any_value(rest) - sum(CASE WHEN extra THEN size ELSE 0 END)::BIGINT AS gap FROM e GROUP BY ALL),
c AS (SELECT e.none, e.name, arg_min(before, row(abs(size - abs(gap)), rank, before)) AS turned FROM e JOIN g ON e.none = g.none AND e.name = g.name
  WHERE size > 0 AND (gap > 0) <> extra AND abs(size - abs(gap)) < abs(gap) AND p > 0 GROUP BY ALL)
SELECT e.doc_id, e.size, e.source_size, e.target, ((e.sure + (e.extra <> coalesce(c.turned = e.before AND e.size > 0, false))::BIGINT) * e.size)::BIGINT AS taken
FROM e LEFT JOIN c ON e.none = c.none AND e.name = c.name""",
}
