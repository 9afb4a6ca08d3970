"""op12: how far the sources of each language differ, for all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import divergence as D
from formweave.llm.tables import table


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = D.Audit(table(spark, sf_dir, "documents"))
    part = lambda name, df: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part("pair", audit.pair_reports()).unionByName(part("term", audit.term_reports()))


QUERIES = {"op12_source_divergence": op12}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "1 + (1000000000::HUGEINT * (coalesce({c}, 0) + 5)) // ({n}::HUGEINT + 5 * v)"
ORACLE = {
    "op12_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
t AS (SELECT id, lang, source, term, count(*) AS c FROM d, unnest(w) AS u(term) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c) AS all_c FROM t GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, sum(all_c) AS all_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, sum(c) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(max(v.v), 0) AS v, coalesce(max(v.all_n), 0) AS all_n FROM d LEFT JOIN v ON d.lang = v.lang GROUP BY ALL),
n AS (SELECT g.*, coalesce(x.n, 0) AS n FROM g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) x USING (lang, source)),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format(c='c.c', n='n.n')} AS p, {_SHARE.format(c='k.all_c', n='n.all_n')} AS q
  FROM n JOIN kept k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 50""",
}
