"""op6: components of near-equal documents."""

from pyspark.sql import DataFrame, SparkSession

from formweave.llm import jaccard as J
from formweave.llm.tables import table


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op6_ngram_jaccard_join": op6}

ORACLE = {
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS g FROM w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n na ON na.doc_id = o.a JOIN n nb ON nb.doc_id = o.b WHERE 100 * o.i >= 80 * (na.n + nb.n - o.i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
