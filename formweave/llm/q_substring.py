"""op7: words of repeated 35-word windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import substring as S
from formweave.llm.tables import table


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return S.mark(table(spark, sf_dir, "documents")).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7}

ORACLE = {
    "op7_substring_dedup": r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM g JOIN r USING (h), unnest(range(i, i + 35)) AS t(p)),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.p) AS l FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.l, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
}
