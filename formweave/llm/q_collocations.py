"""op11: phrases of two and three words that stand together more than their parts would, per language."""

from pyspark.sql import DataFrame, SparkSession

from formweave.llm import collocations as C
from formweave.llm.tables import table


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op11_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM p, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.k, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM c, unnest(range(1, c.k)) AS t(j)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, score
  FROM worst w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * a) JOIN n USING (lang) WHERE rank <= 2000""",
}
