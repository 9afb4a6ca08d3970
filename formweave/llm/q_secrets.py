"""op3: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import secrets as S
from formweave.llm.tables import table


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.scan(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return got.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op3_secret_scan": op3}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, keep: str) -> str:
    """Matches and the pieces between them, and the sums of their lengths."""
    return f"""SELECT doc_id, {kind} AS k, s, s + len(h) AS e, h FROM (
    SELECT doc_id, list_sum(list_transform(p[:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0)::BIGINT AS s, m[i] AS h
    FROM (SELECT doc_id, regexp_extract_all(t, {_q(pattern)}) AS m, regexp_split_to_array(t, {_q(pattern)}) AS p FROM d WHERE regexp_matches(t, {_q(pattern)})), unnest(range(1, len(m) + 1)) AS u(i))
    WHERE {keep}"""


_LEAST = "CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN {b}" for p, b in S.LIMITS[:-1]) + f" ELSE {S.LIMITS[-1][1]} END"
_LETTERS = "([A-Z]?[a-z]+([A-Z][a-z][a-z]+)*|[A-Z]+)"
_WORD = f"({_LETTERS}[0-9]{{0,4}}|[0-9]{{1,8}})"
_PIECE = f"{_WORD}([_=-]+{_WORD})*"
_SQL_ALLOW = [
    "^[0-9=+/_-]+$",
    f"^[=+/_-]*({_LETTERS}[=+/_-]+)*({_LETTERS})?$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    f"^(/+({_PIECE}/+)({_PIECE}/+)+|({_PIECE}/+)({_PIECE}/+)({_PIECE}/+)+)({_PIECE})?$",
    "^[A-Za-z]+([_-][A-Za-z]+)*[_-]?[0-9]{1,4}$",
    "^[Xx0-9_=+/-]*(([Ee]xample|EXAMPLE|[Dd]ummy|[Cc]hangeme|[Pp]laceholder|[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET|abcdefghij(klmnopqrstuvwxyz)?)[Xx0-9_=+/-]*)*$",
    "^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
]
_ALLOWED = " OR ".join(f"regexp_matches(h, '{p}')" for p in _SQL_ALLOW)
ORACLE = {
    "op3_secret_scan": f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({_spans(0, S.ASSIGN, f"len(regexp_extract(h, {_q(S.ASSIGN)}, 2)) >= {S.VALUE}")}
  UNION ALL {_spans(1, S.ACCESS, "true")} UNION ALL {_spans(2, S.HEX, "true")}),
c AS MATERIALIZED ({_spans(3, "[A-Za-z0-9+/_=-]{20,}", f"NOT ({_ALLOWED})")}),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.s <= c.s AND b.e >= c.e)
  AND list_max(list_transform(range(1, len(h) - {S.WINDOW - 2}), lambda i: list_aggregate(string_split(substr(h, i, {S.WINDOW}), ''), 'entropy'))) >= {_LEAST} - 1e-9),
x AS (SELECT doc_id, k, s, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e AS v FROM (SELECT * FROM b UNION ALL SELECT * FROM f)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(v, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(v, ',' ORDER BY s, k) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
}
