"""op1: licences of all documents, by entire text and by line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import licenses as L
from formweave.llm.license_texts import SPELLINGS, known
from formweave.llm.tables import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.scan(table(spark, sf_dir, "documents"), L.catalogue(spark))
    return got.select("doc_id", "digest", "license", F.size("line_licenses").cast("long").alias("n_line_licenses"), F.array_join("line_licenses", ",").alias("line_licenses"))


QUERIES = {"op1_license_scan": op1}


def _lines(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), '{L.COPYRIGHT}', '\\1', 'g')"
    t = f"regexp_replace({t}, '{L.RESERVED}', '\\1\\2', 'g')"
    t = f"(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') || ' ')"
    for old, new in SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_KNOWN = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known())
ORACLE = {
    "op1_license_scan": f"""
WITH k AS (SELECT sha256(array_to_string(l, ' ')) AS digest, min(license) AS license FROM (SELECT license, {_lines('t')} AS l FROM (VALUES {_KNOWN}) v(license, t)) WHERE len(l) > 0 GROUP BY 1),
d AS MATERIALIZED (SELECT doc_id, {_lines('text')} AS l FROM documents),
f AS (SELECT doc_id, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS s FROM (SELECT doc_id, sha256(unnest(l)) AS digest FROM d) JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, sha256(array_to_string(d.l, ' ')) AS digest, k.license, coalesce(f.n, 0)::BIGINT AS n_line_licenses, coalesce(f.s, '') AS line_licenses
FROM d LEFT JOIN k ON k.digest = sha256(array_to_string(d.l, ' ')) LEFT JOIN f ON f.doc_id = d.doc_id""",
}
