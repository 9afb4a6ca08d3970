"""op8: fingerprints of all documents and of their edited texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import simhash as S
from formweave.llm.tables import table


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_neighbours(S.compared(table(spark, sf_dir, "documents")), F.col("doc_id") % 50 == 0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within")


QUERIES = {"op8_document_fingerprints": op8}
ORACLE: dict = {}
