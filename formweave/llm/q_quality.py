"""op10: a quality score for every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import quality as Q
from formweave.llm.tables import table


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Q.Model:
    return Q.train(docs, table(spark, sf_dir, "labels"), where=~held_out("id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = Q.score(docs, model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10}
ORACLE: dict = {}
