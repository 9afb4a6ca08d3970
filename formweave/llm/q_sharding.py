"""op2: all documents in eight shards of near equal bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import sharding as S
from formweave.llm.tables import table


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = S.assign(table(spark, sf_dir, "documents"))
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2}
ORACLE: dict = {}
