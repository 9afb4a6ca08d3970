"""op5: a verdict for every page."""

from pyspark.sql import DataFrame, SparkSession

from formweave.llm import urls as U
from formweave.llm.tables import table


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.judge(table(spark, sf_dir, "pages"), U.rules(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_url_filter": op5}
ORACLE: dict = {}
