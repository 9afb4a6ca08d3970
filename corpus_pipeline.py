"""Training corpus from raw documents: quality, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on; its result is written as Parquet to the shared
folder and read again as the next stage's documents. All stages but the last keep the columns of ``documents``; the last adds
the shard (``shard``, or ``shard_`` where a column has that name). How nulls, empty and very long texts, ties, repeated rows,
empty tables and extra columns are treated is stated by the operators; in short, every row is judged as it is, an empty text
counts as a text without words, and no stage needs an id to be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formweave.llm import decontaminate, jaccard, mixture, q_quality, quality, sharding
from formweave.llm.tables import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage attention model, fitted on the labels, scores 0.5 or more."""
    return quality.accepted(docs, q_quality.model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them."""
    return mixture.mixed(docs)


def put_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard of near equal bytes."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", put_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


ORACLE_SQL = None  # a trained model decides in the first stage; tests/llm/test_pipeline.py checks each stage by brute force
QUERIES = {"pipeline": run}
ORACLE: dict = {}
