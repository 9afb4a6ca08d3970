"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm.tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` (smallest node that links reach) for every node that has a link; link ends are not null.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shrink by
    halves. A round is written to the shared folder and read again.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = stored(edges.union(edges.select("other", "node")).distinct(), "edges")
    labels = stored(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        labels = stored(step.join(roots, "low", "left").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
