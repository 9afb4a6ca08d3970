"""Joins with a heavy key: same rows as the plain join, over several tasks."""

import pytest
from pyspark.sql import functions as F

from formweave.operators.joins import heavy_keys, split_join
from formweave.operators.rules_tables import duplicate_uploads


def tables(spark):
    docs = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"h{i % 400}", i % 7) for i in range(3000)]
    return (spark.createDataFrame(docs, "doc_id long, k string, v long").repartition(6),
            spark.createDataFrame([("hot", 1), ("hot", 2), ("h1", 3), ("nowhere", 4), (None, 5)], "k string, w long"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows(spark, how):
    large, small = tables(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    got, want = split_join(large, small, "k", how, limit=100), large.join(small, "k", how)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(split_join(large.limit(0), small, "k", how, limit=100)) == rows(large.limit(0).join(small, "k", how))


def test_heavy_key_is_many_tasks(spark):
    large, small = tables(spark)
    assert [tuple(r) for r in heavy_keys(large, "k", 100).collect()] == [("hot", 10)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = split_join(large, small, "k", limit=100).where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(got) > 2 and max(r["count"] for r in got) < 1400
        plain = large.join(small, "k").where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(plain) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        split_join(large, small, "k", "right")


def test_duplicate_uploads_of_a_hot_hash(spark, monkeypatch):
    from formweave.operators import joins

    monkeypatch.setattr(joins.split_join, "__defaults__", ("inner", 50))
    docs = spark.createDataFrame([(i, "x" if i % 3 == 0 else f"y{i // 2}", i % 11) for i in range(900)], "doc_id long, doc_hash string, ts long")
    got = {r.doc_id for r in duplicate_uploads(docs).collect()}
    first, want = {}, set()
    for ts, i, h in sorted((i % 11, i, "x" if i % 3 == 0 else f"y{i // 2}") for i in range(900)):
        if h in first:
            want.add(i)
        first.setdefault(h, i)
    assert got == want
