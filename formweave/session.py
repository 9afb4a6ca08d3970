"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# bytes of code of a method up to which the JVM compiles it
HUGE_METHOD = "8000"


def build_session(app: str = "formweave", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with UTC time zone and adaptive execution. Cluster sizes are left to the deployment."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        # rule projections compile to large methods: beyond this size the JVM would not compile them further,
        # so they run in the split, per-expression form instead
        .config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
        # call-site capture doubles the time to build large rule expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def split_methods(spark: SparkSession) -> None:
    """Large projections run in the split form, which the JVM compiles, also in sessions that were not made by ``build_session``."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") != HUGE_METHOD:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder on a cluster. Where it is unset, a local temporary
    folder is taken on a single machine (tests, a laptop); on a cluster it is an error, as executors would
    write files that others do not see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-formweave-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
