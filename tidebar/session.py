"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tidebar", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the cluster.

    A folder of our own is made only in local mode, where driver and executors share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    own = tempfile.mkdtemp(prefix="tidebar-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows once as a table in the shared folder.

    The table outlives lost executors, is read with column pruning, and has a known size, so later joins
    broadcast it only when it is small.
    """
    target = f"{shared_folder(df.sparkSession).rstrip('/')}/tidebar-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself when it is a plain scan, else its rows written once.

    For frames that several branches of a plan read: recomputing joins, windows and aggregations per branch
    costs more than one write.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    heavy = any(node in plan for node in ("Aggregate", "Window", "Join", "Generate", "Repartition"))
    return materialize(df) if heavy else df
