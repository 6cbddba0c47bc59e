"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # field cleanup nests lambdas deeper than the analyser follows by default
    "spark.sql.analyzer.maxIterations": "400",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # parsing costs far more time per byte than a scan: keep all cores busy on small inputs
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}

#: Only around own writes: a result that a caller reads twice keeps its shuffle files.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators expect."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For costly rows that a plan needs twice: nothing is computed a second time, and a
    lost executor costs a read. The shuffle files of the job go when it has ended.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """New folder below the cluster's ``spark.checkpoint.dir``.

    Only a session in one process (local master, as in tests) may lack that setting; it gets
    a folder that goes with the process. Elsewhere a local folder would be another one on
    every executor, so the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cuesheet-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cuesheet/{name}-{uuid.uuid4().hex}"
