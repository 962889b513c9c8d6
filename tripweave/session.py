"""Session settings the operators rely on, and where to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Hot vertices, edges and OD pairs are the normal case on a road network.  AQE splits the reduce
# partitions they fill; "force" keeps that split even where it costs one more exchange.
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins on trips and picks turn few bytes into many rows, so small partitions are worth a task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Id lists are bounded (operators.lists), so this many of them fit a task before it sorts instead.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution with skew splitting.  Sizes and parallelism stay the cluster's."""
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a single-machine session that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tripweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Full parallelism for a step whose rows are few bytes but much work.

    A given number of partitions is not merged by adaptive execution, which only looks at bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def application_folder(spark: SparkSession) -> str:
    """``<shared folder>/tripweave/<application id>``, for what one application writes between its jobs.

    It is deleted when the application's JVM ends, by the file system itself.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/tripweave/{spark.conf.get('spark.app.id')}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: this runs a job.

    For a frame that several later branches read: they prune columns on the written table, its real size
    is known to the planner, and a lost executor costs a re-read and not a recompute.  The shuffle files of
    the job go when it ends, the table with the application (:func:`application_folder`); :func:`release` drops one earlier.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that :func:`cut_lineage` gave; nothing may read them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
