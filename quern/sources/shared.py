"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import OperationError


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all is one process (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise OperationError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    own = spark.conf.get("quern.checkpoint.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.checkpoint.dir", own)
    return own


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written once as a table that survives lost executors, and read from there; deleted at exit."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing can be reached through it
        return
