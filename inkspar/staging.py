"""Tables written in the folder that driver and executors share, to cut long plans."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str = "stage") -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one serves where that is unset, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("inkspar.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkspar-")
        spark.conf.set("inkspar.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds: it does so when the driver collects its garbage, else maybe never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt over all cores; larger tables, and streams, stay as they are read.

    A file with a single row group is a single task, however many cores wait.  Where the input has at least one split
    for each core nothing is shuffled.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    cores = spark.sparkContext.defaultParallelism
    split = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df
