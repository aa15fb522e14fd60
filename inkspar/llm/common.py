"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of texts where the session sets no bound itself.  Spark holds a batch outside its heap, and the
#: Python process holds it again with what is made from it, so the default (64 MB) costs several hundred MB a task.
BATCH_BYTES = 8 << 20

#: Vocabulary files are found by name through the ``public_tokenizers`` package unless a path is given.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder is made and recorded, on a local master only: executors of a cluster do
    not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("inkspar.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="inkspar-")
        spark.conf.set("inkspar.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It cuts the lineage with one evaluation of the plan, and what was computed outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made from them is staged itself, or not used again."""
    for df in staged:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_memory() -> None:
    """Return what this process has freed to the system: workers live on and hand what they keep to the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes, after which a worker keeps no memory."""
    conf = df.sparkSession.conf
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in conf.getAll:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return df.mapInArrow(tidy, schema)
