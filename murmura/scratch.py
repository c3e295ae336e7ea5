"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and Spark runs in one process.
LOCAL_DIR = "/tmp/checkpoints/murmura"
BATCH_BYTES = "4m"
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets ``LOCAL_DIR``; a cluster without
    it is refused, since executors could not see each other's local files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote; frames that read them can't be used any more."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, not a
    recomputation.  The schema is kept, for empty tables as well.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself, in a session whose Arrow batches hold few megabytes.

    Texts can be very long, and both sides of the Python boundary hold whole
    batches for every task; the default of 64 MB is more than small executors
    have to spare.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def bounded_broadcast(df: DataFrame, limit_rows: int):
    """``(df, True)`` with a broadcast hint if it has at most ``limit_rows`` rows.

    ``df`` should be cheap to count (a materialized table).  Beyond the limit
    the frame comes back unhinted with False, and the caller takes a shuffled
    join.
    """
    from pyspark.sql import functions as F

    n = df.limit(limit_rows + 1).count()
    return (F.broadcast(df), True) if n <= limit_rows else (df, False)
