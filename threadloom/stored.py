"""Tables that are stored for a while: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: list = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (local tests) a temporary folder is set once.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended and took its gateway with it
        return


def own_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
    if not _own_folders:
        atexit.register(lambda: [_delete(s, p) for s, p in _own_folders])
    _own_folders.append((spark, path))
    return path


def durable(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation.
    """
    spark, path = df.sparkSession, own_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
