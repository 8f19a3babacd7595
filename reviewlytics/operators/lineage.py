"""Shared storage for data that must survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one for a local master; driver
    and executors of a cluster would write to different disks, so there it is an error."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all nodes of {master} share")
        folder = tempfile.mkdtemp(prefix="reviewlytics-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as stored rows, in the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, written once and read back."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored intermediate tables that nothing needs once the block has ended."""

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, scratch_folder(spark, "scratch")

    def __enter__(self) -> "Scratch":
        return self

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back."""
        path = f"{self._folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
