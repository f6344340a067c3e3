"""Intermediate tables in the folder that all machines share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder on a single machine where that is unset."""
    sc = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return given.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one run as Parquet: computed once, safe from lost executors, without lineage; dropped when replaced, the rest when the application ends."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}", {}
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(at)
        self.fs.deleteOnExit(at)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that keep() gave and that nothing reads any more."""
        for f in frames:
            self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(f))[1]), True)
