"""Tables written between the steps of a job, so that long plans are cut and shared inputs are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir); a local one only where Spark itself is local."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    _own = _own or "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as Parquet into the shared folder and read again; lost executors don't lose it."""
    path = f"{shared_dir(df.sparkSession)}/plates-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Staged tables of an iterative job, which drops each round's once the next is written, so that its disk doesn't grow with the rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/plates-{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def rename(self, old: DataFrame, new: DataFrame) -> None:
        """`new` is a view of the table staged as `old`, and stands for it when it is dropped."""
        path, _ = self.paths.pop(id(old))
        self.paths[id(new)] = (path, new)

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables; nothing that is still to be computed may read them."""
        context = self.spark.sparkContext
        for df in tables:
            path, _ = self.paths.pop(id(df))
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
