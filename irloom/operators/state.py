"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, on one machine as in tests, below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "irloom-state")
    return f"{base.rstrip('/')}/irloom-{uuid.uuid4().hex}"


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write and read again: cuts lineage. With `by`, a folder for each value of that column. The files go when the application ends."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


class Grown:
    """A table that grows by parts, each written once; after some parts they are put together."""

    PARTS = 16

    def __init__(self, first: DataFrame):
        self.parts = [cut(first)]
        self.last = self.parts[0]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.union(p)
        return out

    def add(self, new: DataFrame) -> bool:
        """Write what is new as `last`; whether there was anything."""
        self.last = cut(new)
        if self.last.isEmpty():
            return False
        self.parts.append(self.last)
        if len(self.parts) > self.PARTS:
            self.parts = [cut(self.all())]
        return True
