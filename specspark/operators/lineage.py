"""Cutting a plan's lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder set on the context, else (on one machine only) a new one; it is set on the context."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    context.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, kept where a lost executor doesn't take it along."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of an iteration, written below the shared folder; each is deleted once a later round has replaced it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, *replaced: DataFrame) -> DataFrame:
        """``df`` written and read back; then the tables ``replaced``, which an earlier call returned, are deleted."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.drop(*replaced)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
