"""What the corpus operators share: the shared scratch folder, written tables, readers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the cluster names no such folder (tests on one machine), one is made and set.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of one run's written tables. Each ends the lineage of what it holds; they are deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, shared_dir(spark, name), 0
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` returned and nothing will read again."""
        for gone in tables:
            (path,) = (p for t, p in self.tables if t is gone)
            remove(self.spark, path)
            self.tables = [(t, p) for t, p in self.tables if p != path]

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*(t for t, _ in self.tables if not any(t is b for b in but)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made and nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def own_names(operator):
    """A decorator: input columns that begin with two underscores, as the operators' own do, keep their values."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        odd = {c: f"kept{uuid.uuid4().hex}" for c in docs.columns if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(odd), *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in odd.items()})

    return run
