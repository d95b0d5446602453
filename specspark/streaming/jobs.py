"""Incremental jobs on Structured Streaming: ingest, running audits, de-duplication, library look-up.

Sinks are written batch by batch under the batch's number, so a batch that runs again after a failure replaces what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.peaks import signature
from ..functions.vectors import l2
from ..operators.audit import audit
from ..operators.keyruns import KeyRuns
from ..operators.search import blocked_topk

#: Batches between two whole states of a running audit.
WHOLE_EACH = 16


def shard_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _each_batch(stream: DataFrame, checkpoint: str, do, mode: str = "append"):
    return stream.writeStream.outputMode(mode).foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, key: str, buckets: int = 16):
    """Append the first row of each key to ``target``, a folder a batch; keys of earlier batches are found in bucketed runs.

    Of equal keys in one batch any one row stays; rows without a key all stay. The keys lie in ``<target>_keys``.
    """
    kind = stream.schema[key].dataType.simpleString()

    def add(batch: DataFrame, number: int) -> None:
        runs = KeyRuns(batch.sparkSession, f"{target.rstrip('/')}_keys", key, kind, buckets)
        runs.compact(number)
        keyed = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        fresh = runs.unseen(keyed, number).unionByName(batch.filter(F.col(key).isNull()))
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        runs.add(batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch={number}"), number)

    return _each_batch(stream, checkpoint, add)


def count_stream(stream: DataFrame, key: str, count: str, target: str, checkpoint: str):
    """Counts of each batch's rows by key, a folder a batch: no state is kept, ``read_counts`` adds them up."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count(F.lit(1)).alias(count)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _each_batch(stream, checkpoint, add)


def read_counts(spark: SparkSession, target: str, key: str, count: str) -> DataFrame:
    return spark.read.parquet(target).groupBy(key).agg(F.sum(count).alias(count))


def audit_stream(stream: DataFrame, by: list[str] = ("shard",), **limits) -> DataFrame:
    """The audit's counters, kept up to date for each shard."""
    return audit(stream, list(by), **limits)


def running_audit(stream: DataFrame, target: str, checkpoint: str, by: list[str] = ("shard",), **limits):
    """Keep all counters of each arriving shard in ``target``; ``read_audit`` gives their latest values.

    Spark holds the counters as state and hands over those that a batch changed (update mode), which are written under the batch's
    number. Every ``WHOLE_EACH`` batches that folder gets all counters, and folders before the last such one are deleted: it
    was committed long ago, so a batch that runs again still finds what it needs.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and number % WHOLE_EACH == 0:
            earlier = _latest(spark.read.option("basePath", target).parquet(target).filter(F.col("batch").between(number - WHOLE_EACH, number - 1)), by)
            batch = batch.unionByName(earlier.join(batch.select(*[F.col(c).alias(f"__{c}") for c in by]), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left_anti").select(*batch.columns))
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        for old in range(max(0, number - 2 * WHOLE_EACH), number - WHOLE_EACH) if number % WHOLE_EACH == 0 else ():
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return _each_batch(audit_stream(stream, by, **limits), checkpoint, put, "update")


def _latest(rows: DataFrame, by: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in by and c != "batch"]
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*by, "v.*")


def read_audit(spark: SparkSession, target: str, by: list[str] = ("shard",)) -> DataFrame:
    """The latest counters of each shard."""
    return _latest(spark.read.option("basePath", target).parquet(target), by)


def dedup_stream(stream: DataFrame, timestamp: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose content signature hasn't been seen; with a timestamp, state is dropped behind the watermark.

    Without one the state grows with the distinct rows: ``ingest_stream`` by signature keeps them on disk instead.
    """
    marked = stream.withColumn("signature", signature(F.col("mz"), F.col("intensity")))
    if timestamp:
        return marked.withWatermark(timestamp, delay).dropDuplicatesWithinWatermark(["signature"])
    return marked.dropDuplicates(["signature"])


def append_stream(stream: DataFrame, target: str, checkpoint: str):
    """Append the rows of a stream to Parquet files, each once."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def library_index(library: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """(key, vector): the library's unit vectors, written to ``path`` once; a later call reads what is there."""
    spark = library.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    rows = library.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, l2(F.col(vector)).alias(vector))
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def search_stream(stream: DataFrame, library: DataFrame, key: str, vector: str, target: str, checkpoint: str, k: int = 1):
    """The best ``k`` library rows of each arriving vector, a folder a batch.

    The library is indexed once, in ``<target>_library``; it is read anew for a batch, not shuffled: a batch's vectors go to its tasks,
    or, when they are too many bytes for that, meet it in cells (``tiles``).
    """
    index = library_index(library, key, vector, f"{target.rstrip('/')}_library")

    def look_up(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.schema(index.schema).parquet(f"{target.rstrip('/')}_library")
        blocked_topk(batch, known, key, vector, k, exclude_self=False).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _each_batch(stream, checkpoint, look_up)
