"""Lines that many documents share, found with levelled sorted runs of line hashes.

A run holds distinct line keys, each with the number of documents that hold it. ``LineRuns`` keeps runs in levels like a
log-structured merge tree: each new batch of documents is merge-anti-joined with the keys that have reached ``min_docs`` in any run,
which need no further count, and what is left is a new run of level 0. Two runs of one level are merged into one of
the next, summing counts. All runs are bucketed and sorted by the key in the same way, so neither the anti-joins nor the
merges shuffle a run again.

A key is the line without the six white-space characters at its ends, A-Z lower-cased, as a 128-bit hash
(two xxHash64 of different seeds).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, own_names, partitions, remove, shared_dir

SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Up to so many settled keys (16 bytes each) are broadcast; beyond it the lines are shuffled to them.
BROADCAST_KEYS = 200_000
MIN_DOCS, BATCHES = 10, 4


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; the quick way where the text is ASCII."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """array<struct<h1,h2>>: each line's key in order; null for an empty key."""
    lines = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n")
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)))
    return F.transform(
        keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2")))
    )


def batch_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, n): how many rows of ``docs`` hold each key. Summed in each task before the shuffle."""
    keys = F.filter(F.array_distinct(line_keys(F.col("text"))), lambda k: k.isNotNull())
    rows = docs.select(F.explode(keys).alias("k")).select("k.*")
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Levelled runs of (h1, h2, n) in the shared folder; the driver knows only their names and levels."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs, self.buckets = spark, min_docs, partitions(spark)
        self.root = shared_dir(spark, "line-runs")
        self.runs: list[tuple[int, str]] = []  # level, table
        #: What happened: (level, runs that it was anti-joined with or merged from).
        self.log: list[tuple[int, int]] = []

    def _write(self, df: DataFrame, level: int, others: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        self.runs.append((level, name))
        self.log.append((level, others))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.root}/{name}")
        self.runs = [r for r in self.runs if r[1] != name]

    def add(self, counts: DataFrame) -> None:
        """Make a run of a batch's ``batch_counts``, without the keys that have been found often enough, and merge full levels."""
        counts = counts.repartition(self.buckets, *KEY)
        for _, name in self.runs:
            often = self.spark.table(name).filter(F.col("n") >= self.min_docs)
            counts = counts.join(often.select(*KEY).hint("merge"), KEY, "left_anti")
        self._write(counts, 0, len(self.runs))
        while [level for level, _ in self.runs[-2:]] == [self.runs[-1][0]] * 2:
            self._merge(self.runs[-1][0] + 1)

    def _merge(self, level: int) -> None:
        """Make one run of the last two."""
        names = [name for _, name in self.runs[-2:]]
        a, b = (self.spark.table(name).withColumnRenamed("n", f"n{i}") for i, name in enumerate(names))
        both = a.hint("merge").join(b, KEY, "full").select(*KEY, (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))
        self._write(both, level, 2)
        for name in names:
            self._drop(name)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys found in at least ``min_docs`` documents of all batches."""
        while len(self.runs) > 1:
            self._merge(self.runs[-1][0] + 1)
        if not self.runs:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return self.spark.table(self.runs[0][1]).filter(F.col("n") >= self.min_docs).select(*KEY)

    def drop(self) -> None:
        """Delete all runs."""
        for _, name in list(self.runs):
            self._drop(name)


def frequent_lines(docs: DataFrame, min_docs: int, batches: int, scratch: Scratch) -> DataFrame:
    """(h1, h2), written: the keys found in at least ``min_docs`` rows of ``docs`` (doc_id, text).

    Rows are dealt to ``batches`` by a hash; their keys are counted within the batches in one pass, and the batches are added one by one.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    keys = F.filter(F.array_distinct(line_keys(F.col("text"))), lambda k: k.isNotNull())
    rows = docs.select(batch.alias("batch"), F.explode(keys).alias("k")).select("batch", "k.*")
    counts = scratch.write(rows.groupBy("batch", *KEY).agg(F.count(F.lit(1)).alias("n")), "batch-counts", "batch")
    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        runs.add(counts.filter(F.col("batch") == i).select(*KEY, "n"))
    found = scratch.write(runs.frequent(), "frequent")
    runs.drop()
    scratch.drop(counts)
    return found


@own_names
def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_lines, n_dropped and the text that is left.

    Every line whose key is found in at least ``min_docs`` rows is dropped from every row; the others
    stay as they are, joined by a newline. Each row counts as a document, also one that repeats another.
    A null or empty text is one empty line, which has no key; its text becomes empty. A text that loses
    all lines becomes empty. Columns called n_lines or n_dropped are replaced; other columns stay.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    frequent = frequent_lines(docs, min_docs, batches, Scratch(spark, "line-dedup"))
    small = frequent.count() <= BROADCAST_KEYS
    # which lines of which text go: rows are named by id and text hash, as ids may repeat or be null
    named = docs.select(*keep).withColumn("__t", F.xxhash64("text"))
    lines = named.select("doc_id", "__t", F.posexplode(line_keys(F.col("text"))).alias("__i", "__k")).filter("__k is not null")
    lines = lines.select("doc_id", "__t", "__i", F.col("__k.h1").alias("h1"), F.col("__k.h2").alias("h2"))
    hits = lines.join(F.broadcast(frequent) if small else frequent, KEY, "left_semi")
    hits = hits.groupBy("doc_id", "__t").agg(F.collect_set("__i").alias("__drop"))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("__t").alias("__ht"), "__drop")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__ht"))
    df = named.join(hits, same, "left").withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    gone = F.col("__drop")
    left = F.when(gone.isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.filter("__lines", lambda x, i: ~(gone.isNotNull() & F.array_contains(gone, i))), "\n")
    )
    df = df.withColumn("text", left).withColumn("n_lines", F.size("__lines").cast("bigint"))
    df = df.withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("bigint"))
    df = df.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    return df.select(*keep, "n_lines", "n_dropped")
