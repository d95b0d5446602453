"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w of ``total`` output rows has the mean repetition rate w * total / n.
Each row's count is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from
the seed, the source and the row's id, so it depends on nothing else in the table: no row is ranked, and adding rows
changes only the rates. A mean over ``TABLE_MEAN`` is dealt to parts of equal means, and the count is the sum of theirs, each at a
number of its own: a sum of Poisson counts is one, so tables stay small whatever the mean.
Rows are exploded by their counts and shuffled globally by a hash of id and copy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import own_names, partitions, written

SEED = 17
#: The largest mean of one distribution table, which then has 793 entries.
TABLE_MEAN = 500.0
#: Up to so many bytes of tables are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Copies of a row that are listed at once.
COPY_BLOCK = 4096
#: Hash bits of a uniform number: 13 hexadecimal digits, exact in a double.
DIGITS = 13


def uniform(seed: int, source: Column, doc_id: Column, *part: Column) -> Column:
    """In [0, 1), from the MD5 of seed, source, id and the part's number if given, as text (a null is the empty text)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in (source, doc_id, *part)])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


@F.pandas_udf(ArrayType(DoubleType()))
def poisson_table(rate):
    """P(X <= k) for k = 0, 1, ... of each mean, until it is 1 within rounding. A mean of 0 has one entry."""

    def table(mean: float) -> list[float]:
        if not mean or mean <= 0:
            return [1.0]
        last = int(mean + 12 * math.sqrt(mean) + 24)
        k = np.arange(last + 1)
        logs = k * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, last + 1)))))
        return np.minimum(np.cumsum(np.exp(logs)), 1.0).tolist()

    return rate.map(table)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, n, rate): by default every source (null is one) gets the same share of as many rows as there are.

    Sources without a given weight get 0; weights of absent sources are left out and the others' shares grow.
    """
    counts = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source-counts")
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    size, weight = (total if total is not None else sums["n"]) or 0, sums["w"] or 1.0
    return counts.select("source", "n", (F.col("w") * F.lit(float(size)) / F.lit(float(weight)) / F.col("n")).alias("rate"))


@own_names
def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, source and any others), each as often as its count says, with copy (from 0), shuffled globally.

    Rows with equal id and source get equal counts. Null ids and null sources are values like any other.
    Rows are neither capped nor dropped except by a count of 0. The result is dealt out by ``shuffle_key`` and ordered by it in each partition; a
    column called copy or shuffle_key is replaced.
    """
    keep = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / TABLE_MEAN)).cast("int")
    means = rates(docs, weights, total).select(F.col("source").alias("__s"), parts.alias("__m"), "rate")
    by_source = written(means.select("__s", "__m", poisson_table(F.col("rate") / F.col("__m")).alias("__p")), "source-rates")
    size = by_source.agg(F.sum(64 + F.coalesce(F.octet_length("__s"), F.lit(0)) + 8 * F.size("__p"))).first()[0]
    small = (size or 0) <= BROADCAST_BYTES
    df = docs.select(*keep).join(F.broadcast(by_source) if small else by_source, F.col("source").eqNullSafe(F.col("__s")))
    df = df.withColumn("__u", uniform(seed, F.col("source"), F.col("doc_id")))
    u = F.col("__u")
    more = F.transform(F.sequence(F.lit(1), F.col("__m") - 1), lambda j: uniform(seed, F.col("source"), F.col("doc_id"), j))
    df = df.withColumn("__us", F.when(F.col("__m") > 1, F.concat(F.array(u), more)).otherwise(F.array(u)))
    p = F.col("__p")
    times = F.aggregate("__us", F.lit(0), lambda n, x: n + F.size(F.filter(p, lambda c: (c <= x) & x.isNotNull())))
    df = df.withColumn("__n", times).filter("__n > 0")
    df = df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPY_BLOCK).cast("int"))))
    first = F.col("__b") * COPY_BLOCK
    df = df.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("__n")) - 1)))
    df = df.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "source", "doc_id", "copy"))
    df = df.select(*keep, "copy", "shuffle_key")
    return df.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
