"""Array-vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2(a: Column) -> Column:
    """Unit length; a zero vector stays. The length is bound once, by a one-element array, not worked out for each element."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Null where one has length 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def mean_by(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the element-wise mean of each key's vectors."""
    rows = df.select(key, F.posexplode(vector).alias("__i", "__x")).groupBy(key, "__i").agg(F.avg("__x").alias("__x"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__v")).select(key, F.col("__v.__x").alias(vector))


def centroid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of each key's vectors at unit length."""
    means = mean_by(df, key, vector).withColumn("__n", norm(F.col(vector)))
    return means.withColumn(vector, F.transform(vector, lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(0.0))).drop("__n")


def fuse_vectors(a: Column, b: Column) -> Column:
    """The unit vector of both unit vectors, one after the other."""
    return l2(F.concat(l2(a), l2(b)))


def pool_tokens(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Of one row a token: mean, max, population deviation and weighted mean of ``value`` (the mean if weights sum to 0)."""
    rows = df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"),
        F.sum(F.col(value) * F.col(weight)).alias("__s"), F.sum(weight).alias("__w"),
    )
    return rows.withColumn("weighted", F.when(F.col("__w") != 0, F.col("__s") / F.col("__w")).otherwise(F.col("mean"))).drop("__s", "__w")
