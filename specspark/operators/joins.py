"""Lookup, candidate, nearest-value and range joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_rt(df: DataFrame, times: DataFrame, keys: list[str], order: str, default: float = 0.0) -> DataFrame:
    """df with rt: the last time by ``order`` of its key, else the default."""
    last = times.groupBy(*keys).agg(F.max_by("rt", order).alias("rt"))
    return df.join(last, keys, "left").withColumn("rt", F.coalesce("rt", F.lit(default)))


def expand_candidates(queries: DataFrame, candidates: DataFrame, available: DataFrame, key: str, truth: str, candidate: str) -> DataFrame:
    """(key, candidate, is_true): each query's available candidates and its truth; queries whose truth isn't available go."""
    rows = queries.select(key, truth).join(candidates.select(key, candidate), key)
    own = queries.select(key, truth, F.col(truth).alias(candidate))
    rows = rows.unionByName(own).distinct().join(available.select(candidate).distinct(), candidate, "left_semi")
    kept = queries.join(available.select(F.col(candidate).alias(truth)).distinct(), truth, "left_semi").select(key)
    return rows.join(kept, key, "left_semi").select(key, candidate, (F.col(candidate) == F.col(truth)).alias("is_true"))


def effective_candidates(candidates: DataFrame, allowed: DataFrame, candidate: str) -> DataFrame:
    return candidates.join(allowed.select(candidate).distinct(), candidate, "left_semi")


def inherit_candidates(children: DataFrame, lists: DataFrame, parent: str, child: str) -> tuple[DataFrame, DataFrame]:
    """Each child's rows of its parent's list, and the parents that have more than one list."""
    split = lists.groupBy(parent, "list_id").agg(F.array_sort(F.collect_set("candidate")).alias("l")).groupBy(parent).agg(F.count_distinct("l").alias("n")).filter("n > 1").select(parent)
    return children.select(parent, child).join(lists.select(parent, "candidate").distinct(), parent), split


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], l: str, r: str, tolerance: float, left_id: list[str], right_id: str) -> DataFrame:
    """left with the id and value of the nearest right value within the tolerance, null if none; ties by id.

    Values are dealt to bins of the tolerance's width and each left row looks in three: an equi-join, no range scan. Equal right values are
    one, that of the smallest id.
    ``left_id`` names each left row.
    """
    value = F.col(r)
    known = right.filter(value.isNotNull()).groupBy(*on, value.alias("__v")).agg(F.min(right_id).alias("__id"))  # equal values are one
    bins = known.withColumn("__b", F.floor(F.col("__v") / tolerance))
    cell = F.floor(F.col(l) / tolerance)
    keys = list(dict.fromkeys([*left_id, *on]))
    probes = left.select(*keys, F.col(l).alias("__x"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__b"))
    near = probes.join(bins, [*on, "__b"]).withColumn("__d", F.abs(F.col("__x") - F.col("__v"))).filter(F.col("__d") <= tolerance)
    best = near.groupBy(*left_id).agg(F.min(F.struct(F.col("__d").alias("d"), F.col("__id").alias("id"), F.col("__v").alias("v"))).alias("m"))
    return left.join(best, left_id, "left").select(*left.columns, F.col("m.id").alias(right_id), F.col("m.v").alias(r))


def ppm_match(peaks: DataFrame, masses: DataFrame, on: list[str], mz: str, mass: str, score: str, ppm: float, peak_id: list[str]) -> DataFrame:
    """Of each peak the mass in its ppm window: fewest ppm, then lowest score; with ppm and the number of matches.

    Buckets of the logarithm as wide as the window make the range an equi-join on three buckets.
    """
    width = math.log((1 + ppm * 1e-6) / (1 - ppm * 1e-6))
    # equal masses are one, with the lowest score and how many they are
    m = masses.groupBy(*on, mass).agg(F.min(score).alias(score), F.count(F.lit(1)).alias("__n")).withColumn("__b", F.floor(F.ln(mass) / width))
    p = peaks.withColumn("__c", F.floor(F.ln(mz) / width)).withColumn("__b", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1)))
    off = F.abs(F.col(mz) - F.col(mass)) / F.col(mass) * 1e6
    met = p.join(m, [*on, "__b"]).withColumn("ppm", off).filter(F.col("ppm") <= ppm)
    best = F.min(F.struct("ppm", score, mass)).alias("b")
    return met.groupBy(*peak_id).agg(best, F.sum("__n").alias("matches")).select(*peak_id, "b.*", "matches")


def fill_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join; where both have a column, left's value or else right's."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c != key])
    out = left.join(r, key, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in shared}).drop(*[f"__{c}" for c in shared]) if shared else out


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join that fails on a key that is repeated or missing on either side."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    check = counted(left, "a").join(counted(right, "b"), key, "full").agg(F.count_if(~F.col("a").eqNullSafe(F.lit(1)) | ~F.col("b").eqNullSafe(F.lit(1))).alias("bad")).first()
    if check["bad"]:
        raise ValueError(f"{check['bad']} keys are repeated or missing")
    return left.join(right, key)


def pair_methods(df: DataFrame, key: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """(key, a, b): both methods' values of the keys that both have."""
    x, y = (df.filter(F.col(method) == m).select(key, F.col(value).alias(n)) for m, n in ((a, "a"), (b, "b")))
    return x.join(y, key)


def has_positive(queries: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """queries with support (library rows of their key) and has_positive."""
    n = library.groupBy(key).agg(F.count(F.lit(1)).alias("support"))
    out = queries.join(n, key, "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return out.withColumn("has_positive", F.col("support") > 0)


def shared_roles(df: DataFrame, key: str, mode: str, role: str, modes: tuple) -> DataFrame:
    """(role, key) that both modes have."""
    a, b = (df.filter(F.col(mode) == m).select(role, key) for m in modes)
    return a.intersect(b)


def attach_vectors(tasks: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """tasks with their vector; a missing one is an error."""
    out = tasks.join(vectors.select(key, vector), key, "left")
    return out.withColumn(vector, F.when(F.col(vector).isNotNull(), F.col(vector)).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col(key))).cast(dict(vectors.dtypes)[vector])))


def fill_cache(keys: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """The cached rows of the keys and ``compute(missing)`` for the others."""
    hits = cache.join(keys.select(key).distinct(), key, "left_semi")
    missing = keys.select(key).distinct().join(cache.select(key), key, "left_anti")
    return hits.unionByName(compute(missing))

