"""Filters, deterministic samplers and splits.

A draw is the order of sha256(seed:scope:key): it depends on the key alone, so results don't change with partitions.
Ranks are taken within a key or a class. Global choices of n use ``orderBy().limit(n)``, which keeps n rows a task;
exact shares of all keys rank hash buckets: see ``hash_rank``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *parts: Column | str) -> Column:
    """The hash that orders a draw."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def hash_rank(df: DataFrame, hashed: str, out: str, within: list[str] = ()) -> DataFrame:
    """Add ``out``: the rank from 1 by column ``hashed`` (hexadecimal) within ``within``.

    Rows are ranked inside buckets of the hash's first digits, at least four buckets for each shuffle partition; the buckets'
    counts give the offsets. So not even one group of all rows is sorted in one task.
    """
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("__b", F.substring(hashed, 1, max(2, math.ceil(math.log(most, 16)))))
    keys = list(within)
    counts = df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__f", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*keys, "__b", "__f")
    inside = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(hashed)))
    return inside.join(firsts, [*keys, "__b"]).withColumn(out, F.col("__k") + F.col("__f")).drop("__b", "__k", "__f")


#: Named scenarios: conditions that must all hold.
SCENARIOS = {
    "all": {},
    "urgent": {"adduct": ["1-URGENT", "2-HIGH"]},
    "clean": {"least_peaks": 3, "parent_filter": True},
    "positive": {"polarity": [1], "least_peaks": 2},
}


def apply_scenario(df: DataFrame, name: str) -> DataFrame:
    """Rows of a named scenario; ``parent_filter`` drops peaks over precursor_mz + 1 before peaks are counted."""
    rules = SCENARIOS[name]
    for column in ("adduct", "polarity"):
        if column in rules:
            df = df.filter(F.col(column).isin(rules[column]))
    if rules.get("parent_filter"):
        df = df.withColumn("mz", F.filter("mz", lambda m: m <= F.col("precursor_mz") + 1))
    return df.filter(F.size("mz") >= rules["least_peaks"]) if "least_peaks" in rules else df


def assign_mode(df: DataFrame, modes: dict[str, list[str]]) -> DataFrame:
    """Add mode: the name of the first list that holds the adduct; others go."""
    out = F.lit(None).cast("string")
    for name, adducts in reversed(modes.items()):
        out = F.when(F.col("adduct").isin(adducts), name).otherwise(out)
    return df.withColumn("mode", out).filter("mode is not null")


def min_group(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys with at least ``n`` rows: counted first, then joined, so no key gathers in a window."""
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n).select(key)
    return df.join(often, key, "left_semi")


def split_keys(df: DataFrame, key: str, seed: int, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """(key, split): floor(n test) keys for test, floor(n val) for val, the others for train."""
    keys = df.select(key).distinct().withColumn("__h", draw(seed, key))
    ranked = hash_rank(keys, "__h", "__r")
    total = keys.agg(F.count(F.lit(1)).alias("__n"))  # one row
    ranked = ranked.crossJoin(F.broadcast(total))
    first, second = F.floor(F.col("__n") * test), F.floor(F.col("__n") * val)
    where = F.when(F.col("__r") <= first, "test").when(F.col("__r") <= first + second, "val").otherwise("train")
    return ranked.select(key, where.alias("split"))


def group_split(df: DataFrame, key: str, seed: int, test: float = 0.2) -> DataFrame:
    """Rows with split: whole keys go to test or train."""
    return df.join(split_keys(df, key, seed, test, 0.0), key)


def first_by_hash(df: DataFrame, key: str, row: str, seed: int | str, n: int = 1) -> DataFrame:
    """The ``n`` rows of each key first by hash. For n = 1 a partial aggregate; no key's rows are gathered."""
    drawn = df.withColumn("__h", draw(seed, key, row))
    if n == 1:
        best = drawn.groupBy(key).agg(F.min_by(F.struct(*df.columns), "__h").alias("__b"))
        return best.select("__b.*")
    w = Window.partitionBy(key).orderBy("__h")
    return drawn.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__h", "__r")


def choose_queries(df: DataFrame, key: str, row: str, seed: int) -> DataFrame:
    """One query row for each key."""
    return first_by_hash(df, key, row, seed)


def build_library(df: DataFrame, queries: DataFrame, row: str, allowed: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The rows that are no queries, of allowed keys if given."""
    left = df.join(queries.select(row), row, "left_anti")
    return left if allowed is None else left.join(allowed.select(key).distinct(), key, "left_semi")


def strict_task(df: DataFrame, adduct: str, keys: DataFrame, key: str, row: str, seed: int) -> DataFrame:
    """(row, key, role) of one adduct inside the given keys: keys with two rows or more, one query each, the others library."""
    inside = min_group(df.filter(F.col("adduct") == adduct).join(keys.select(key).distinct(), key, "left_semi"), key, 2).select(row, key)
    queries = choose_queries(inside, key, row, seed).withColumn("role", F.lit("query"))
    return queries.unionByName(build_library(inside, queries, row).withColumn("role", F.lit("library")))


def energy_pairs(df: DataFrame, key: str, row: str, seed: int, low: float = 20, high: float = 40) -> DataFrame:
    """(key, low, high): one row of at most ``low`` and one of at least ``high`` energy of the keys that have both."""
    energy = F.col("collision_energy")
    rows = df.withColumn("__h", draw(seed, key, row))
    best = rows.groupBy(key).agg(
        F.min_by(row, F.when(energy <= low, F.col("__h"))).alias("low"), F.min_by(row, F.when(energy >= high, F.col("__h"))).alias("high"),
        F.count_if(energy <= low).alias("__l"), F.count_if(energy >= high).alias("__m"),
    )
    return best.filter("__l > 0 and __m > 0").select(key, "low", "high")


def alternate_roles(df: DataFrame, key: str, formula: str, order: str) -> DataFrame:
    """Rows with role query or reference by turns in each key, of keys with both and formulas with two such keys."""
    w = Window.partitionBy(key).orderBy(order)
    roles = df.withColumn("role", F.when(F.row_number().over(w) % 2 == 1, "query").otherwise("reference"))
    both = roles.groupBy(formula, key).agg(F.count_distinct("role").alias("__k")).filter("__k = 2").select(formula, key)
    enough = both.groupBy(formula).agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2").select(formula)
    return roles.join(both.join(enough, formula, "left_semi").select(key), key, "left_semi")


def balance_exact(df: DataFrame, column: str, small, large, row: str, seed: int) -> DataFrame:
    """All rows of class ``small`` and as many of ``large``; an error if there are fewer."""
    counts = {r[column]: r["n"] for r in df.filter(F.col(column).isin([small, large])).groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, have = counts.get(small, 0), counts.get(large, 0)
    if have < n:
        raise ValueError(f"class {large} has {have} rows, {n} are needed")
    drawn = hash_rank(df.filter(F.col(column) == large).withColumn("__h", draw(seed, row)), "__h", "__r")
    return df.filter(F.col(column) == small).unionByName(drawn.filter(F.col("__r") <= n).select(*df.columns))


def balanced_sample(df: DataFrame, column: str, row: str, n: int, seed: int, fill: int | None = None) -> DataFrame:
    """``n`` rows of each class, then of the rest by hash until ``fill`` rows."""
    drawn = hash_rank(df.withColumn("__h", draw(seed, row)), "__h", "__r", [column])
    first = drawn.filter(F.col("__r") <= n)
    chosen = first.select(*df.columns)
    if fill is None:
        return chosen
    missing = max(0, fill - chosen.count())
    rest = drawn.filter(F.col("__r") > n).orderBy("__h").limit(missing).select(*df.columns)
    return chosen.unionByName(rest)


def hash_select(df: DataFrame, key: str, n: int, seed: int, scope: str) -> DataFrame:
    """The first ``n`` distinct keys by hash."""
    return df.select(key).distinct().withColumn("__h", draw(seed, F.lit(scope), key)).orderBy("__h").limit(n).select(key)


def round_robin_pick(df: DataFrame, key: str, stratum: str, row: str, cap: int, total: int, seed: int) -> DataFrame:
    """At most ``cap`` rows a key, then strata by turns until ``total`` rows."""
    capped = first_by_hash(df, key, row, seed, cap).withColumn("__h", draw(seed, row))
    ranked = hash_rank(capped, "__h", "__r", [stratum])
    return ranked.orderBy("__r", stratum).limit(total).select(*df.columns)


def repeat_draws(df: DataFrame, column: str, row: str, n: int, repeats: int, seed: int) -> DataFrame:
    """Rows with repeat: ``n`` rows of each class, drawn ``repeats`` times."""
    many = df.crossJoin(F.broadcast(df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("repeat"))))
    drawn = many.withColumn("__h", draw(seed, "repeat", row))
    return hash_rank(drawn, "__h", "__r", ["repeat", column]).filter(F.col("__r") <= n).drop("__h", "__r")


def cap_per_label(df: DataFrame, label: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each label in order. Spark limits groups before it shuffles them."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


def representative(df: DataFrame, key: str, size: Column, row: str) -> DataFrame:
    """Of each key the row of the largest size, then of the lowest row id."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(size.alias("s"), (-F.col(row)).alias("r"))).alias("b"))
    return best.select("b.*")


def exclude_keys(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key), key, "left_anti")


def dedup_spectra(df: DataFrame, key: str, content: Column, row: str) -> DataFrame:
    """The first row of each key and content, with n_equal rows in all."""
    rows = df.withColumn("__c", content)
    best = rows.groupBy(key, "__c").agg(F.min_by(F.struct(*df.columns), row).alias("b"), F.count(F.lit(1)).alias("n_equal"))
    return best.select("b.*", "n_equal")


def sample_pairs(df: DataFrame, key: str, row: str, epoch: int, seed: int) -> DataFrame:
    """(key, first, second): two different rows of each key that has them."""
    two = first_by_hash(df.select(key, row), key, row, f"{seed}:{epoch}", 2).withColumn("__h", draw(f"{seed}:{epoch}", key, row))
    pairs = two.groupBy(key).agg(F.min_by(row, "__h").alias("first"), F.max_by(row, "__h").alias("second"), F.count(F.lit(1)).alias("n"))
    return pairs.filter("n = 2").drop("n")


def cross_pairs(df: DataFrame, key: str, mode: str, row: str, seed: int, modes: tuple) -> DataFrame:
    """(key, a, b): one row of each of two modes for the keys that have both."""
    a, b = (first_by_hash(df.filter(F.col(mode) == m).select(key, row), key, row, f"{seed}:{m}").withColumnRenamed(row, n) for m, n in zip(modes, "ab"))
    return a.join(b, key)


def epoch_sample(df: DataFrame, key: str, row: str, epoch: int, seed: int) -> DataFrame:
    """One row of each key, another in each epoch."""
    return first_by_hash(df, key, row, f"{seed}:{epoch}")


def row_block(df: DataFrame, row: str, start: int, stop: int) -> DataFrame:
    """Rows with start <= row < stop."""
    return df.filter((F.col(row) >= start) & (F.col(row) < stop))


def head_per_fold(df: DataFrame, fold: str, row: str, n: int) -> DataFrame:
    return cap_per_label(df, fold, row, n)


def shard_layout(shards: DataFrame, world: int, workers: int, batch: int, epoch: int, seed: int) -> DataFrame:
    """(shard, rows, rank, worker, batches): shards in the epoch's order go to ranks by turns, the remainder is dropped, each rank's to workers by turns."""
    w = Window.orderBy(draw(f"{seed}:{epoch}", "shard"))  # a list of files
    placed = shards.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    placed = placed.filter(F.col("i") < F.col("n") - F.col("n") % world)
    rank = (F.col("i") % world).cast("int")
    worker = (F.floor(F.col("i") / world) % workers).cast("int")
    return placed.select("shard", "rows", rank.alias("rank"), worker.alias("worker"), F.floor(F.col("rows") / batch).cast("bigint").alias("batches"))


def max_precursor(df: DataFrame, most: float) -> DataFrame:
    return df.filter(F.col("precursor_mz") <= most)


def valid_targets(df: DataFrame, targets: DataFrame, key: str, bits: str) -> DataFrame:
    """Rows whose key has a non-empty fingerprint."""
    return df.join(targets.filter(F.size(bits) > 0).select(key), key, "left_semi")


def dedup_list(values: Column) -> Column:
    """The list without repeats, each value at its first place (a null counts as a value); null for a null list."""
    return F.array_distinct(values)
