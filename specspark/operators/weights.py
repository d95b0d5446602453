"""Weights of score members on a grid over the simplex, chosen by the ranks that they give the true candidates.

A query's candidates meet all weights in one matrix product. Its best truth under each weight is a threshold, and its rank is one more
than the candidates over it, so nothing is sorted and no row is made for a weight. Queries of many candidates are cut into parts that
all hold the truths.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of a part, weights of a grid at most (they are sent to all tasks), candidates by weights of one product.
PART, MOST_WEIGHTS, PRODUCT = 4096, 20_000, 4_000_000


def simplex(members: int, steps: int) -> np.ndarray:
    """All weights in multiples of 1 / ``steps`` that add up to 1, a row each, in rising order."""
    many = comb(steps + members - 1, members - 1)
    if many > MOST_WEIGHTS:
        raise ValueError(f"{many} weights; at most {MOST_WEIGHTS}")
    bars = np.array(list(combinations(range(steps + members - 1), members - 1)), dtype=np.int64).reshape(many, members - 1)
    edges = np.concatenate([np.full((len(bars), 1), -1), bars, np.full((len(bars), 1), steps + members - 1)], axis=1)
    return (np.diff(edges, axis=1) - 1) / steps


def _over(scores: np.ndarray, truth: np.ndarray, ids: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each weight, how many candidates that aren't true come before the best true one: by score, then by id."""
    mine, named = scores[truth], ids[truth]
    best = np.round(mine @ grid.T, 9)
    first = np.where(best == best.max(axis=0), named[:, None], np.iinfo(np.int64).max).min(axis=0)
    best, over = best.max(axis=0), np.zeros(len(grid), dtype=np.int64)
    others, ids = scores[~truth], ids[~truth]
    each = max(1, PRODUCT // len(grid))
    for at in range(0, len(others), each):
        s = np.round(others[at : at + each] @ grid.T, 9)
        over += ((s > best) | ((s == best) & (ids[at : at + each, None] < first))).sum(axis=0)
    return over


def choose_weights(df: DataFrame, query: str, candidate: str, member: str, score: str, truth: str, names: list[str], steps: int = 5) -> DataFrame:
    """(weights, top1, mrr, top5): weights of the members ``names``, in steps, of the largest top-1, then MRR to 9 digits, then top-5,
    then the smallest.

    A candidate's missing member scores count as 0. Queries without a true candidate don't count; without any, there is no row.
    Candidates are whole numbers.
    """
    grid = simplex(len(names), steps)
    spark = df.sparkSession
    known = [F.coalesce(F.max(F.when(F.col(member) == n, F.col(score).cast("double"))), F.lit(0.0)) for n in names]
    wide = df.groupBy(F.col(query).alias("q"), F.col(candidate).cast("bigint").alias("c")).agg(F.array(*known).alias("s"), F.max(truth).alias("t"))
    sizes = wide.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("truths")).filter("truths > 0")
    wide = wide.join(sizes.select("q", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "q")
    own = F.array(F.pmod(F.xxhash64("c"), "parts").cast("int"))
    dealt = wide.select("q", "c", "s", F.coalesce("t", F.lit(False)).alias("t"), "parts", F.explode(F.when(F.col("t"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)).alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def over(parts: list[pa.RecordBatch]) -> np.ndarray:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            scores = rows.column(2).flatten().to_numpy().reshape(-1, len(names))
            return _over(scores, rows.column(3).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(), grid)

        waiting, now = [], None
        for batch in batches:
            queries, parts = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), batch.column(5).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(queries) != 0) | (np.diff(parts) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = (batch.column(0)[lo].as_py(), parts[lo])
                if key != now and waiting:
                    yield out(now[0], waiting, over(waiting))
                    waiting = []
                now = key
                waiting.append(batch.slice(lo, hi - lo))
        if waiting:
            yield out(now[0], waiting, over(waiting))

    def out(q, waiting: list[pa.RecordBatch], over: np.ndarray) -> pa.RecordBatch:
        whole = waiting[0].column(4)[0].as_py() == 1
        return pa.RecordBatch.from_arrays([pa.array([q], waiting[0].schema.field("q").type), pa.array([whole]), pa.array([over], pa.list_(pa.int64()))], names=["q", "whole", "over"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dealt.schema["q"].dataType.simpleString()
    met = dealt.repartition(n, "q", "part").sortWithinPartitions("q", "part").mapInArrow(count, f"q {kind}, whole boolean, over array<bigint>")
    # the parts of one query are added up place by place; most queries are whole
    cells = met.filter("not whole").select("q", F.posexplode("over").alias("i", "x")).groupBy("q", "i").agg(F.sum("x").alias("x"))
    cut = cells.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e")).select(F.col("e.x").alias("over"))
    return pick_weights(met.filter("whole").select("over").unionByName(cut), grid)


def pick_weights(over: DataFrame, grid: np.ndarray) -> DataFrame:
    """(weights, top1, mrr, top5) of the best weights of ``grid``, from one row a query: the candidates over its best truth for each of them."""
    spark, n_weights = over.sparkSession, len(grid)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of whole queries become sums of what their ranks give; one row a task."""
        sums = np.zeros((4, n_weights))
        for batch in batches:
            rank = batch.column(0).flatten().to_numpy().reshape(-1, n_weights) + 1
            sums += [np.full(n_weights, len(rank)), (rank == 1).sum(axis=0), (1.0 / rank).sum(axis=0), (rank <= 5).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in sums], names=["n", "top1", "mrr", "top5"])

    each = over.mapInArrow(add_up, "n array<double>, top1 array<double>, mrr array<double>, top5 array<double>")
    sums = each.select(F.posexplode(F.arrays_zip("n", "top1", "mrr", "top5")).alias("i", "e")).groupBy("i").agg(*[F.sum(f"e.{c}").alias(c) for c in ("n", "top1", "mrr", "top5")])
    fine = sums.filter("n > 0").select("i", *[(F.col(c) / F.col("n")).alias(c) for c in ("top1", "mrr", "top5")])
    best = fine.orderBy(F.desc("top1"), F.desc(F.round("mrr", 9)), F.desc("top5"), "i").limit(1)
    table = F.lit([[float(x) for x in w] for w in grid]) if n_weights <= 256 else None
    if table is None:
        named = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(grid)], "i int, weights array<double>")
        return best.join(named, "i").select("weights", "top1", "mrr", "top5")
    return best.select(F.get(table, "i").alias("weights"), "top1", "mrr", "top5")
