"""Rank, vote, false-discovery, classification and regression metrics, as grouped aggregates and windows.

Score tables may be large: running sums over scores go over distinct scores, after one row a score, in value ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before, settled, with_percentiles


def rank_metrics(df: DataFrame, rank: str, by: list[str] = (), ks: tuple[int, ...] = (1, 5, 20), candidates: str | None = None) -> DataFrame:
    """n, hit@k, MRR, mean, median, p90, p95 and p99 of the ranks of each group, and the mean number of ``candidates`` if that is a column."""
    r = F.col(rank)
    return df.groupBy(*by).agg(
        *([F.avg(candidates).alias("average_candidates")] if candidates else []),
        F.count(rank).alias("n"), *[F.avg((r <= k).cast("double")).alias(f"hit_{k}") for k in ks], F.avg(1.0 / r).alias("mrr"), F.avg(r).alias("mean_rank"),
        *[F.percentile(rank, q).alias(name) for q, name in ((0.5, "median_rank"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))],
    )


def macro_metrics(df: DataFrame, value: str, levels: list[str]) -> DataFrame:
    """The mean of means: by all levels, then without the last, and so on to one row."""
    out = df
    for i in range(len(levels), -1, -1):
        out = out.groupBy(*levels[:i]).agg(F.avg(value).alias(value))
    return out.withColumnRenamed(value, f"macro_{value}")


def stratified(df: DataFrame, strata: dict[str, Column], rank: str, least: int = 1) -> DataFrame:
    """rank_metrics of each named condition; a row may be in several. Conditions with fewer than ``least`` rows go."""
    names = F.filter(F.array(*[F.when(c, n) for n, c in strata.items()]), lambda x: x.isNotNull())
    return rank_metrics(df.withColumn("stratum", F.explode(names)), rank, ["stratum"]).filter(F.col("n") >= least)


def consensus(df: DataFrame, group: str, candidates: str, depth: int) -> DataFrame:
    """(group, candidate, rank, firsts, borda): by first choices, then Borda points (n - r) / n, then name.

    ``candidates`` is each member's list, best first; only its first ``depth`` count, n of them.
    """
    votes = df.withColumn("__l", F.slice(candidates, 1, depth)).select(group, F.size("__l").alias("n"), F.posexplode("__l").alias("r", "candidate"))
    sums = votes.groupBy(group, "candidate").agg(F.count_if(F.col("r") == 0).alias("firsts"), F.sum((F.col("n") - F.col("r")) / F.col("n")).alias("borda"))
    w = Window.partitionBy(group).orderBy(F.desc("firsts"), F.desc(F.round("borda", 9)), "candidate")
    return sums.withColumn("rank", F.row_number().over(w))


def evaluate_consensus(ranked: DataFrame, truth: DataFrame, group: str, depth: int) -> DataFrame:
    """(group, rank): the truth's rank in the consensus; absent, the larger of depth + 1 and the list's length + 1."""
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    found = truth.join(ranked.select(group, F.col("candidate").alias("truth"), "rank"), [group, "truth"], "left").join(sizes, group, "left")
    absent = F.greatest(F.lit(depth + 1), F.coalesce("__n", F.lit(0)) + 1)
    return found.select(group, F.coalesce("rank", absent).cast("bigint").alias("rank"))


def evaluate_groups(members: DataFrame, group_rank: DataFrame, group: str, rank: str) -> DataFrame:
    """One row of sums over members: n, single hits, consensus hits and mean reciprocal ranks of both."""
    both = members.join(group_rank.select(group, F.col("rank").alias("__g")), group)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(rank) == 1).alias("single_hits"), F.count_if(F.col("__g") == 1).alias("consensus_hits"),
        F.avg(1.0 / F.col(rank)).alias("single_mrr"), F.avg(1.0 / F.col("__g")).alias("consensus_mrr"),
    )


def vote_trajectory(df: DataFrame, group: str, order: str, candidates: str, depth: int) -> DataFrame:
    """(group, member, winner): the consensus' first after each added member."""
    votes = df.withColumn("__l", F.slice(candidates, 1, depth)).select(group, order, F.size("__l").alias("n"), F.posexplode("__l").alias("r", "candidate"))
    grid = df.select(group, order).distinct().join(votes.select(group, "candidate").distinct(), group)
    points = grid.join(votes, [group, order, "candidate"], "left")
    w = Window.partitionBy(group, "candidate").orderBy(order)
    running = points.select(
        group, order, "candidate", F.sum(F.when(F.col("r") == 0, 1).otherwise(0)).over(w).alias("firsts"),
        F.round(F.sum(F.when(F.col("r").isNotNull(), (F.col("n") - F.col("r")) / F.col("n")).otherwise(0)).over(w), 9).alias("borda"),
    )
    best = F.min_by("candidate", F.struct(-F.col("firsts"), -F.col("borda"), F.col("candidate")))
    return running.groupBy(group, order).agg(best.alias("winner"))


def fdr_frontier(df: DataFrame, score: str, correct: str, eligible: str | None = None, least: int = 10, by: list[str] = ()) -> DataFrame:
    """(score, accepted, correct, fdr, recall): accepting every row of at least a score, equal scores as one.

    fdr is null under ``least`` accepted rows; recall is of the rows that ``eligible`` marks (all by default). Rows
    whose score is null, infinite or not a number are left out.
    """
    blocks = settled(df.filter(F.abs(F.col(score).cast("double")) < float("inf")).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col(correct)).alias("__c"), F.count_if(F.col(eligible) if eligible else F.lit(True)).alias("__e")))
    rows = before(blocks, score, {"__nb": ("sum", "__n"), "__cb": ("sum", "__c")}, by, descending=True, written=True)
    totals = blocks.groupBy(*by).agg(F.sum("__e").alias("__all")).select(*[F.col(c).alias(f"__of_{c}") for c in by], "__all")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    rows = rows.join(totals, same) if by else rows.crossJoin(F.broadcast(totals))
    out = rows.select(*by, score, (F.col("__nb") + F.col("__n")).alias("accepted"), (F.col("__cb") + F.col("__c")).alias("correct"), F.col("__all").alias("eligible"))
    return out.withColumn("fdr", F.when(F.col("accepted") >= least, 1 - F.col("correct") / F.col("accepted"))).withColumn(
        "recall", F.when(F.col("eligible") > 0, F.col("correct") / F.col("eligible")))


def fdr_working_point(frontier: DataFrame, most: float, score: str) -> DataFrame:
    """The row of an fdr of at most ``most`` with the largest recall, then the smallest fdr, then the strictest score.

    Where no row is within ``most``, nothing is accepted: a null score and fdr, recall 0.
    """
    columns = [score, "accepted", "correct", "eligible", "fdr", "recall"]
    rank = F.when(F.col("fdr") <= most, F.struct("recall", -F.col("fdr"), F.col(score)))
    best = frontier.agg(F.max_by(F.struct(*columns), rank).alias("b"), F.max("eligible").alias("all"))
    zero = {"accepted": F.lit(0), "correct": F.lit(0), "eligible": F.col("all"), "recall": F.lit(0.0)}
    return best.select(*[(F.coalesce(f"b.{c}", zero[c]) if c in zero else F.col(f"b.{c}")).alias(c) for c in columns])


def mean_low_fdr_recall(frontier: DataFrame, most: float = 0.05) -> DataFrame:
    """The mean over fdr in [0, most] of the best recall at that fdr or less, a step function.

    Its area is the last height times ``most``, less each rise times the fdr where it happens.
    """
    steps = frontier.filter(F.col("fdr") <= most).groupBy("fdr").agg(F.max("recall").alias("recall"))
    rises = before(steps, "fdr", {"held": ("max", "recall")})
    held = F.coalesce("held", F.lit(0.0))
    rise = F.greatest(F.coalesce("recall", F.lit(0.0)) - held, F.lit(0.0))
    area = F.max("recall") * most - F.sum(F.col("fdr") * rise)
    return rises.agg((F.coalesce(area, F.lit(0.0)) / most).alias("mean_recall"))


def fdr_envelope(frontier: DataFrame, grid: list[float]) -> DataFrame:
    """(fdr_limit, recall): the best recall at each limit, 0 if none."""
    limits = F.array(*[F.struct(F.lit(g).alias("g")) for g in grid])
    rows = frontier.filter(F.col("fdr").isNotNull()).select("recall", F.explode(F.filter(limits, lambda x: F.col("fdr") <= x["g"])).alias("x"))
    best = rows.groupBy(F.col("x.g").alias("fdr_limit")).agg(F.max("recall").alias("recall"))
    base = frontier.sparkSession.createDataFrame([(g,) for g in grid], "fdr_limit double")
    return base.join(best, "fdr_limit", "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))


def threshold_sweep(df: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """(threshold, accepted, hits, precision): counts of rows at or over each threshold, in one pass."""
    parts = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(score) >= t).alias("accepted"), F.count_if((F.col(score) >= t) & F.col(correct)).alias("hits")) for t in thresholds]
    row = df.agg(F.array(*parts).alias("a"))
    return row.select(F.explode("a").alias("s")).select("s.*").withColumn("precision", F.when(F.col("accepted") > 0, F.col("hits") / F.col("accepted")))


def micro_average(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias("n"))


#: Poisson(1) probabilities of at most 0 to 6. Draws that one SHA-256 digest gives.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)
DRAWS = 8
#: Numbers of an array of draws, and of the sums that a task holds.
BOOT_ROWS, BOOT_SUMS = 2_000_000, 4_000_000


def multiplicities(keys: list[str], rounds: int, seed: int) -> np.ndarray:
    """How often each key is drawn in each round: 32-bit numbers of sha256(seed:block of rounds:key), inverted."""
    blocks = -(-rounds // DRAWS)
    digests = b"".join([hashlib.sha256(f"{seed}:{block}:{key}".encode()).digest() for key in keys for block in range(blocks)])
    u = np.frombuffer(digests, dtype=">u4").reshape(len(keys), blocks * DRAWS)[:, :rounds] / 2.0**32
    return np.searchsorted(POISSON, u, side="right")


def bootstrap_delta(groups: DataFrame, key: str, numerator: str, denominator: str, rounds: int, seed: int, level: float = 0.95, stratum: str | None = None) -> DataFrame:
    """(low, high, mean, p, estimate): sum(numerator) / sum(denominator), and its interval and mean over resampled groups.

    Each group's multiplicities in all rounds are drawn in its own row, Poisson(1) from hashes of (seed, rounds, key), and a task adds
    them up as arrays: what is shuffled is a row a round and task, not one a group. With ``stratum``, each stratum's sums are scaled to
    its size. Groups without a key are left out; null numbers count as 0.
    """
    rows = groups.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("k"), (F.col(stratum).cast("string") if stratum else F.lit("")).alias("s"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in ((numerator, "a"), (denominator, "b"))])
    each = max(1, BOOT_ROWS // max(1, rounds))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for s, m in held.items():
                arrays = [pa.array([x], pa.list_(pa.float64())) for x in m[:4]]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.string()), *arrays], names=["s", "a", "b", "w", "k"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                times = multiplicities(part.column(0).to_pylist(), rounds, seed).astype(np.float64)
                ab = np.stack([part.column(i).to_numpy() for i in (2, 3)] + [np.ones(part.num_rows)])
                codes = part.column(1).dictionary_encode(null_encoding="encode")
                of = codes.indices.to_numpy()
                for i, s in enumerate(codes.dictionary.to_pylist()):
                    mine = of == i
                    sums = np.concatenate([ab[:, mine] @ times[mine], np.full((1, rounds), mine.sum())])
                    held[s] = held[s] + sums if s in held else sums
                if len(held) * 4 * rounds > BOOT_SUMS:
                    yield from out()
        yield from out()

    parts = rows.mapInArrow(add, "s string, a array<double>, b array<double>, w array<double>, k array<double>")
    parts = parts.select("s", F.posexplode(F.arrays_zip("a", "b", "w", "k")).alias("round", "x"))
    sums = parts.groupBy("round", "s").agg(*[F.sum(f"x.{c}").alias(c) for c in "abwk"])
    scale = F.when(F.col("w") > 0, F.col("k") / F.col("w")).otherwise(0.0) if stratum else F.lit(1.0)
    sums = sums.groupBy("round").agg(F.sum(F.col("a") * scale).alias("a"), F.sum(F.col("b") * scale).alias("b"))
    ratios = sums.select(F.when(F.col("b") != 0, F.col("a") / F.col("b")).alias("d"))
    edge = (1 - level) / 2
    n = F.count("d")
    p = F.least(F.lit(1.0), 2 * F.least((F.count_if(F.col("d") <= 0) + 1) / (n + 1), (F.count_if(F.col("d") >= 0) + 1) / (n + 1)))
    drawn = ratios.agg(F.percentile("d", edge).alias("low"), F.percentile("d", 1 - edge).alias("high"), F.avg("d").alias("mean"), p.alias("p"))
    estimate = rows.agg((F.sum("a") / F.nullif(F.sum("b"), F.lit(0.0))).alias("estimate"))
    return drawn.crossJoin(F.broadcast(estimate))  # one row each


def paired_gain(df: DataFrame, old: str, new: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(k, gained, lost, both, net) of paired ranks, in one pass."""
    a, b = F.col(old), F.col(new)
    parts = [F.struct(F.lit(k).alias("k"), F.count_if((a > k) & (b <= k)).alias("gained"), F.count_if((a <= k) & (b > k)).alias("lost"), F.count_if((a <= k) & (b <= k)).alias("both")) for k in ks]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*").withColumn("net", F.col("gained") - F.col("lost"))


def score_blocks(df: DataFrame, score: str, positive: str, by: list[str] = ()) -> DataFrame:
    """One row a score: positives p, negatives n, and those above; ``df`` is read once."""
    blocks = df.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    return before(blocks, score, {"p_above": ("sum", "p"), "n_above": ("sum", "n")}, by, descending=True)


def _area() -> Column:
    """Of score blocks: the area under the ROC curve, ties counted half; null without both classes."""
    return F.sum(F.col("n") * (F.col("p_above") + F.col("p") / 2.0)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))


def _precision() -> Column:
    """Of score blocks: the mean precision at the recall steps; 0 without positives."""
    seen = F.col("p_above") + F.col("p")
    precision = seen / (seen + F.col("n_above") + F.col("n"))
    return F.coalesce(F.sum(F.col("p") * precision) / F.nullif(F.sum("p"), F.lit(0)), F.lit(0.0))


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str] = ()) -> DataFrame:
    return score_blocks(df, score, positive, by).groupBy(*by).agg(_area().alias("auc"))


def roc_auc_and_precision(df: DataFrame, score: str, positive: str, by: list[str] = ()) -> DataFrame:
    """(by, auc, ap) from the same score blocks."""
    return score_blocks(df, score, positive, by).groupBy(*by).agg(_area().alias("auc"), _precision().alias("ap"))


def roc_curve(df: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, fpr, tpr) at each distinct score."""
    b = score_blocks(df, score, positive)
    totals = b.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    rows = b.crossJoin(F.broadcast(totals))
    return rows.select(score, ((F.col("n_above") + F.col("n")) / F.col("tn")).alias("fpr"), ((F.col("p_above") + F.col("p")) / F.col("tp")).alias("tpr"))


def avg_precision(df: DataFrame, score: str, positive: str, by: list[str] = ()) -> DataFrame:
    return score_blocks(df, score, positive, by).groupBy(*by).agg(_precision().alias("ap"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, f1, accuracy): F1 of each class beside the accuracy of all."""
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg((F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    both = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col(truth) == F.col(predicted)).alias("hit"))
    f1 = both.groupBy(F.col("x.c").alias("class")).agg(
        (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("f1"))
    return f1.crossJoin(F.broadcast(total))


def best_threshold(df: DataFrame, score: str, positive: str, points: int = 401) -> DataFrame:
    """(threshold, accuracy): the first of ``points`` thresholds over [0, 1] of the largest accuracy.

    Rows are first counted by grid place, so the grid meets at most ``points`` rows.
    """
    step = 1.0 / (points - 1)
    place = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) / step + 1e-9).cast("int")
    cells = df.groupBy(place.alias("i")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g"))
    right = F.sum(F.when(F.col("i") >= F.col("g"), F.col("p")).otherwise(F.col("n")))
    scored = grid.crossJoin(F.broadcast(cells)).groupBy("g").agg(right.alias("right"), F.sum(F.col("p") + F.col("n")).alias("all"))
    best = scored.agg(F.max_by(F.struct("g", "right", "all"), F.struct("right", -F.col("g"))).alias("b"))
    return best.select((F.col("b.g") * step).alias("threshold"), (F.col("b.right") / F.col("b.all")).alias("accuracy"))


def fuse_and_threshold(train: DataFrame, val: DataFrame, a: str, b: str, positive: str, weights: int = 101, points: int = 101) -> DataFrame:
    """(weight, threshold, accuracy) best on ``val`` of w z(a) + (1 - w) z(b), with z by train's mean and deviation, squeezed to [0, 1]."""
    m = train.agg(F.avg(a).alias("ma"), F.stddev_pop(a).alias("sa"), F.avg(b).alias("mb"), F.stddev_pop(b).alias("sb"))
    z = val.crossJoin(F.broadcast(m))
    za, zb = ((F.col(c) - F.col(f"m{x}")) / F.when(F.col(f"s{x}") > 0, F.col(f"s{x}")).otherwise(1.0) for c, x in ((a, "a"), (b, "b")))
    step = 1.0 / (points - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of all weights, counted in the task: place -1 (null) to points - 1."""
        cells = np.zeros((2, weights, points + 1), dtype=np.int64)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            good = batch.column(0).to_numpy(zero_copy_only=False)
            null = (batch.column(1).is_null().to_numpy(zero_copy_only=False) | batch.column(2).is_null().to_numpy(zero_copy_only=False))[known]
            x, y = (batch.column(i).to_numpy(zero_copy_only=False)[known].astype(float) for i in (1, 2))
            good = good[known].astype(np.int64)
            for w in range(weights):
                mixed = (w / (weights - 1) * x + (1 - w / (weights - 1)) * y + 3) / 6
                mixed = np.where(np.isnan(mixed), 1.0, np.clip(np.round(mixed, 9), 0.0, 1.0))
                place = np.where(null, 0, np.floor(mixed / step + 1e-9).astype(np.int64) + 1)
                cells[:, w] += np.bincount(good * (points + 1) + place, minlength=2 * (points + 1)).reshape(2, points + 1)
        w, i = np.nonzero(cells.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (w, i - 1, cells[1, w, i], cells[0, w, i])], names=["w", "i", "p", "n"])

    cells = z.select(positive, za.alias("za"), zb.alias("zb")).mapInArrow(count, "w bigint, i bigint, p bigint, n bigint")
    cells = cells.groupBy("w", "i").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    grid = cells.select("w", "i", "p", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    scored = grid.groupBy("w", "g").agg(F.sum(F.when(F.col("i") >= F.col("g"), F.col("p")).otherwise(F.col("n"))).alias("right"), F.sum(F.col("p") + F.col("n")).alias("all"))
    best = scored.agg(F.max_by(F.struct("w", "g", "right", "all"), F.struct("right", -F.col("w"), -F.col("g"))).alias("b"))
    return best.select((F.col("b.w") / (weights - 1)).alias("weight"), (F.col("b.g") * step).alias("threshold"), (F.col("b.right") / F.col("b.all")).alias("accuracy"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, tolerance: float, by: list[str] = ()) -> DataFrame:
    """MAE, RMSE, median error, R2, Pearson and the share of errors within the tolerance."""
    e = F.col(predicted) - F.col(truth)
    plain = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0))).alias("r2"), F.corr(truth, predicted).alias("pearson"),
        F.avg((F.abs(e) <= tolerance).cast("double")).alias("within"),
    )
    out = with_percentiles(plain, df.select(*by, F.abs(e).alias("__e")), "__e", {"median_error": 0.5}, by)
    return out.select(*by, "mae", "rmse", "median_error", "r2", "pearson", "within")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the mean rank from 1 of equal values: from counts of distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = before(counts, value, {"__less": ("sum", "__n")}).select(value, (F.col("__less") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties averaged."""
    ranked = average_rank(average_rank(df.select(a, b), a, "__ra"), b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"))


def topn_peaks(df: DataFrame, key: str, score: str, order: str, positive: str, intensity: str, n: int) -> DataFrame:
    """(key, hits, precision, recall, capture) of each key's ``n`` best-scored peaks."""
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    r = df.withColumn("__r", F.row_number().over(w))
    top = F.col("__r") <= n
    return r.groupBy(key).agg(
        F.count_if(top & F.col(positive)).alias("hits"), (F.count_if(top & F.col(positive)) / F.count_if(top)).alias("precision"),
        (F.count_if(top & F.col(positive)) / F.nullif(F.count_if(positive), F.lit(0))).alias("recall"),
        (F.sum(F.when(top, F.col(intensity)).otherwise(0.0)) / F.sum(intensity)).alias("capture"),
    )


def hit_recall_curve(df: DataFrame, rank: str, most: int) -> DataFrame:
    """(k, hit_rate) for k = 1..most: ranks are counted once, then the counts are summed up."""
    counts = df.groupBy(F.least(F.col(rank), F.lit(most + 1)).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("n", "r", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"))
    return grid.groupBy("k").agg((F.sum(F.when(F.col("r") <= F.col("k"), F.col("n")).otherwise(0)) / F.sum("n")).alias("hit_rate"))


def repeat_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and standard error over repeats."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))).alias("sem"))


def bit_weights(df: DataFrame, bits: str, cap: float) -> DataFrame:
    """(bit, on, weight): clip((off + 1) / (on + 1), 1, cap) over rows of on-bit arrays."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    on = df.select(F.explode(F.array_distinct(bits)).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("on"))
    w = (F.col("__n") - F.col("on") + 1) / (F.col("on") + 1)
    return on.crossJoin(F.broadcast(total)).select("bit", "on", F.greatest(F.lit(1.0), F.least(F.lit(cap), w)).alias("weight"))


def seed_summary(df: DataFrame, value: str, seed: str, by: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one) and the best seed (ties: the smallest)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.max_by(seed, F.struct(value, -F.col(seed))).alias("best_seed"))


def topk_counts(df: DataFrame, method: str, rank: str, ks: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    return df.groupBy(method).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(rank) <= k).alias(f"top_{k}") for k in ks])


def distribution(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """min, p05, median, mean, p95, max; percentiles are exact, by ``running.percentiles``."""
    plain = df.groupBy(*by).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_percentiles(plain, df, value, {"p05": 0.05, "median": 0.5, "p95": 0.95}, by).select(*by, "min", "p05", "median", "mean", "p95", "max")


def approximate_distribution(df: DataFrame, value: str, by: list[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Like ``distribution`` with approximate percentiles and a distinct count by sketch: one pass of bounded memory."""
    q = {n: F.percentile_approx(value, p, accuracy).alias(n) for n, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))}
    return df.groupBy(*by).agg(F.min(value).alias("min"), q["p05"], q["median"], F.avg(value).alias("mean"), q["p95"], F.max(value).alias("max"), F.approx_count_distinct(value).alias("distinct"))


def class_counts(df: DataFrame, label: str, key: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"))
