"""Similarity search and ranking over vectors, fingerprints and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import centroid, cosine, dot, l2
from . import listjoin, tiles


#: Queries of one tile, and bytes of query vectors that may be broadcast; more tiles are shuffled to parts of the library.
QUERY_TILE, BROADCAST_BYTES = 256, 64 << 20


def score_pairs(queries: DataFrame, library: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(query, query_label, key, label, score): the cosine of each stated query with every library row but itself (``tiles.all_scores``)."""
    return tiles.all_scores(queries, library, key, vector, label)


def search_one(df: DataFrame, key: str, vector: str, query_id, k: int) -> DataFrame:
    """(key, rank, score): the ``k`` vectors of largest cosine with one row's, itself left out; ties by key."""
    q = df.filter(F.col(key) == query_id).select(F.col(vector).alias("__q")).limit(1)
    scored = df.filter(F.col(key) != query_id).crossJoin(F.broadcast(q)).select(key, cosine(F.col(vector), F.col("__q")).alias("score"))
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def blocked_topk(queries: DataFrame, library: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True) -> DataFrame:
    """(query, key, score, rank): for each query the ``k`` library rows of largest cosine, ties by key (``tiles.top_k``)."""
    return tiles.top_k(queries, library, key, vector, k, exclude_self)


def top1(pairs: DataFrame, query: str, candidate: str, score: str, correct: str) -> DataFrame:
    """(query, candidate, score, correct) of the best-scored candidate; ties by candidate. A partial aggregate."""
    best = pairs.groupBy(query).agg(F.max_by(F.struct(candidate, score, correct), F.struct(F.col(score), -F.col(candidate))).alias("b"))
    return best.select(query, "b.*")


def top1_ties(pairs: DataFrame, query: str, candidate: str, score: str, correct: str, seed: int) -> DataFrame:
    """The best candidate with ties by seeded hash, how many tie, how many of these are correct, and whether both kinds do."""
    top = pairs.groupBy(query).agg(F.max(score).alias("__s"))
    tied = pairs.join(top, query).filter(F.col(score) == F.col("__s"))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), query, candidate), 256)
    out = tied.groupBy(query).agg(F.min_by(candidate, key).alias(candidate), F.count(F.lit(1)).alias("ties"), F.count_if(F.col(correct)).alias("correct_ties"))
    return out.withColumn("mixed", (F.col("correct_ties") > 0) & (F.col("correct_ties") < F.col("ties")))


def pair_rank(pairs: DataFrame, query: str, candidate: str, score: str, truth: str) -> DataFrame:
    """(query, rank) of the one true candidate: 1 + greater scores + equal ones with a smaller id."""
    best = pairs.groupBy(query).agg(F.max(F.when(F.col(truth), F.col(score))).alias("__s"), F.min(F.when(F.col(truth), F.col(candidate))).alias("__c"))
    before = (F.col(score) > F.col("__s")) | ((F.col(score) == F.col("__s")) & (F.col(candidate) < F.col("__c")))
    return pairs.join(best.filter("__s is not null"), query).groupBy(query).agg((1 + F.count_if(before)).alias("rank"))


def first_hit_rank(pairs: DataFrame, query: str, candidate: str, score: str, correct: str) -> DataFrame:
    """(query, rank) of the first correct candidate by score, ties by id; the list's length + 1 if there's none."""
    best = pairs.groupBy(query).agg(F.max(F.when(F.col(correct), F.struct(F.col(score).alias("s"), (-F.col(candidate)).alias("c")))).alias("__b"))
    me = F.struct(F.col(score).alias("s"), (-F.col(candidate)).alias("c"))
    return pairs.join(best, query).groupBy(query).agg((1 + F.count_if(F.coalesce(me > F.col("__b"), F.lit(True)))).alias("rank"))


def rank_molecules(pairs: DataFrame, query: str, molecule: str, row: str, score: str, n: int = 10) -> DataFrame:
    """(query, molecule, rank, row, score): molecules by their best spectrum, ties by the earliest row; the first ``n``."""
    best = pairs.groupBy(query, molecule).agg(F.max(score).alias(score), F.min_by(row, F.struct(-F.col(score), F.col(row))).alias(row))
    w = Window.partitionBy(query).orderBy(F.desc(score), row)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rank_candidates(pairs: DataFrame, query: str, candidate: str, score: str, truth: str, k: int = 50) -> DataFrame:
    """One row a query: rank and score of its best truth, how many candidates, how many tie with the truth, the first ``k`` candidates."""
    w = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    r = pairs.withColumn("__r", F.row_number().over(w))
    best = F.max(F.when(F.col(truth), F.col(score)))
    out = r.groupBy(query).agg(
        F.min(F.when(F.col(truth), F.col("__r"))).alias("rank"), F.count(F.lit(1)).alias("n_candidates"), best.alias("truth_score"),
        F.array_sort(F.collect_list(F.when(F.col("__r") <= k, F.struct("__r", candidate, score)))).alias("__t"),
    )
    return out.select(query, "rank", "n_candidates", "truth_score", F.col(f"__t.{candidate}").alias("top_candidates"), F.col(f"__t.{score}").alias("top_scores"))


def fingerprint_score(a: Column, b: Column, mode: str) -> Column:
    """Score of a predicted vector a against a 0/1 vector b."""
    ab, aa, bb = dot(a, b), dot(a, a), dot(b, b)
    if mode == "tanimoto":
        return ab / F.nullif(aa + bb - ab, F.lit(0.0))
    if mode == "hard_tanimoto":
        hard = F.transform(a, lambda x: F.when(x >= 0.5, 1.0).otherwise(0.0))
        return dot(hard, b) / F.nullif(dot(hard, hard) + bb - dot(hard, b), F.lit(0.0))
    if mode == "cosine":
        return cosine(a, b)
    if mode == "dot":
        return ab
    if mode == "positive_mean":
        return ab / F.nullif(bb, F.lit(0.0))
    if mode == "likelihood":
        part = F.zip_with(a, b, lambda x, y: y * F.ln(F.greatest(x, F.lit(1e-6))) + (1 - y) * F.ln(F.greatest(1 - x, F.lit(1e-6))))
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    raise ValueError(mode)


def normalize_scores(df: DataFrame, query: str, score: str, mode: str) -> DataFrame:
    """Scores of each query as z-scores (0 without spread), ranks over n - 1, or by minimum and maximum.

    Per-query moments come from an aggregate joined back; only ranks need a window.
    """
    if mode == "none":
        return df
    if mode == "rank":
        w = Window.partitionBy(query)
        r = F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(query, score)) - 1) / 2.0
        n = F.count(F.lit(1)).over(w)
        return df.withColumn(score, F.when(n > 1, (r - 1) / (n - 1)).otherwise(0.0))
    s = df.groupBy(query).agg(F.avg(score).alias("__m"), F.stddev_pop(score).alias("__d"), F.min(score).alias("__a"), F.max(score).alias("__b"))
    low, spread = ("__m", F.col("__d")) if mode == "zscore" else ("__a", F.col("__b") - F.col("__a"))
    out = F.when(spread >= 1e-12, (F.col(score) - F.col(low)) / spread).otherwise(0.0)
    return df.join(s, query).withColumn(score, out).drop("__m", "__d", "__a", "__b")


def fuse_scores(df: DataFrame, by: list[str], member: str, score: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the members present."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col(member) == name, value).otherwise(w)
    return df.groupBy(*by).agg((F.sum(F.col(score) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(score))


def fuse_columns(parts: list[tuple[Column, float]]) -> Column:
    """``fuse_scores`` of members that lie in columns of one row: the weighted mean of those that aren't null, without a shuffle."""
    total, weight = (sum((F.when(c.isNotNull(), w * x).otherwise(0.0) for c, w, x in [(c, w, c if over else F.lit(1.0)) for c, w in parts]), F.lit(0.0)) for over in (True, False))
    return total / F.nullif(weight, F.lit(0.0))


def normalize_all(df: DataFrame, query: str, score: str) -> DataFrame:
    """``df`` with zscore, minmax and rank (``normalize_scores``): rows are dealt by query and sorted by score once."""
    w = Window.partitionBy(query)
    n, low, high = F.count(F.lit(1)).over(w), F.min(score).over(w), F.max(score).over(w)
    r = F.rank().over(w.orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(query, score)) - 1) / 2.0
    at = lambda a, d: F.when(d >= 1e-12, (F.col(score) - a) / d).otherwise(0.0)
    rows = df.select("*", r.alias("__r"), n.alias("__n"), low.alias("__a"), high.alias("__b"), F.avg(score).over(w).alias("__m"), F.stddev_pop(score).over(w).alias("__d"))
    rank = F.when(F.col("__n") > 1, (F.col("__r") - 1) / (F.col("__n") - 1)).otherwise(0.0)
    return rows.select(*df.columns, at(F.col("__m"), F.col("__d")).alias("zscore"), at(F.col("__a"), F.col("__b") - F.col("__a")).alias("minmax"), rank.alias("rank"))


def _directed(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name, u): unit vectors of the rows that have a key and a direction."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias(name), l2(F.col(vector)).alias("u"))
    return rows.filter(F.col("u").isNotNull() & (dot(F.col("u"), F.col("u")) > 0.5))


def ann_index(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, code): every row that has a direction as one byte an entry, its largest entry being 127. An eighth of its double vector;
    angles stay to within half a degree or so. Nothing is fitted, so rows may be added at any time."""
    unit = _directed(df, key, vector, key)
    most = F.array_max(F.transform("u", lambda x: F.abs(x)))
    return unit.select(key, F.transform("u", lambda x: F.round(x * 127 / most).cast("tinyint")).alias("code"))


def ann_topk(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, refine: int = 4, probes: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query, key, score, rank): near the ``k`` vectors of largest cosine.

    The ``refine`` k rows of the best codes (``ann_index``, or an ``index`` that it wrote before) are ranked anew by their vectors, so that of
    all vectors only these are read for a query. With ``probes``, rows of that many cells are ranked in place (``cell_topk``):
    less work where vectors cluster. Rows without a direction are left out; a query has ``k`` rows where there are as many.
    """
    if probes is not None:
        return cell_topk(df, key, vector, queries, k, probes)
    asked = _directed(queries, key, vector, "query")
    codes = ann_index(df, key, vector) if index is None else index
    near = tiles.top_k(asked.select(F.col("query").alias(key), F.col("u").alias("code")), codes.withColumn("code", F.col("code").cast("array<double>")), key, "code", refine * k)
    rows = near.select("query", key).join(_directed(df, key, vector, key), key).join(asked.dropDuplicates(["query"]).withColumnRenamed("u", "q"), "query")
    scored = rows.select("query", key, dot(F.col("q"), F.col("u")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cell_topk(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, probes: int, seed: int = 1, cells: int = 64, sample: int = 20_000) -> DataFrame:
    """(query, key, score, rank): near the ``k`` vectors of largest cosine, from the cells around each query.

    ``cells`` centres are fitted on the ``sample`` rows first by hash; every row lies in the cell of its nearest centre. A query
    meets all rows of its ``probes`` nearest cells, and of further ones until these hold k rows besides itself. Rows without a
    direction (null or zero vectors) are in no cell.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    unit, asked = _directed(df, key, vector, key), _directed(queries, key, vector, "query")
    first = unit.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).select(array_to_vector("u").alias("f"))
    if first.isEmpty():
        types = dict(df.dtypes)
        return spark.createDataFrame([], f"query {types[key]}, {key} {types[key]}, score double, rank int")
    model = KMeans(featuresCol="f", predictionCol="cell", k=cells, seed=seed, maxIter=10).fit(first)
    rows = model.transform(unit.withColumn("f", array_to_vector("u"))).drop("f")
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    near = [F.struct((sum(x * x for x in c) - 2 * dot(F.col("u"), F.lit(c))).alias("d"), F.lit(i).alias("cell"), F.lit(sizes.get(i, 0)).cast("bigint").alias("n")) for i, c in enumerate(centers)]
    asked = asked.withColumn("c", F.sort_array(F.array(*near)))
    held = lambda j: F.aggregate(F.slice("c", 1, j), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    met = asked.select("query", F.col("u").alias("q"), F.explode(F.filter("c", lambda x, j: (j < probes) | (held(j) <= k))).alias("x")).select("query", "q", F.col("x.cell").alias("cell"))
    n, on = met.count(), ["cell"]
    if n * (8 * len(centers[0]) + 64) <= tiles.BROADCAST_BYTES:
        met = F.broadcast(met)
    else:  # a cell may hold a large share of all rows: its rows are dealt to parts, and each part gets the cell's queries
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows, on = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), ["cell", "part"]
    scored = rows.join(met, on).filter(F.col("query") != F.col(key)).select("query", key, dot(F.col("q"), F.col("u")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_curves(pairs: DataFrame, query: str, candidate: str, score: str, correct: str, other_group: Column, ks: list[int]) -> DataFrame:
    """(k, hit): the share of queries with a correct candidate of another group among its first k."""
    w = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    first = pairs.filter(other_group).withColumn("__r", F.row_number().over(w)).groupBy(query).agg(F.min(F.when(F.col(correct), F.col("__r"))).alias("r"))
    rows = first.select("r", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return rows.groupBy("k").agg(F.avg(F.coalesce((F.col("r") <= F.col("k")).cast("double"), F.lit(0.0))).alias("hit"))


def centroid_rank(queries: DataFrame, references: DataFrame, key: str, group: str, row: str, vector: str) -> DataFrame:
    """(row, rank, positive, best_wrong, margin): each query against the unit centroids of its group's keys."""
    centers = centroid(references, key, vector).withColumnRenamed(vector, "__c")
    centers = centers.join(references.select(key, group).distinct(), key).withColumnRenamed(key, "__k")
    pairs = queries.join(centers, group).select(row, key, "__k", cosine(F.col(vector), F.col("__c")).alias("s"))
    mine = F.col("__k") == F.col(key)
    out = pairs.groupBy(row).agg(F.max(F.when(mine, F.col("s"))).alias("positive"), F.max(F.when(~mine, F.col("s"))).alias("best_wrong"), F.collect_list("s").alias("all")).filter("positive is not null")
    rank = 1 + F.size(F.filter("all", lambda x: x > F.col("positive")))
    return out.select(row, rank.alias("rank"), "positive", "best_wrong", (F.col("positive") - F.col("best_wrong")).alias("margin"))


def nearest_label(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, nearest): the label of the nearest other vector, for rows whose label others share."""
    often = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(label)
    best = blocked_topk(df.join(often, label, "left_semi"), df, key, vector, 1)
    names = df.select(key, F.col(label).alias("nearest"))
    return best.join(names, key).select(F.col("query").alias(key), "nearest").join(df.select(key, label), key)


def block_similarity(bins: DataFrame, block: str, key: str, threshold: float = 1e-12) -> DataFrame:
    """(block, a, b, similarity) of the pairs in a block with at least ``threshold``: products of unit sparse vectors, clipped to 1.

    Without a threshold, pairs of non-negative vectors that share a bin (``listjoin.cosine_join``).
    """
    return listjoin.cosine_join(bins, block, key, threshold)


def pairwise_tanimoto(bits: DataFrame, key: str, bit: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of sets at least ``threshold`` alike; equal sets are each paired with the first of them only."""
    pairs, members = listjoin.tanimoto_join(bits, key, bit, threshold)
    copies = members.filter(F.col(key) != F.col("representative")).select(F.col("representative").alias("a"), F.col(key).cast("bigint").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies)


def best_positive(pairs: DataFrame, query: str, score: str, correct: str) -> DataFrame:
    return pairs.groupBy(query).agg(F.max(F.when(F.col(correct), F.col(score))).alias("best_positive"), F.max(score).alias("best"))


def peak_scores(peaks: DataFrame, weights: DataFrame, bin_of: Column) -> DataFrame:
    """Peaks with score: the weight of their bin times their intensity, 0 without one."""
    w = weights.select(F.col("bin").alias("__bin"), F.col("weight").alias("__w"))
    rows = peaks.withColumn("__b", bin_of).join(w, F.col("__b") == F.col("__bin"), "left")
    return rows.withColumn("score", F.coalesce(F.col("__w") * F.col("intensity"), F.lit(0.0))).drop("__b", "__bin", "__w")
