"""Queries of joins, grouping, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import PEAKS_SQL, SPECTRA_SQL, metadata, peaks, spectra, table, vectors
from ..functions import peaks as pk
from ..operators import grouping as gr
from ..operators import joins as jn
from ..operators import search as se
from ..operators.metrics import average_rank
from ..registry import query

S = f"WITH {SPECTRA_SQL}"
BOTH = f"WITH {PEAKS_SQL}, {SPECTRA_SQL}"


@query(f"{S}, t AS (SELECT o_custkey AS molecule_id, arg_max(CAST(o_orderkey % 600 AS DOUBLE), o_orderkey) AS rt FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1) SELECT spectrum_id, coalesce(t.rt, 0) AS rt FROM spectra LEFT JOIN t USING (molecule_id)")
def join_rt(spark, sf):
    times = table(spark, sf, "orders").filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("molecule_id"), (F.col("o_orderkey") % 600).cast("double").alias("rt"), "o_orderkey")
    return jn.join_rt(metadata(spark, sf).drop("rt"), times, ["molecule_id"], "o_orderkey").select("spectrum_id", "rt")


CAND = "q AS (SELECT c_custkey AS k, c_custkey % 40 AS truth FROM customer), c AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 40 AS candidate FROM orders), av AS (SELECT i AS candidate FROM generate_series(0, 33) AS t(i))"


def _cand(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 40).alias("truth"))
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 40).alias("candidate"))
    return q, c, spark.range(34).select(F.col("id").alias("candidate"))


@query(f"WITH {CAND}, a AS (SELECT k, candidate FROM c UNION SELECT k, truth FROM q) SELECT a.k, a.candidate, a.candidate = q.truth AS is_true FROM a JOIN q USING (k) WHERE a.candidate IN (SELECT candidate FROM av) AND q.truth IN (SELECT candidate FROM av)")
def expand_candidates(spark, sf):
    q, c, av = _cand(spark, sf)
    return jn.expand_candidates(q, c, av, "k", "truth", "candidate")


@query(f"WITH {CAND} SELECT k, candidate, count(*) AS n FROM (SELECT o_custkey AS k, o_orderkey % 40 AS candidate FROM orders) WHERE candidate <= 33 GROUP BY ALL")
def effective_candidates(spark, sf):
    _, c, av = _cand(spark, sf)
    return jn.effective_candidates(c, av, "candidate").groupBy("k", "candidate").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS p, o_custkey % 2 AS list_id, o_orderkey % 9 AS candidate FROM orders JOIN customer ON o_custkey = c_custkey), x AS (SELECT p, count(DISTINCT l) AS n FROM (SELECT p, list_id, string_agg(CAST(candidate AS VARCHAR), ',' ORDER BY candidate) AS l FROM l GROUP BY ALL) GROUP BY 1)
SELECT c_nationkey AS p, c_custkey AS child, CAST(candidate AS BIGINT) AS candidate, n > 1 AS inconsistent FROM customer JOIN (SELECT DISTINCT p, candidate FROM l) u ON u.p = c_nationkey JOIN x ON x.p = c_nationkey""")
def inherit_candidates(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_nationkey").alias("p"), F.col("c_custkey").alias("child"))
    lists = table(spark, sf, "orders").join(cust.withColumnRenamed("child", "o_custkey"), "o_custkey").select("p", (F.col("o_custkey") % 2).alias("list_id"), (F.col("o_orderkey") % 9).alias("candidate"))
    rows, split = jn.inherit_candidates(cust, lists, "p", "child")
    return rows.join(split.withColumn("inconsistent", F.lit(True)), "p", "left").select("p", "child", "candidate", F.coalesce("inconsistent", F.lit(False)).alias("inconsistent"))


@query(f"""{BOTH}, m AS (SELECT spectrum_id, pos, formula_id, mz FROM peaks JOIN spectra USING (spectrum_id)), r AS (SELECT p_partkey, p_partkey % 25 AS formula_id, p_retailprice / 3 AS mass FROM part),
n AS (SELECT m.spectrum_id, m.pos, r.p_partkey, r.mass, row_number() OVER (PARTITION BY m.spectrum_id, m.pos ORDER BY abs(m.mz - r.mass), r.p_partkey) AS k FROM m JOIN r ON m.formula_id = r.formula_id AND abs(m.mz - r.mass) <= 0.8)
SELECT m.spectrum_id, m.pos, n.p_partkey, round(n.mass, 6) AS mass FROM m LEFT JOIN n ON n.spectrum_id = m.spectrum_id AND n.pos = m.pos AND n.k = 1""")
def nearest_join(spark, sf):
    left = peaks(spark, sf).join(metadata(spark, sf).select("spectrum_id", "formula_id"), "spectrum_id").select("spectrum_id", "pos", "formula_id", "mz")
    right = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 25).cast("int").alias("formula_id"), (F.col("p_retailprice") / 3).alias("mass"))
    out = jn.nearest_join(left, right, ["formula_id"], "mz", "mass", 0.8, ["spectrum_id", "pos"], "p_partkey")
    return out.select("spectrum_id", "pos", "p_partkey", F.round("mass", 6).alias("mass"))


@query(f"""{BOTH}, m AS (SELECT spectrum_id, pos, formula_id, mz FROM peaks JOIN spectra USING (spectrum_id)), r AS (SELECT p_partkey % 25 AS formula_id, p_retailprice / 3 AS mass, CAST(p_size AS INT) AS score FROM part),
n AS (SELECT m.spectrum_id, m.pos, r.mass, r.score, round(abs(m.mz - r.mass) / r.mass * 1000000.0, 6) AS ppm, row_number() OVER (PARTITION BY m.spectrum_id, m.pos ORDER BY abs(m.mz - r.mass) / r.mass * 1000000.0, r.score, r.mass) AS k, count(*) OVER (PARTITION BY m.spectrum_id, m.pos) AS matches FROM m JOIN r ON m.formula_id = r.formula_id AND abs(m.mz - r.mass) / r.mass * 1000000.0 <= 3000)
SELECT spectrum_id, pos, ppm, score, round(mass, 6) AS mass, matches FROM n WHERE k = 1""")
def ppm_match(spark, sf):
    left = peaks(spark, sf).join(metadata(spark, sf).select("spectrum_id", "formula_id"), "spectrum_id").select("spectrum_id", "pos", "formula_id", "mz")
    right = table(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("formula_id"), (F.col("p_retailprice") / 3).alias("mass"), F.col("p_size").alias("score"))
    out = jn.ppm_match(left, right, ["formula_id"], "mz", "mass", "score", 3000.0, ["spectrum_id", "pos"])
    return out.withColumn("ppm", F.round("ppm", 6)).withColumn("mass", F.round("mass", 6))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, t) AS c_acctbal, t FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def fill_join(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    right = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("t")).withColumn("c_acctbal", F.col("t"))
    return jn.fill_join(left, right, "c_custkey").select("c_custkey", "c_acctbal", "t")


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer")
def merge_one_to_one(spark, sf):
    df = table(spark, sf, "customer")
    return jn.merge_one_to_one(df.select("c_custkey", "c_acctbal"), df.select("c_custkey", "c_nationkey"), "c_custkey")


@query("WITH m AS (SELECT o_custkey AS k, o_orderstatus AS s, count(*) AS v FROM orders GROUP BY ALL) SELECT a.k, a.v AS a, b.v AS b FROM m a JOIN m b ON a.k = b.k AND a.s = 'F' AND b.s = 'O'")
def pair_methods(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("v"))
    return jn.pair_methods(m, "k", "s", "v", "F", "O")


@query(f"{S} SELECT c_custkey AS molecule_id, count(spectrum_id) AS support, count(spectrum_id) > 0 AS has_positive FROM customer LEFT JOIN (SELECT * FROM spectra WHERE adduct = '5-LOW') ON molecule_id = c_custkey GROUP BY 1")
def has_positive(spark, sf):
    return jn.has_positive(table(spark, sf, "customer").select(F.col("c_custkey").alias("molecule_id")), metadata(spark, sf).filter("adduct = '5-LOW'"), "molecule_id")


@query(f"{S} SELECT fold, molecule_id FROM spectra WHERE polarity = 0 INTERSECT SELECT fold, molecule_id FROM spectra WHERE polarity = 1")
def shared_roles(spark, sf):
    return jn.shared_roles(metadata(spark, sf), "molecule_id", "polarity", "fold", (0, 1))


@query("SELECT vec_id, len(embedding) AS n, label FROM embeddings")
def attach_vectors(spark, sf):
    v = vectors(spark, sf)
    return jn.attach_vectors(v.select("vec_id", "label"), v, "vec_id", "vector").select("vec_id", F.size("vector").cast("bigint").alias("n"), "label")


# Grouping ----------------------------------------------------------------------------------------------------


@query(f"{S}, b AS (SELECT spectrum_id, adduct || '|' || CAST(round_even(precursor_mz / 10, 0) AS BIGINT) || '|' || CAST(round_even(rt / 100, 0) AS BIGINT) AS block FROM spectra) SELECT spectrum_id, block FROM b WHERE block IN (SELECT block FROM b GROUP BY 1 HAVING count(*) >= 2)")
def block_keys(spark, sf):
    return gr.block_keys(metadata(spark, sf), -1, -2).select("spectrum_id", "block")


def blocks(spark, sf):
    """Rows with their block, and the blocks' vectors."""
    df = gr.block_keys(spectra(spark, sf), -1, -2)
    return df, pk.bin_l2(df.withColumn("k", F.struct("block", "spectrum_id")), "k", 20.0).select("k.*", "bin", "value")


@query(f"""{BOTH}, b AS (SELECT spectrum_id, adduct || '|' || CAST(round_even(precursor_mz / 10, 0) AS BIGINT) || '|' || CAST(round_even(rt / 100, 0) AS BIGINT) AS block FROM spectra), k AS (SELECT block FROM b GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT block, spectrum_id, CAST(round_even(mz / 20, 0) AS INT) AS bin, sum(sqrt(intensity)) AS v FROM peaks JOIN b USING (spectrum_id) WHERE block IN (SELECT block FROM k) GROUP BY ALL), u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY spectrum_id)) AS x FROM n)
SELECT a.block, a.spectrum_id AS a, c.spectrum_id AS b, round(least(1, sum(a.x * c.x)), 6) AS similarity FROM u a JOIN u c ON a.block = c.block AND a.bin = c.bin AND a.spectrum_id < c.spectrum_id GROUP BY ALL""")
def block_similarity(spark, sf):
    return se.block_similarity(blocks(spark, sf)[1], "block", "spectrum_id").withColumn("similarity", F.round("similarity", 6))


@query(f"""{BOTH}, b AS (SELECT spectrum_id, adduct || '|' || CAST(round_even(precursor_mz / 10, 0) AS BIGINT) || '|' || CAST(round_even(rt / 100, 0) AS BIGINT) AS block FROM spectra), k AS (SELECT block FROM b GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT block, spectrum_id, CAST(round_even(mz / 20, 0) AS INT) AS bin, sum(sqrt(intensity)) AS v FROM peaks JOIN b USING (spectrum_id) WHERE block IN (SELECT block FROM k) GROUP BY ALL), u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY spectrum_id)) AS x FROM n)
SELECT a.block, a.spectrum_id AS a, c.spectrum_id AS b, round(least(1, sum(a.x * c.x)), 6) AS similarity FROM u a JOIN u c ON a.block = c.block AND a.bin = c.bin AND a.spectrum_id < c.spectrum_id GROUP BY ALL HAVING sum(a.x * c.x) >= 0.4567""")
def similar_in_blocks(spark, sf):
    return se.block_similarity(blocks(spark, sf)[1], "block", "spectrum_id", 0.4567).withColumn("similarity", F.round("similarity", 6))


@query()
def complete_link_groups(spark, sf):
    df, bins = blocks(spark, sf)
    linked = gr.complete_link_of_bins(bins, "block", "spectrum_id", 0.3)
    members = gr.assign_groups(linked, df.drop("block"), "spectrum_id", [F.asc_nulls_last("collision_energy")])
    return gr.audit_groups(members, "group_id", "molecule_id")


@query(f"{S}, c AS (SELECT formula_id, adduct, count(*) AS n FROM spectra GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY formula_id ORDER BY n DESC, adduct) AS k FROM c) SELECT formula_id, CAST(sum(n) AS BIGINT) AS size, max(CASE WHEN k = 1 THEN adduct END) AS majority, round(max(n) / sum(n), 6) AS purity FROM r GROUP BY 1")
def audit_groups(spark, sf):
    return gr.audit_groups(metadata(spark, sf), "formula_id", "adduct").withColumn("purity", F.round("purity", 6))


@query(f"{S}, c AS (SELECT formula_id, adduct, count(*) AS n FROM spectra GROUP BY ALL), g AS (SELECT formula_id, sum(n) AS size, max(n) / sum(n) AS purity FROM c GROUP BY 1), t AS (SELECT i / 100.0 AS threshold, sum(size) FILTER (WHERE purity >= i / 100.0) / (SELECT count(*) FROM spectra) AS coverage, sum(size * purity) FILTER (WHERE purity >= i / 100.0) / sum(size) FILTER (WHERE purity >= i / 100.0) AS purity FROM g, (VALUES (18), (20), (21), (22)) AS v(i) GROUP BY 1) SELECT CAST(threshold AS DOUBLE) AS threshold, round(coverage, 6) AS coverage, round(purity, 6) AS purity FROM t ORDER BY (coalesce(purity, 0) >= 0.215) DESC, CASE WHEN purity >= 0.215 THEN coverage ELSE purity END DESC, threshold LIMIT 1")
def choose_threshold(spark, sf):
    df = metadata(spark, sf)
    parts = gr.threshold_table(gr.audit_groups(df, "formula_id", "adduct"), [0.18, 0.20, 0.21, 0.22], df).select("threshold", "coverage", "purity")
    return gr.choose_threshold(parts, 0.215).withColumn("coverage", F.round("coverage", 6)).withColumn("purity", F.round("purity", 6))


@query()
def kmeans_quality(spark, sf):
    v = vectors(spark, sf)
    found = gr.kmeans(v, "vec_id", "vector", 10).join(v.select("vec_id", "label"), "vec_id")
    return gr.nmi(found, "cluster", "label").crossJoin(gr.ari(found, "cluster", "label"))


CELLS = f"{S}, c AS (SELECT adduct AS a, fold AS b, count(*) AS n FROM spectra GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)"


@query(f"{CELLS}, k AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS i, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb, sum(n * (n - 1) / 2.0) AS s, sum(n / na * na * (na - 1) / 2.0) AS sa, sum(n / nb * nb * (nb - 1) / 2.0) AS sb, max(t) * (max(t) - 1) / 2.0 AS p FROM m) SELECT round(2 * i / (ha + hb), 6) AS nmi, round((s - sa * sb / p) / ((sa + sb) / 2 - sa * sb / p), 6) AS ari FROM k")
def nmi_and_ari(spark, sf):
    df = metadata(spark, sf)
    out = gr.nmi(df, "adduct", "fold").crossJoin(gr.ari(df, "adduct", "fold"))
    return out.select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS k, avg(1 - list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY ALL),
m AS (SELECT vec_id, max(d) FILTER (WHERE label = k) AS a, min(d) FILTER (WHERE label <> k) AS b FROM d GROUP BY 1) SELECT vec_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM m""")
def silhouette(spark, sf):
    return gr.silhouette(vectors(spark, sf), "vec_id", "vector", "label").withColumn("silhouette", F.round("silhouette", 6))


#: A molecule's set: the ten-unit bins of all its spectra. Equal sets are each paired with the first of them only.
SETS = f"""{BOTH}, b AS (SELECT DISTINCT molecule_id AS k, CAST(floor(mz / 10) AS INT) AS bit FROM peaks JOIN spectra USING (spectrum_id)), s AS (SELECT k, list_sort(list(bit)) AS bits, count(*) AS n FROM b GROUP BY 1),
r AS (SELECT min(k) AS k, bits, n FROM s GROUP BY 2, 3), c AS (SELECT r.k, unnest(bits) AS bit FROM r), o AS (SELECT x.k AS a, y.k AS b, count(*) AS o FROM c x JOIN c y ON x.bit = y.bit AND x.k < y.k GROUP BY ALL)"""


@query(f"{SETS} SELECT a, o.b, round(o / (p.n + q.n - o), 6) AS similarity FROM o JOIN r p ON p.k = a JOIN r q ON q.k = o.b WHERE o / (p.n + q.n - o) >= 0.3999999 UNION ALL SELECT r.k, s.k, 1.0 FROM r JOIN s ON r.bits = s.bits AND r.k < s.k")
def pairwise_tanimoto(spark, sf):
    return se.pairwise_tanimoto(_bits(spark, sf), "molecule_id", "bit", 0.4).withColumn("similarity", F.round("similarity", 6))


def _bits(spark, sf):
    rows = peaks(spark, sf).join(metadata(spark, sf).select("spectrum_id", "molecule_id"), "spectrum_id")
    return rows.select("molecule_id", F.floor(F.col("mz") / 10).cast("int").alias("bit"))


@query()
def butina_clusters(spark, sf):
    return gr.butina_of_sets(_bits(spark, sf), "molecule_id", "bit", 0.4, 20)


@query("WITH g AS (SELECT c_nationkey AS group_id, count(*) AS size, CASE WHEN c_nationkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS purity, round(avg(c_acctbal), 4) AS mass FROM customer GROUP BY 1) SELECT group_id, size, CAST(purity AS DOUBLE) AS purity, mass FROM g WHERE purity = 1 ORDER BY size DESC, abs(mass - (SELECT quantile_cont(mass, 0.5) FROM g)), group_id LIMIT 1")
def choose_example(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("group_id")).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("c_acctbal"), 4).alias("mass"))
    return gr.choose_example(g.withColumn("purity", F.when(F.col("group_id") % 2 == 0, 1.0).otherwise(0.5)), "mass")


# Windows, sorts and sets -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS row_in_key, round(sum(o_totalprice) OVER w, 4) AS running_sum, max(o_totalprice) OVER w AS running_max, first_value(o_orderkey) OVER w AS first_row, lag(o_orderkey) OVER w AS previous, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS rank, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT) AS dense FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_patterns(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("row_in_key"), F.round(F.sum("o_totalprice").over(w), 4).alias("running_sum"), F.max("o_totalprice").over(w).alias("running_max"),
        F.first_value("o_orderkey").over(w).alias("first_row"), F.lag("o_orderkey").over(w).alias("previous"), F.rank().over(p).alias("rank"), F.dense_rank().over(p).alias("dense"),
    )


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS mean_rank FROM lineitem")
def average_ranks(spark, sf):
    return average_rank(table(spark, sf, "lineitem"), "l_quantity", "mean_rank").select("l_orderkey", "l_linenumber", "mean_rank")


@query(f"{S}, s AS (SELECT shard, count(*) AS rows FROM spectra GROUP BY 1) SELECT shard, rows, CAST(coalesce(sum(rows) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s")
def prefix_offsets(spark, sf):
    counts = metadata(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("rows").over(w), F.lit(0)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def global_top_n(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_totalprice")


@query(f"{S}, a AS (SELECT molecule_id FROM spectra WHERE polarity = 0), b AS (SELECT molecule_id FROM spectra WHERE polarity = 1) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def key_set_ops(spark, sf):
    df = metadata(spark, sf)
    a, b = (df.filter(F.col("polarity") == p).select("molecule_id") for p in (0, 1))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, x in parts.items():
        one = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_custkey % 10 AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def to_wide(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("k")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("WITH s AS (SELECT l_returnflag, sum(l_quantity) AS quantity, round(sum(l_tax), 6) AS tax FROM lineitem GROUP BY 1) SELECT l_returnflag, 'quantity' AS metric, quantity AS value FROM s UNION ALL SELECT l_returnflag, 'tax', tax FROM s")
def to_long(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_tax"), 6).alias("tax"))
    return s.unpivot("l_returnflag", ["quantity", "tax"], "metric", "value")


@query("SELECT o_orderpriority AS task, o_orderstatus AS method, count(*) AS n FROM orders GROUP BY ALL")
def flatten_summary(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("o_orderpriority").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n")))).alias("j"))
    return nested.select(F.col("o_orderpriority").alias("task"), F.explode(F.from_json("j", "map<string,bigint>")).alias("method", "n"))
