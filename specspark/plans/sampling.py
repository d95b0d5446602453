"""Queries of the samplers and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import PEAKS_SQL, SPECTRA_SQL, metadata, spectra, table
from ..operators import sampling as sm
from ..registry import query

S = f"WITH {SPECTRA_SQL}"
BOTH = f"WITH {PEAKS_SQL}, {SPECTRA_SQL}"


def h(seed, *parts):
    return "sha256('" + str(seed) + ":' || " + " || ':' || ".join(parts) + ")"


@query(f"""{BOTH}, k AS (SELECT spectrum_id, count(*) AS n FROM peaks JOIN spectra USING (spectrum_id) WHERE mz <= precursor_mz + 1 GROUP BY 1),
a AS (SELECT spectrum_id, count(*) AS n FROM peaks GROUP BY 1)
SELECT 'clean' AS scenario, count(*) AS n FROM k WHERE n >= 3 UNION ALL SELECT 'urgent', count(*) FROM spectra WHERE adduct IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'positive', count(*) FROM spectra JOIN a USING (spectrum_id) WHERE polarity = 1 AND n >= 2""")
def scenario_counts(spark, sf):
    df, out = spectra(spark, sf), None
    for name in ("clean", "urgent", "positive"):
        one = sm.apply_scenario(df, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("scenario"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{S} SELECT spectrum_id, CASE WHEN adduct IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS mode FROM spectra WHERE adduct IN ('1-URGENT', '2-HIGH', '5-LOW')")
def assign_mode(spark, sf):
    return sm.assign_mode(metadata(spark, sf), {"fast": ["1-URGENT", "2-HIGH"], "slow": ["5-LOW"]}).select("spectrum_id", "mode")


@query(f"{S} SELECT spectrum_id, molecule_id FROM spectra WHERE molecule_id IN (SELECT molecule_id FROM spectra GROUP BY 1 HAVING count(*) >= 8)")
def min_group(spark, sf):
    return sm.min_group(metadata(spark, sf), "molecule_id", 8).select("spectrum_id", "molecule_id")


SPLIT = f"k AS (SELECT molecule_id, row_number() OVER (ORDER BY {h(3, 'molecule_id')}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT molecule_id FROM spectra))"


@query(f"{S}, {SPLIT} SELECT molecule_id, CASE WHEN r <= floor(n * 0.15) THEN 'test' WHEN r <= floor(n * 0.15) * 2 THEN 'val' ELSE 'train' END AS split FROM k")
def split_keys(spark, sf):
    return sm.split_keys(metadata(spark, sf), "molecule_id", 3)


@query(f"{S}, {SPLIT} SELECT spectrum_id, CASE WHEN r <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM k JOIN spectra USING (molecule_id)")
def group_split(spark, sf):
    return sm.group_split(metadata(spark, sf), "molecule_id", 3).select("spectrum_id", "split")


def first(seed, n=1, where="true", key="molecule_id"):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {h(seed, key, 'spectrum_id')}) AS r FROM spectra WHERE {where}) WHERE r <= {n}"


@query(f"{S}, q AS ({first(5)}) SELECT spectrum_id, CASE WHEN spectrum_id IN (SELECT spectrum_id FROM q) THEN 'query' ELSE 'library' END AS role FROM spectra")
def queries_and_library(spark, sf):
    df = metadata(spark, sf)
    q = sm.choose_queries(df, "molecule_id", "spectrum_id", 5)
    lib = sm.build_library(df, q, "spectrum_id")
    return q.select("spectrum_id", F.lit("query").alias("role")).unionByName(lib.select("spectrum_id", F.lit("library").alias("role")))


@query(f"""{S}, t AS (SELECT * FROM spectra WHERE adduct = '5-LOW' AND fold = 'test'), k AS (SELECT molecule_id FROM t GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY {h(6, 'molecule_id', 'spectrum_id')}) AS r FROM t WHERE molecule_id IN (SELECT molecule_id FROM k))
SELECT spectrum_id, molecule_id, CASE WHEN r = 1 THEN 'query' ELSE 'library' END AS role FROM r""")
def strict_task(spark, sf):
    df = metadata(spark, sf)
    return sm.strict_task(df, "5-LOW", df.filter("fold = 'test'"), "molecule_id", "spectrum_id", 6)


@query(f"{S}, l AS ({first(7, where='collision_energy <= 20')}), g AS ({first(7, where='collision_energy >= 40')}) SELECT molecule_id, l.spectrum_id AS low, g.spectrum_id AS high FROM l JOIN g USING (molecule_id)")
def energy_pairs(spark, sf):
    return sm.energy_pairs(metadata(spark, sf), "molecule_id", "spectrum_id", 7)


@query(f"""{S}, r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY molecule_id ORDER BY spectrum_id) % 2 = 1 THEN 'query' ELSE 'reference' END AS role FROM spectra),
b AS (SELECT formula_id, molecule_id FROM r GROUP BY ALL HAVING count(DISTINCT role) = 2), e AS (SELECT formula_id FROM b GROUP BY 1 HAVING count(*) >= 2)
SELECT spectrum_id, role FROM r WHERE molecule_id IN (SELECT molecule_id FROM b WHERE formula_id IN (SELECT formula_id FROM e))""")
def alternate_roles(spark, sf):
    return sm.alternate_roles(metadata(spark, sf), "molecule_id", "formula_id", "spectrum_id").select("spectrum_id", "role")


@query(f"""{S}, r AS (SELECT *, row_number() OVER (ORDER BY {h(8, 'spectrum_id')}) AS r FROM spectra WHERE fold = 'train')
SELECT spectrum_id, fold FROM r WHERE r <= (SELECT count(*) FROM spectra WHERE fold = 'val') UNION ALL SELECT spectrum_id, fold FROM spectra WHERE fold = 'val'""")
def balance_exact(spark, sf):
    return sm.balance_exact(metadata(spark, sf), "fold", "val", "train", "spectrum_id", 8).select("spectrum_id", "fold")


@query(f"""{S}, r AS (SELECT *, {h(9, 'spectrum_id')} AS h, row_number() OVER (PARTITION BY fold ORDER BY {h(9, 'spectrum_id')}) AS r FROM spectra),
m AS (SELECT *, row_number() OVER (ORDER BY h) AS k FROM r WHERE r > 50) SELECT spectrum_id, fold FROM r WHERE r <= 50 UNION ALL SELECT spectrum_id, fold FROM m WHERE k <= 50""")
def balanced_sample(spark, sf):
    return sm.balanced_sample(metadata(spark, sf), "fold", "spectrum_id", 50, 9, 200).select("spectrum_id", "fold")


@query(f"{S} SELECT molecule_id FROM (SELECT DISTINCT molecule_id FROM spectra) ORDER BY {h(4, repr('test'), 'molecule_id')} LIMIT 40")
def hash_select(spark, sf):
    return sm.hash_select(metadata(spark, sf), "molecule_id", 40, 4, "test")


@query(f"""{S}, c AS ({first(2, 3)}), k AS (SELECT *, row_number() OVER (PARTITION BY adduct ORDER BY {h(2, 'spectrum_id')}) AS s FROM c)
SELECT spectrum_id, adduct FROM k ORDER BY s, adduct LIMIT 120""")
def round_robin_pick(spark, sf):
    return sm.round_robin_pick(metadata(spark, sf), "molecule_id", "adduct", "spectrum_id", 3, 120, 2).select("spectrum_id", "adduct")


@query(f"""{S}, m AS (SELECT *, CAST(g.i AS INT) AS repeat FROM spectra, generate_series(0, 3) AS g(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY {h(1, 'repeat', 'spectrum_id')}) AS r FROM m) SELECT repeat, fold, spectrum_id FROM r WHERE r <= 20""")
def repeat_draws(spark, sf):
    return sm.repeat_draws(metadata(spark, sf).select("fold", "spectrum_id"), "fold", "spectrum_id", 20, 4, 1).select("repeat", "fold", "spectrum_id")


@query(f"{S} SELECT adduct, spectrum_id FROM (SELECT *, row_number() OVER (PARTITION BY adduct ORDER BY spectrum_id) AS r FROM spectra) WHERE r <= 25")
def cap_per_label(spark, sf):
    return sm.cap_per_label(metadata(spark, sf), "adduct", "spectrum_id", 25).select("adduct", "spectrum_id")


@query(f"""{BOTH}, n AS (SELECT spectrum_id, CAST(count(*) AS INT) AS n_peaks FROM peaks GROUP BY 1)
SELECT molecule_id, spectrum_id, n_peaks FROM (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY n_peaks DESC, spectrum_id) AS r FROM spectra JOIN n USING (spectrum_id)) WHERE r = 1""")
def representative(spark, sf):
    return sm.representative(spectra(spark, sf), "molecule_id", F.size("mz"), "spectrum_id").select("molecule_id", "spectrum_id", F.size("mz").alias("n_peaks"))


@query(f"{S} SELECT spectrum_id FROM spectra WHERE molecule_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def exclude_keys(spark, sf):
    listed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("molecule_id"))
    return sm.exclude_keys(metadata(spark, sf), listed, "molecule_id").select("spectrum_id")


@query(f"""{BOTH}, c AS (SELECT spectrum_id, string_agg(CAST(CAST(intensity AS INT) % 4 AS VARCHAR), ',' ORDER BY pos) AS c FROM peaks WHERE pos <= 2 GROUP BY 1)
SELECT molecule_id, min(spectrum_id) AS spectrum_id, count(*) AS n_equal FROM spectra JOIN c USING (spectrum_id) GROUP BY molecule_id, c""")
def dedup_spectra(spark, sf):
    content = F.array_join(F.transform(F.slice("intensity", 1, 2), lambda x: (x.cast("int") % 4).cast("string")), ",")
    return sm.dedup_spectra(spectra(spark, sf), "molecule_id", content, "spectrum_id").select("molecule_id", "spectrum_id", "n_equal")


@query(f"{S}, p AS ({first('11:2', 2)}), g AS (SELECT molecule_id, max(CASE WHEN r = 1 THEN spectrum_id END) AS first, max(CASE WHEN r = 2 THEN spectrum_id END) AS second FROM p GROUP BY 1) SELECT * FROM g WHERE second IS NOT NULL")
def sample_pairs(spark, sf):
    return sm.sample_pairs(metadata(spark, sf), "molecule_id", "spectrum_id", 2, 11)


@query(f"{S}, a AS ({first('12:0', where='polarity = 0')}), b AS ({first('12:1', where='polarity = 1')}) SELECT molecule_id, a.spectrum_id AS a, b.spectrum_id AS b FROM a JOIN b USING (molecule_id)")
def cross_pairs(spark, sf):
    return sm.cross_pairs(metadata(spark, sf), "molecule_id", "polarity", "spectrum_id", 12, (0, 1))


@query(f"{S}, e AS ({first('13:4')}) SELECT molecule_id, spectrum_id FROM e")
def epoch_sample(spark, sf):
    return sm.epoch_sample(metadata(spark, sf), "molecule_id", "spectrum_id", 4, 13).select("molecule_id", "spectrum_id")


@query(f"{S} SELECT 'block' AS part, spectrum_id FROM spectra WHERE spectrum_id >= 100 AND spectrum_id < 300 UNION ALL SELECT fold, spectrum_id FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY spectrum_id) AS r FROM spectra) WHERE r <= 10")
def row_block_and_heads(spark, sf):
    df = metadata(spark, sf)
    block = sm.row_block(df, "spectrum_id", 100, 300).select(F.lit("block").alias("part"), "spectrum_id")
    return block.unionByName(sm.head_per_fold(df, "fold", "spectrum_id", 10).select(F.col("fold").alias("part"), "spectrum_id"))


@query(f"""{S}, s AS (SELECT shard, count(*) AS rows FROM spectra GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY {h('21:3', 'shard')}) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT shard, rows, CAST(i % 3 AS INT) AS rank, CAST(floor(i / 3) % 2 AS INT) AS worker, CAST(floor(rows / 8) AS BIGINT) AS batches FROM o WHERE i < n - n % 3""")
def shard_layout(spark, sf):
    shards = metadata(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    return sm.shard_layout(shards, 3, 2, 8, 3, 21)


@query(f"""{S} SELECT count(*) FILTER (WHERE precursor_mz <= 300) AS n_light, count(*) FILTER (WHERE molecule_id % 4 <> 0) AS n_valid FROM spectra""")
def precursor_and_targets(spark, sf):
    df = metadata(spark, sf)
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("molecule_id"), F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("bits"))
    valid = sm.valid_targets(df, targets, "molecule_id", "bits").agg(F.count(F.lit(1)).alias("n_valid"))
    return sm.max_precursor(df, 300.0).agg(F.count(F.lit(1)).alias("n_light")).crossJoin(valid)


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o, o_orderpriority) AS priorities FROM f GROUP BY 1""")
def dedup_list(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(rows, lambda r: r["o_orderpriority"]).alias("l"))
    return lists.select("o_custkey", F.array_join(sm.dedup_list(F.col("l")), "|").alias("priorities"))
