"""Queries of audits, manifests and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import PEAKS_SQL, SPECTRA_SQL, metadata, spectra, table
from ..operators import audit as au
from ..registry import query

BOTH = f"WITH {PEAKS_SQL}, {SPECTRA_SQL}"
#: Shard rows: every seventh spectrum with a zero peak at its start, every eleventh with its last intensity missing; some precursors and times spoilt.
SHARD = f"""{BOTH}, q AS (SELECT spectrum_id, list(mz ORDER BY pos) AS m, list(intensity ORDER BY pos) AS i FROM peaks GROUP BY 1),
rows AS (SELECT s.spectrum_id, s.shard, s.polarity, CASE WHEN s.spectrum_id % 9 = 0 THEN NULL ELSE s.rt END AS rt, CASE WHEN s.spectrum_id % 13 = 0 THEN NULL WHEN s.spectrum_id % 17 = 0 THEN -1.0 ELSE s.precursor_mz END AS precursor_mz,
 CASE WHEN s.spectrum_id % 7 = 0 THEN list_prepend(0.0, m) ELSE m END AS mz,
 CASE WHEN s.spectrum_id % 7 = 0 THEN list_prepend(0.0, i) WHEN s.spectrum_id % 11 = 0 THEN i[1:len(i) - 1] ELSE i END AS intensity FROM spectra s JOIN q USING (spectrum_id))"""


def shard_rows(spark, sf):
    df, k = spectra(spark, sf), F.col("spectrum_id")
    zero = F.array(F.lit(0.0))
    return df.select(
        "spectrum_id", "shard", "polarity", F.when(k % 9 != 0, F.col("rt")).alias("rt"),
        F.when(k % 13 == 0, None).when(k % 17 == 0, -1.0).otherwise(F.col("precursor_mz")).alias("precursor_mz"),
        F.when(k % 7 == 0, F.concat(zero, "mz")).otherwise(F.col("mz")).alias("mz"),
        F.when(k % 7 == 0, F.concat(zero, "intensity")).when(k % 11 == 0, F.slice("intensity", 1, F.size("intensity") - 1)).otherwise(F.col("intensity")).alias("intensity"),
    )


COUNTERS = """count(*) AS rows, count(*) FILTER (WHERE polarity = 0) AS polarity_0, count(*) FILTER (WHERE polarity = 1) AS polarity_1, count(*) FILTER (WHERE polarity IS NULL) AS polarity_other,
count(*) FILTER (WHERE rt > 0 AND rt <= 1500) AS rt_valid, count(*) FILTER (WHERE rt > 1500) AS rt_above, count(*) FILTER (WHERE rt IS NULL OR rt <= 0) AS rt_missing,
count(*) FILTER (WHERE precursor_mz IS NULL) AS precursor_null, count(*) FILTER (WHERE precursor_mz <= 0) AS precursor_bad, count(*) FILTER (WHERE precursor_mz > 1000) AS precursor_above, count(*) FILTER (WHERE precursor_mz > 0 AND precursor_mz <= 1000) AS precursor_valid"""
LISTS = """count(*) FILTER (WHERE len(mz) = len(intensity)) AS lengths_equal, count(*) FILTER (WHERE len(mz) <> len(intensity)) AS lengths_unequal, CAST(sum(len(mz)) AS BIGINT) AS mz_total,
CAST(sum(len(list_filter(mz, lambda x: x > 500))) AS BIGINT) AS mz_above, CAST(sum(len(list_filter(mz, lambda x: x > 0)) - greatest(len(mz) - len(intensity), 0)) AS BIGINT) AS pairs_valid, CAST(sum(greatest(len(mz) - len(intensity), 0)) AS BIGINT) AS pairs_unpaired,
count(*) FILTER (WHERE spectrum_id % 7 = 0) AS interleaved, CAST(sum(CASE WHEN len(mz) > len(intensity) THEN 1 ELSE 0 END) AS BIGINT) AS padding_mismatch"""
PEAKS = """count(*) FILTER (WHERE n = 0) AS peaks_0, count(*) FILTER (WHERE n = 1) AS peaks_1, count(*) FILTER (WHERE n = 2) AS peaks_2, count(*) FILTER (WHERE n >= 3) AS peaks_3, count(*) FILTER (WHERE n >= 3) AS eligible, count(*) FILTER (WHERE n < 3) AS skipped"""


@query(f"{SHARD} SELECT shard, {COUNTERS} FROM rows GROUP BY 1")
def audit_scalars(spark, sf):
    names = ["rows", "polarity_0", "polarity_1", "polarity_other", "rt_valid", "rt_above", "rt_missing", "precursor_null", "precursor_bad", "precursor_above", "precursor_valid"]
    return au.audit(shard_rows(spark, sf)).select("shard", *names)


@query(f"{SHARD} SELECT shard, {LISTS} FROM rows GROUP BY 1")
def audit_lists(spark, sf):
    names = ["lengths_equal", "lengths_unequal", "mz_total", "mz_above", "pairs_valid", "pairs_unpaired", "interleaved", "padding_mismatch"]
    return au.audit(shard_rows(spark, sf), most_mz=500.0).select("shard", *names)


@query(f"{SHARD} SELECT shard, {PEAKS} FROM (SELECT *, len(list_filter(mz, lambda x: x > 0)) AS n FROM rows) GROUP BY 1")
def audit_peak_counts(spark, sf):
    return au.audit(shard_rows(spark, sf)).select("shard", "peaks_0", "peaks_1", "peaks_2", "peaks_3", "eligible", "skipped")


#: Every thirteenth row has an infinite last intensity, every fifth a negative first one.
SPOILT = f"""{SHARD}, x AS (SELECT shard, CASE WHEN spectrum_id % 13 = 0 THEN list_append(intensity, 'infinity'::DOUBLE) WHEN spectrum_id % 5 = 0 THEN list_prepend(-2.0, intensity) ELSE intensity END AS i FROM rows)"""


@query(f"""{SPOILT} SELECT shard, CAST(sum(len(i)) AS BIGINT) AS intensity_total, CAST(sum(len(list_filter(i, lambda x: isfinite(x)))) AS BIGINT) AS intensity_finite, CAST(sum(len(list_filter(i, lambda x: NOT isfinite(x)))) AS BIGINT) AS intensity_nonfinite,
CAST(sum(len(list_filter(i, lambda x: x < 0))) AS BIGINT) AS intensity_negative, CAST(sum(len(list_filter(i, lambda x: isfinite(x) AND x > 30))) AS BIGINT) AS intensity_above FROM x GROUP BY 1""")
def audit_intensity(spark, sf):
    k = F.col("spectrum_id")
    spoilt = F.when(k % 13 == 0, F.concat("intensity", F.array(F.lit(float("inf"))))).when(k % 5 == 0, F.concat(F.array(F.lit(-2.0)), "intensity")).otherwise(F.col("intensity"))
    audited = au.audit(shard_rows(spark, sf).withColumn("intensity", spoilt), most_intensity=30.0)
    return audited.select("shard", *[f"intensity_{c}" for c in ("total", "finite", "nonfinite", "negative", "above")])


@query(f"""{SHARD}, c AS (SELECT shard, count(*) AS whole, count(*) FILTER (WHERE rt IS NOT NULL) AS parts FROM rows GROUP BY 1)
SELECT shard, closure, whole, parts FROM c, (VALUES ('polarity'), ('rt'), ('precursor'), ('lists'), ('peaks'), ('minimum')) AS t(closure) WHERE whole <> parts""")
def audit_closure(spark, sf):
    """Shards that lost their rows without a time, against the row counts they were declared with: no class adds up."""
    audited = au.audit(shard_rows(spark, sf).filter("rt is not null")).drop("rows")
    declared = metadata(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    return au.check_closure(audited.join(declared, "shard"))


@query(f"{SHARD}, s AS (SELECT shard, {COUNTERS} FROM rows GROUP BY 1) SELECT count(*) AS shards, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(polarity_other) AS BIGINT) AS polarity_other, CAST(sum(rt_above) AS BIGINT) AS rt_above FROM s")
def rollup_audit(spark, sf):
    return au.rollup_audit(au.audit(shard_rows(spark, sf))).select("shards", "rows", "polarity_other", "rt_above")


@query(f"{SHARD} SELECT shard, count(*) AS rows FROM rows GROUP BY 1")
def shard_info(spark, sf):
    return metadata(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 75 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 4)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' ELSE concat_ws(',', CASE WHEN a.v IS DISTINCT FROM b.v THEN 'v' END, CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END) END AS difference FROM a FULL JOIN b ON a.k = b.k) WHERE difference <> ''""")
def diff_manifest(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    k = F.col("k")
    b = df.filter(k % 10 != 4).select("k", F.when(k % 50 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.when(k % 75 != 0, F.col("s")).alias("s"))
    return au.diff_manifest(df.filter(k % 10 != 3), b, "k")


@query("WITH l AS (SELECT o_custkey, o_orderkey FROM orders) SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey)) AS digest FROM l GROUP BY 1")
def digest_lines(spark, sf):
    return au.digest_lines(table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("v")), "o_custkey", "o_orderkey", "v")


@query("""WITH r AS (SELECT c_nationkey AS g, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS h FROM customer), p AS (SELECT g, substr(h, 1, 2) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM r GROUP BY ALL) SELECT g AS c_nationkey, sha256(string_agg(h, chr(10) ORDER BY p)) AS fingerprint FROM p GROUP BY 1""")
def fingerprint_rows(spark, sf):
    return au.fingerprint(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_nationkey"])


@query(f"WITH {SPECTRA_SQL} SELECT fold, count(*) AS n, CAST(17 AS BIGINT) AS expected FROM spectra WHERE fold IN ('val', 'test', 'train') GROUP BY 1 HAVING count(*) <> 17")
def check_release(spark, sf):
    return au.check_release(metadata(spark, sf), "fold", {"train": 17, "val": 17, "test": 17})


@query(f"WITH {SPECTRA_SQL} SELECT shard, count(*) FILTER (WHERE spectrum_id % 97 <> 5) AS child, count(*) AS parent FROM spectra GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE spectrum_id % 97 <> 5)")
def check_lineage(spark, sf):
    parent = metadata(spark, sf)
    child = parent.filter("spectrum_id % 97 <> 5")
    a, b = (x.groupBy("shard").agg(F.count(F.lit(1)).alias("n")) for x in (child, parent))
    return au.check_lineage(a, b, "shard", "n")


OVER = " UNION ALL ".join(f"SELECT DISTINCT adduct AS f, '{k}' AS field, CAST({k} AS VARCHAR) AS v FROM spectra" for k in ("molecule_id", "formula_id"))


@query(f"WITH {SPECTRA_SQL}, s AS ({OVER}) SELECT a.field, a.f AS a, b.f AS b, count(*) AS shared FROM s a JOIN s b ON a.field = b.field AND a.v = b.v AND a.f < b.f GROUP BY ALL")
def fold_overlap(spark, sf):
    return au.fold_overlap(metadata(spark, sf), "adduct", ["molecule_id", "formula_id"])


@query(f"""{BOTH}, n AS (SELECT fold, adduct, count(*) AS n FROM peaks JOIN spectra USING (spectrum_id) GROUP BY fold, adduct, spectrum_id) SELECT fold, CAST(min(n) AS INT) AS min, quantile_cont(n, 0.05) AS p05, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, CAST(max(n) AS INT) AS max, count(*) FILTER (WHERE n >= 5) AS n_5, count(*) FILTER (WHERE n >= 10) AS n_10, count(DISTINCT adduct) AS adducts FROM n GROUP BY 1""")
def profile_folds(spark, sf):
    return au.profile_folds(spectra(spark, sf), "fold")


CAND = "q AS (SELECT c_custkey AS k, c_custkey % 40 AS truth FROM customer), c AS (SELECT o_custkey AS k, o_orderkey % 40 AS cand FROM orders WHERE o_orderkey % 3 <> 0)"


@query(f"WITH {CAND}, l AS (SELECT k, count(*) AS n, count(DISTINCT cand) AS d FROM c GROUP BY 1), b AS (SELECT q.k, n, d, EXISTS (SELECT 1 FROM c WHERE c.k = q.k AND c.cand = q.truth) AS hit FROM q LEFT JOIN l ON l.k = q.k) SELECT count(*) AS queries, count(*) FILTER (WHERE n IS NULL) AS missing_list, count(*) FILTER (WHERE hit) AS truth_in, count(*) FILTER (WHERE n IS NOT NULL AND NOT hit) AS truth_missing, count(*) FILTER (WHERE n > d) AS with_repeats, min(n) AS min, quantile_cont(n, 0.5) AS median, max(n) AS max FROM b")
def audit_candidates(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 40).alias("truth"))
    c = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 40).alias("cand"))
    return au.audit_candidates(q, c, "k", "truth", "cand")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 10 = 4) AS only_left, count(*) FILTER (WHERE o_orderkey % 10 = 3) AS only_right, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS different FROM orders")
def assert_matches(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = df.filter("k % 10 <> 4").withColumn("v", F.when(F.col("k") % 50 == 0, F.col("v") + 1).otherwise(F.col("v") + 1e-9))
    return au.assert_matches(df.filter("k % 10 <> 3"), b, ["k"], "v", 1e-6)


@query(f"{BOTH}, n AS (SELECT spectrum_id, any_value(rt) AS rt, any_value(polarity) AS p, count(*) AS n FROM peaks JOIN spectra USING (spectrum_id) GROUP BY 1) SELECT CASE WHEN n < 3 THEN 'few peaks' WHEN rt > 1500 THEN 'late' WHEN p IS NULL THEN 'no polarity' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY 1")
def skip_counts(spark, sf):
    return au.skip_counts(spectra(spark, sf), {"few peaks": F.size("mz") < 3, "late": F.col("rt") > 1500, "no polarity": F.col("polarity").isNull()})


@query("WITH d AS (SELECT source, quality, toxic FROM documents JOIN labels USING (doc_id)) SELECT source, 'quality' AS label, round(avg(quality), 6) AS prevalence, count(quality) AS n FROM d GROUP BY 1 UNION ALL SELECT source, 'toxic', round(avg(toxic), 6), count(toxic) FROM d GROUP BY 1")
def label_stats(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return au.label_stats(df, "source", ["quality", "toxic"]).withColumn("prevalence", F.round("prevalence", 6))


@query("WITH m AS (SELECT o_orderstatus AS method, o_custkey AS k FROM orders), t AS (SELECT count(DISTINCT method) AS t FROM m) SELECT k, count(DISTINCT method) AS methods, count(*) AS rows FROM m, t GROUP BY k HAVING count(DISTINCT method) <> max(t) OR count(*) <> max(t)")
def check_same_population(spark, sf):
    return au.check_same_population(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("method"), F.col("o_custkey").alias("k")), "method", "k")


@query(f"WITH {SPECTRA_SQL}, x AS (SELECT formula_id FROM spectra GROUP BY 1 HAVING count(DISTINCT adduct) > 4), c AS (SELECT molecule_id FROM spectra GROUP BY 1 HAVING count(DISTINCT polarity % 2) > 1) SELECT spectrum_id FROM spectra WHERE molecule_id NOT IN (SELECT molecule_id FROM c)")
def drop_crossing_keys(spark, sf):
    return au.drop_crossing_keys(metadata(spark, sf), "molecule_id", "polarity").select("spectrum_id")


@query("WITH m AS (SELECT 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'mean', round(avg(o_totalprice), 4) FROM orders), r AS (SELECT * FROM (VALUES ('rows', '>=', 10.0), ('mean', '<=', 5.0)) AS t(name, op, bound)), p AS (SELECT r.name, m.value, CASE WHEN op = '>=' THEN value >= bound ELSE value <= bound END AS passed FROM r LEFT JOIN m USING (name)) SELECT *, bool_and(passed) OVER () AS all_passed FROM p")
def gate_checks(spark, sf):
    row = table(spark, sf, "orders").agg(F.array(F.struct(F.lit("rows").alias("name"), F.count(F.lit(1)).cast("double").alias("value")), F.struct(F.lit("mean").alias("name"), F.round(F.avg("o_totalprice"), 4).alias("value"))).alias("m"))
    return au.gate(row.select(F.explode("m").alias("m")).select("m.*"), [("rows", ">=", 10.0), ("mean", "<=", 5.0)])


@query(f"{BOTH}, p AS (SELECT fold, spectrum_id, mz, intensity FROM peaks JOIN spectra USING (spectrum_id)), e AS (SELECT fold, count(*) AS emptied FROM (SELECT fold, spectrum_id FROM p GROUP BY ALL HAVING min(mz) >= 400) GROUP BY 1) SELECT fold, round(count(*) FILTER (WHERE mz >= 400) / count(*), 6) AS peak_share, round(sum(CASE WHEN mz >= 400 THEN intensity ELSE 0 END) / sum(intensity), 6) AS intensity_share, max(emptied) AS emptied FROM p JOIN e USING (fold) GROUP BY 1")
def range_loss(spark, sf):
    df = au.range_loss(spectra(spark, sf), 400.0, ["fold"])
    return df.withColumn("peak_share", F.round("peak_share", 6)).withColumn("intensity_share", F.round("intensity_share", 6))


@query(f"{SHARD} SELECT spectrum_id, CASE WHEN len(mz) <> len(intensity) THEN 'unequal lengths' WHEN precursor_mz IS NULL OR precursor_mz <= 0 THEN 'bad precursor' END AS reason FROM rows")
def validate_spectra(spark, sf):
    return au.validate_spectra(shard_rows(spark, sf)).select("spectrum_id", "reason")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '5-LOW') AS mismatches, count(*) AS n FROM orders")
def header_mismatch(spark, sf):
    df = table(spark, sf, "orders").withColumn("found", F.when(F.col("o_orderkey") % 2 == 1, "5-LOW").otherwise(F.col("o_orderpriority")))
    return au.header_mismatch(df, "o_orderpriority", "found")
