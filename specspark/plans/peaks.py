"""Queries of the peak-list projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..fixtures import FORMULA_SQL, PEAKS_SQL, SPECTRA_SQL, formulas, peaks, spectra, vectors
from ..functions import chemistry as chem
from ..functions import peaks as pk
from ..functions import vectors as vec
from ..registry import query

BOTH = f"WITH {PEAKS_SQL}, {SPECTRA_SQL}"
#: peaks that pass, ranked by strength, with their spectrum's maximum
RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos DESC) AS rk,
  max(intensity) OVER (PARTITION BY spectrum_id) AS top, count(*) OVER (PARTITION BY spectrum_id) AS n FROM peaks WHERE mz > 0 {where})"""
PLACED = "CAST(row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, pos) - 1 AS INT) AS pos, round(mz, 6) AS mz"


def _long(df):
    return pk.long_peaks(df, "spectrum_id").select("spectrum_id", "pos", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"))


@query(f"WITH {PEAKS_SQL}, {RANKED.format(where='')} SELECT spectrum_id, {PLACED}, round(intensity / top, 6) AS intensity FROM r WHERE n >= 3 AND rk <= 5")
def prepare_peaks(spark, sf):
    return _long(pk.prepare_peaks(spectra(spark, sf), 5))


@query(f"WITH {PEAKS_SQL}, {RANKED.format(where='AND intensity > 0')} SELECT spectrum_id, {PLACED}, round(intensity / max(intensity) OVER (PARTITION BY spectrum_id), 6) AS intensity FROM r WHERE n >= 3 AND rk <= 4")
def top_peaks(spark, sf):
    return _long(pk.top_peaks(spectra(spark, sf), 4))


@query(f"WITH {PEAKS_SQL} SELECT spectrum_id, CAST(pos - 1 AS INT) AS pos, round(mz, 6) AS mz, round(intensity / max(intensity) OVER (PARTITION BY spectrum_id), 6) AS intensity FROM peaks")
def normalize_spectrum(spark, sf):
    return _long(pk.normalize_spectrum(spectra(spark, sf)))


@query(f"""{BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos DESC) AS rk FROM peaks WHERE mz BETWEEN 10 AND 1005),
k AS (SELECT *, max(intensity) OVER (PARTITION BY spectrum_id) AS top, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, pos) AS place FROM r WHERE rk <= 6),
slots AS (SELECT spectrum_id, precursor_mz, i FROM spectra, generate_series(0, 6) AS g(i))
SELECT s.spectrum_id, CAST(s.i AS INT) AS pos, round(CASE WHEN i = 0 THEN precursor_mz ELSE coalesce(k.mz, 0) END, 6) AS mz,
  round(CASE WHEN i = 0 THEN 1.1 ELSE coalesce(k.intensity / k.top, 0) END, 6) AS intensity
FROM slots s LEFT JOIN k ON k.spectrum_id = s.spectrum_id AND k.place = s.i""")
def peak_set(spark, sf):
    return _long(pk.peak_set(spectra(spark, sf), top=6))


@query(f"""{BOTH}, slots AS (SELECT spectrum_id, i FROM spectra, generate_series(0, 7) AS g(i))
SELECT s.spectrum_id, CAST(i AS INT) AS pos, coalesce(round(p.mz, 6), 0) AS mz, coalesce(round(p.intensity, 6), 0) AS intensity, p.mz IS NOT NULL AS mask
FROM slots s LEFT JOIN peaks p ON p.spectrum_id = s.spectrum_id AND p.pos = s.i + 1""")
def pad_peaks(spark, sf):
    df = pk.pad_peaks(spectra(spark, sf), 8)
    rows = df.select("spectrum_id", F.posexplode(F.arrays_zip("mz", "intensity", "mask")).alias("pos", "p"))
    return rows.select("spectrum_id", "pos", F.round("p.mz", 6).alias("mz"), F.round("p.intensity", 6).alias("intensity"), "p.mask")


def _binned(df):
    return df.select("spectrum_id", "bin", F.round("value", 6).alias("value"))


@query(f"WITH {PEAKS_SQL}, b AS (SELECT spectrum_id, CAST(floor(mz) AS INT) AS bin, sum(intensity) AS v FROM peaks WHERE floor(mz) < 1005 GROUP BY ALL) SELECT spectrum_id, bin, round(v / max(v) OVER (PARTITION BY spectrum_id), 6) AS value FROM b")
def bin_sum(spark, sf):
    return _binned(pk.bin_sum(spectra(spark, sf)))


@query(f"WITH {PEAKS_SQL} SELECT spectrum_id, CAST(floor(mz / 50) AS INT) AS bin, round(max(intensity), 6) AS value FROM peaks GROUP BY ALL")
def bin_max(spark, sf):
    return _binned(pk.bin_max(spectra(spark, sf), width=50.0))


@query(f"""WITH {PEAKS_SQL}, b AS (SELECT spectrum_id, CAST(round_even(mz / 2, 0) AS INT) AS bin, sum(sqrt(intensity)) AS v FROM peaks GROUP BY ALL)
SELECT spectrum_id, bin, round(v / sqrt(sum(v * v) OVER (PARTITION BY spectrum_id)), 6) AS value FROM b""")
def bin_l2(spark, sf):
    return _binned(pk.bin_l2(spectra(spark, sf), width=2.0))


@query(f"""{BOTH} SELECT spectrum_id, CAST(count(*) FILTER (WHERE mz <= precursor_mz + 1) AS INT) AS n_kept, CAST(count(*) FILTER (WHERE mz > precursor_mz + 1) AS INT) AS n_above,
  round(coalesce(sum(intensity) FILTER (WHERE mz <= precursor_mz + 1), 0), 6) AS total FROM peaks JOIN spectra USING (spectrum_id) GROUP BY spectrum_id""")
def parent_filter(spark, sf):
    df = pk.parent_filter(spectra(spark, sf))
    return df.select("spectrum_id", F.size("mz").alias("n_kept"), "n_above", F.round(vec.total(F.col("intensity")), 6).alias("total"))


@query(f"""{BOTH}, m AS (SELECT molecule_id, round_even(mz, 1) AS mz, sum(intensity) AS v FROM peaks JOIN spectra USING (spectrum_id) GROUP BY ALL)
SELECT molecule_id, round(mz, 6) AS mz, round(v / max(v) OVER (PARTITION BY molecule_id), 6) AS intensity FROM m WHERE v > 0""")
def merge_spectra(spark, sf):
    df = pk.merge_spectra(spectra(spark, sf), "molecule_id", digits=1)
    return df.select("molecule_id", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"))


@query(f"WITH {PEAKS_SQL}, b AS (SELECT spectrum_id, CAST(floor(ln(mz) / {math.log(1.02)!r}) AS INT) AS bin, mz FROM peaks) SELECT spectrum_id, bin, round(avg(mz), 6) AS mz FROM b GROUP BY ALL")
def merge_mz(spark, sf):
    """Every peak: those of a spectrum in one bin lie within 2 % of each other."""
    df = peaks(spark, sf).withColumn("bin", F.floor(F.ln("mz") / math.log(1.02)).cast("int"))
    groups = df.groupBy("spectrum_id", "bin").agg(F.array_sort(F.collect_list("mz")).alias("mz"))
    return groups.select("spectrum_id", "bin", F.round(pk.merge_mz(F.col("mz"), 20_000.1), 6).alias("mz"))


@query(f"""WITH {PEAKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos DESC) AS rk FROM peaks WHERE intensity > 20)
SELECT spectrum_id, CAST(rk - 1 AS INT) AS pos, round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM r WHERE rk <= 3""")
def strongest_peaks(spark, sf):
    return _long(pk.strongest(spectra(spark, sf), 3, 20.0))


@query(f"""WITH {PEAKS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY sha256('5:' || spectrum_id || ':' || (pos - 1))) AS rk, count(*) OVER (PARTITION BY spectrum_id) AS n FROM peaks)
SELECT spectrum_id, CAST(pos - 1 AS INT) AS pos, rk <= greatest(1, floor(n * 0.3)) AS mask, CASE WHEN rk <= greatest(1, floor(n * 0.3)) THEN 0.0 ELSE intensity END AS intensity FROM d""")
def mask_peaks(spark, sf):
    df = pk.mask_peaks(spectra(spark, sf), 0.3, 5)
    return df.select("spectrum_id", F.posexplode(F.arrays_zip("intensity", "mask")).alias("pos", "p")).select("spectrum_id", "pos", "p.mask", "p.intensity")


@query()
def augment_peaks(spark, sf):
    return pk.augment_peaks(pk.prepare_peaks(spectra(spark, sf), 60), 3).select("spectrum_id", F.size("mz").alias("n"), F.size("intensity").alias("k"))


@query(f"""{BOTH} SELECT spectrum_id, CAST(pos - 1 AS INT) AS pos, round(precursor_mz - mz, 6) AS neutral_loss, round(mz / precursor_mz, 6) AS mz_ratio, round(ln(1 + intensity), 6) AS log_intensity,
  coalesce(CASE WHEN rt < 60 THEN NULL ELSE rt END, (SELECT quantile_cont(CASE WHEN rt < 60 THEN NULL ELSE rt END, 0.5) FROM spectra)) AS rt,
  CASE polarity WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END AS ion_mode FROM peaks JOIN spectra USING (spectrum_id)""")
def peak_features(spark, sf):
    df = pk.peak_features(spectra(spark, sf).withColumn("rt", F.expr("if(rt < 60, null, rt)")))
    return df.withColumns({c: F.round(c, 6) for c in ("neutral_loss", "mz_ratio", "log_intensity")})


@query(f"""{BOTH} SELECT spectrum_id, {', '.join(f"bool_or(abs(mz - (precursor_mz - {v})) <= 2.0) AS nl_{k}" for k, v in pk.NEUTRAL_LOSSES.items())} FROM peaks JOIN spectra USING (spectrum_id) GROUP BY 1""")
def neutral_losses(spark, sf):
    return pk.neutral_losses(spectra(spark, sf), 2.0).select("spectrum_id", *[f"nl_{k}" for k in pk.NEUTRAL_LOSSES])


ELEMENTS = ("C", "H", "N", "O", "Cl", "S", "Si")
COUNT_SQL = ", ".join(
    f"CASE WHEN regexp_matches(formula, '{e}([^a-z]|$)') THEN coalesce(TRY_CAST(nullif(regexp_extract(formula, '{e}([0-9]+)', 1), '') AS INT), 1) ELSE 0 END AS n_{e}" for e in ELEMENTS
)
COUNTED = f"WITH {FORMULA_SQL}, c AS (SELECT p_partkey, formula, {COUNT_SQL} FROM formulas)"


def _counted(spark, sf):
    return chem.with_counts(formulas(spark, sf), "counts", "formula")


@query(f"{COUNTED} SELECT p_partkey, {', '.join(f'n_{e}' for e in ELEMENTS)} FROM c")
def formula_counts(spark, sf):
    return _counted(spark, sf).select("p_partkey", *[chem.element(F.col("counts"), e).alias(f"n_{e}") for e in ELEMENTS])


MASS_SQL = " + ".join(f"n_{e} * {chem.MASSES[e]!r}" for e in ELEMENTS)


@query(f"{COUNTED} SELECT p_partkey, round({MASS_SQL}, 6) AS mass, n_C - 1 AS rest_C, n_H - 4 AS rest_H FROM c")
def formula_mass(spark, sf):
    df = _counted(spark, sf).withColumn("rest", chem.formula_diff(F.col("counts"), chem.counts_of("CH4")))
    return df.select("p_partkey", F.round(chem.formula_mass(F.col("counts")), 6).alias("mass"), chem.element(F.col("rest"), "C").alias("rest_C"), chem.element(F.col("rest"), "H").alias("rest_H"))


TEXT_SQL = " || ".join(f"CASE WHEN n_{e} = 0 THEN '' WHEN n_{e} = 1 THEN '{e}' ELSE '{e}' || n_{e} END" for e in ("C", "H", "Cl", "N", "O", "S", "Si"))


@query(f"{COUNTED} SELECT p_partkey, {TEXT_SQL} AS formula FROM c")
def formula_text(spark, sf):
    return _counted(spark, sf).select("p_partkey", chem.formula_text(F.col("counts")).alias("formula"))


@query(f"{COUNTED} SELECT p_partkey, CASE WHEN n_Cl > 0 THEN 'halogen' WHEN n_S > 0 THEN 'sulfur_phosphorus' WHEN n_N > 0 THEN 'nitrogen' WHEN 2 * n_O > n_C THEN 'oxygen_rich' WHEN n_C > 0 AND n_O = 0 THEN 'hydrocarbon' ELSE 'other' END AS family, n_Si = 0 AS valid FROM c")
def family_label(spark, sf):
    return _counted(spark, sf).select("p_partkey", chem.family_label(F.col("counts")).alias("family"), chem.has_valid_elements(F.col("counts"), ["C", "H", "N", "O", "S", "Cl"]).alias("valid"))


@query(f"""WITH {SPECTRA_SQL}, a AS (SELECT *, CASE polarity WHEN 1 THEN '[M+H]+' WHEN 0 THEN '[M-H]-' END AS ion FROM spectra)
SELECT spectrum_id, ion, CASE WHEN ion LIKE '%+' THEN 1 WHEN ion LIKE '%-' THEN 0 END AS back, round(precursor_mz - CASE ion WHEN '[M+H]+' THEN 1.007276 WHEN '[M-H]-' THEN -1.007276 END, 6) AS mass FROM a""")
def adduct_polarity_mass(spark, sf):
    df = spectra(spark, sf).withColumn("ion", chem.adduct_of(F.col("polarity")))
    return df.select("spectrum_id", "ion", chem.polarity_of(F.col("ion")).alias("back"), F.round(chem.neutral_mass(F.col("precursor_mz"), F.col("ion")), 6).alias("mass"))


@query(f"WITH {SPECTRA_SQL} SELECT spectrum_id, collision_energy AS parsed, round(collision_energy * precursor_mz / 500, 6) AS ev, round(collision_energy * 500 / precursor_mz, 6) AS nce FROM spectra")
def collision_energy(spark, sf):
    text = F.concat(F.lit("HCD "), F.col("collision_energy").cast("int"), F.lit(" eV"))
    df = spectra(spark, sf).withColumn("parsed", chem.parse_collision(text))
    return df.select("spectrum_id", "parsed", F.round(chem.nce_to_ev(F.col("parsed"), F.col("precursor_mz")), 6).alias("ev"), F.round(chem.ev_to_nce(F.col("parsed"), F.col("precursor_mz")), 6).alias("nce"))


MASS_BINS = [(0.0, 200.0, "<200"), (200.0, 400.0, "200-400"), (450.0, 2000.0, "450+")]


@query(f"WITH {SPECTRA_SQL} SELECT CASE WHEN precursor_mz < 200 THEN '<200' WHEN precursor_mz < 400 THEN '200-400' WHEN precursor_mz >= 450 AND precursor_mz < 2000 THEN '450+' END AS label, count(*) AS n FROM spectra GROUP BY 1")
def bucket_label(spark, sf):
    return spectra(spark, sf).groupBy(chem.bucket_label(F.col("precursor_mz"), MASS_BINS).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PEAKS_SQL} SELECT spectrum_id, sha256(string_agg(CAST(CAST(round_even(mz * 10000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) || '|' || string_agg(CAST(CAST(round_even(intensity * 10000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY pos)) AS signature FROM peaks GROUP BY 1""")
def signature(spark, sf):
    return spectra(spark, sf).select("spectrum_id", pk.signature(F.col("mz"), F.col("intensity")).alias("signature"))


@query(f"WITH {SPECTRA_SQL} SELECT spectrum_id, CAST('0x' || substr(sha256('9:' || spectrum_id), 1, 8) AS BIGINT) AS key FROM spectra")
def stable_key(spark, sf):
    return spectra(spark, sf).select("spectrum_id", pk.stable_key(9, F.col("spectrum_id").cast("string")).alias("key"))


@query(f"WITH {PEAKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz) AS k FROM peaks) SELECT spectrum_id, string_agg(CAST(CAST(round_even(mz * 100000, 0) AS BIGINT) AS VARCHAR), '_' ORDER BY k) AS key FROM r WHERE k <= 3 GROUP BY 1")
def peak_key(spark, sf):
    return spectra(spark, sf).select("spectrum_id", pk.peak_key(F.col("mz")).alias("key"))


@query(f"WITH {SPECTRA_SQL} SELECT spectrum_id, round(CASE WHEN rt > 1500 THEN 0 ELSE rt / 600 END, 6) AS rt FROM spectra")
def normalize_rt(spark, sf):
    rt = F.when(F.col("rt") > 1500, F.lit(float("nan"))).otherwise(F.col("rt"))
    return spectra(spark, sf).select("spectrum_id", F.round(pk.normalize_rt(rt), 6).alias("rt"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL)
SELECT label, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def vector_centroid(spark, sf):
    return vec.centroid(vectors(spark, sf), "label", "vector").select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {PEAKS_SQL} SELECT spectrum_id, round(avg(mz), 6) AS mean, round(max(mz), 6) AS max, round(stddev_pop(mz), 6) AS std, round(sum(mz * intensity) / sum(intensity), 6) AS weighted FROM peaks GROUP BY 1""")
def pool_tokens(spark, sf):
    df = vec.pool_tokens(peaks(spark, sf), "spectrum_id", "mz", "intensity")
    return df.select("spectrum_id", *[F.round(c, 6).alias(c) for c in ("mean", "max", "std", "weighted")])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 6) AS cosine, round(a[1] / sqrt(list_dot_product(a, a)) / sqrt(2), 6) AS first FROM p""")
def cosine_and_fusion(spark, sf):
    v = vectors(spark, sf)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("b"))
    df = v.join(nxt, "vec_id")
    return df.select("vec_id", F.round(vec.cosine(F.col("vector"), F.col("b")), 6).alias("cosine"), F.round(F.get(vec.fuse_vectors(F.col("vector"), F.col("b")), F.lit(0)), 6).alias("first"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def block_type(spark, sf):
    header = F.concat(F.lit(">"), F.initcap("event_type"), F.lit(" 20 eV"))
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(chem.block_type(header).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
