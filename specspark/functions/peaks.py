"""Projections on peak lists: arrays mz and intensity in, the same or a few numbers out.

Everything stays in the row: no peak list is exploded unless the result is long. Ties go by intensity descending,
then later position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zipped(mz: Column, intensity: Column) -> Column:
    """array<struct<mz, intensity, pos>>, pos from 0."""
    return F.transform(F.arrays_zip(mz.alias("mz"), intensity.alias("intensity")), lambda p, i: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), i.alias("pos")))


def _keep_top(peaks: Column, k: int) -> Column:
    ranked = F.sort_array(F.transform(peaks, lambda p: F.struct(p["intensity"].alias("intensity"), p["pos"].alias("pos"), p["mz"].alias("mz"))), asc=False)
    return F.sort_array(F.transform(F.slice(ranked, 1, k), lambda p: F.struct(p["mz"].alias("mz"), p["pos"].alias("pos"), p["intensity"].alias("intensity"))))


def _scaled(peaks: Column, top: Column) -> Column:
    scale = F.when(top > 0, top).otherwise(F.lit(1.0))
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), p["pos"].alias("pos"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["intensity"] / scale)).alias("intensity")))


def _arrays(df: DataFrame, peaks: str) -> DataFrame:
    return df.withColumn("mz", F.col(f"{peaks}.mz")).withColumn("intensity", F.col(f"{peaks}.intensity")).drop(peaks)


def prepare_peaks(df: DataFrame, k: int, least: int = 3, on_zero_max: str = "keep") -> DataFrame:
    """Peaks with m/z > 0, scaled by the largest intensity and clipped to [0, 1], the ``k`` strongest by m/z.

    Rows with fewer than ``least`` such peaks go; so do rows without a positive intensity for ``on_zero_max="reject"``."""
    df = df.withColumn("__p", F.filter(zipped(F.col("mz"), F.col("intensity")), lambda p: p["mz"] > 0)).filter(F.size("__p") >= least)
    df = df.withColumn("__t", F.array_max(F.col("__p.intensity")))
    if on_zero_max == "reject":
        df = df.filter("__t > 0")
    df = df.withColumn("__p", _scaled(F.col("__p"), F.col("__t"))).withColumn("__p", _keep_top(F.col("__p"), k))
    return _arrays(df.drop("__t"), "__p")


def _positive(p: Column) -> Column:
    fine = ~F.isnan(p["mz"]) & ~F.isnan(p["intensity"]) & (F.abs(p["mz"]) < float("inf")) & (F.abs(p["intensity"]) < float("inf"))
    return fine & (p["mz"] > 0) & (p["intensity"] > 0)


def top_peaks(df: DataFrame, n: int, least: int = 3) -> DataFrame:
    """The ``n`` strongest finite positive peaks by m/z, scaled by their maximum; rows with fewer than ``least`` go."""
    df = df.withColumn("__p", F.filter(zipped(F.col("mz"), F.col("intensity")), _positive)).filter(F.size("__p") >= least)
    df = df.withColumn("__p", _keep_top(F.col("__p"), n))
    return _arrays(df.withColumn("__p", _scaled(F.col("__p"), F.array_max(F.col("__p.intensity")))), "__p")


def normalize_spectrum(df: DataFrame) -> DataFrame:
    """Finite positive peaks in their order, scaled by the largest intensity; rows without any have empty arrays."""
    df = df.withColumn("__p", F.filter(zipped(F.col("mz"), F.col("intensity")), _positive))
    return _arrays(df.withColumn("__p", _scaled(F.col("__p"), F.array_max(F.col("__p.intensity")))), "__p")


def peak_set(df: DataFrame, low: float = 10.0, high: float = 1005.0, top: int = 60, precursor_weight: float = 1.1) -> DataFrame:
    """Peaks in [low, high], the ``top`` strongest by m/z over their maximum, after (precursor_mz, 1.1), zero-padded to top + 1."""
    inside = F.filter(zipped(F.col("mz"), F.col("intensity")), lambda p: (p["mz"] >= low) & (p["mz"] <= high))
    df = df.withColumn("__p", _keep_top(inside, top))
    df = df.withColumn("__p", _scaled(F.col("__p"), F.array_max(F.col("__p.intensity"))))
    pad = F.array_repeat(F.lit(0.0), F.lit(top) - F.size("__p"))
    mz = F.concat(F.array(F.col("precursor_mz")), F.col("__p.mz"), pad)
    intensity = F.concat(F.array(F.lit(precursor_weight)), F.col("__p.intensity"), pad)
    return df.withColumn("mz", mz).withColumn("intensity", intensity).drop("__p")


def pad_peaks(df: DataFrame, length: int) -> DataFrame:
    """Arrays padded with zeros (or cut) to ``length``, and ``mask``: whether each place holds a peak."""
    n = F.least(F.size("mz"), F.lit(length))
    zeros = F.array_repeat(F.lit(0.0), F.lit(length) - n)
    df = df.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < n))
    return df.withColumns({c: F.concat(F.slice(c, 1, length), zeros) for c in ("mz", "intensity")})


def parent_filter(df: DataFrame, margin: float = 1.0) -> DataFrame:
    """Peaks up to precursor_mz + margin, and n_above: how many went."""
    kept = F.filter(zipped(F.col("mz"), F.col("intensity")), lambda p: p["mz"] <= F.col("precursor_mz") + margin)
    df = df.withColumn("__p", kept).withColumn("n_above", F.size("mz") - F.size("__p"))
    return _arrays(df, "__p")


def strongest(df: DataFrame, n: int, above: float) -> DataFrame:
    """The ``n`` strongest of the peaks over ``above``, strongest first."""
    kept = F.filter(zipped(F.col("mz"), F.col("intensity")), lambda p: p["intensity"] > above)
    ranked = F.sort_array(F.transform(kept, lambda p: F.struct(p["intensity"].alias("intensity"), p["pos"].alias("pos"), p["mz"].alias("mz"))), asc=False)
    return _arrays(df.withColumn("__p", F.slice(ranked, 1, n)), "__p")


def long_peaks(df: DataFrame, *keep: str) -> DataFrame:
    """One row a peak: ``keep``, pos from 0, mz, intensity."""
    return df.select(*keep, F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select(*keep, "pos", "p.mz", "p.intensity")


def _bins(df: DataFrame, key: str, bin_of: Column, value: Column, how: str) -> DataFrame:
    agg = {"sum": F.sum, "max": F.max}[how]
    # dealt by key while peaks are still in their rows: bins and totals of a key then need no further exchange
    return long_peaks(df.select(key, "mz", "intensity").repartition(F.col(key)), key).filter("mz > 0 and intensity > 0").select(key, bin_of.alias("bin"), value.alias("value")).groupBy(key, "bin").agg(agg("value").alias("value"))


def _over_group(df: DataFrame, key: str, total: Column) -> DataFrame:
    totals = df.groupBy(key).agg(total.alias("__t"))
    return df.join(totals, key).withColumn("value", F.when(F.col("__t") > 0, F.col("value") / F.col("__t")).otherwise(0.0)).drop("__t")


def _over_bins(rows: DataFrame, key: str, fold, of: Column, size=lambda t: t) -> DataFrame:
    """Like ``_over_group`` for the few bins of a spectrum, which lie together: over ``size`` of the fold of ``of``."""
    rows = rows.withColumn("__t", size(fold(of).over(Window.partitionBy(key))))
    return rows.withColumn("value", F.when(F.col("__t") > 0, F.col("value") / F.col("__t")).otherwise(0.0)).drop("__t")


def bin_sum(df: DataFrame, key: str = "spectrum_id", width: float = 1.0, top: float = 1005.0) -> DataFrame:
    """Sparse (key, bin, value): sums in floor(mz / width) below ``top``, over the spectrum's largest bin."""
    rows = _bins(df, key, F.floor(F.col("mz") / width).cast("int"), F.col("intensity"), "sum")
    return _over_bins(rows.filter(F.col("bin") < int(top / width)), key, F.max, F.col("value"))


def bin_max(df: DataFrame, key: str = "spectrum_id", width: float = 1.0, how: str = "max") -> DataFrame:
    """Sparse (key, bin, value): the largest (or summed) intensity in floor(mz / width)."""
    return _bins(df, key, F.floor(F.col("mz") / width).cast("int"), F.col("intensity"), how)


def bin_l2(df: DataFrame, key: str = "spectrum_id", width: float = 1.0) -> DataFrame:
    """Sparse (key, bin, value): sums of square roots in mz / width rounded half to even, of unit length."""
    rows = _bins(df, key, F.bround(F.col("mz") / width, 0).cast("int"), F.sqrt("intensity"), "sum")
    return _over_bins(rows, key, F.sum, F.col("value") * F.col("value"), F.sqrt)


def merge_spectra(df: DataFrame, parent: str, how: str = "sum", digits: int = 4) -> DataFrame:
    """(parent, mz, intensity): peaks of a parent's spectra with equal m/z to ``digits`` merged, zeros dropped, over the parent's maximum."""
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = long_peaks(df, parent).withColumn("mz", F.bround("mz", digits)).groupBy(parent, "mz").agg(agg("intensity").alias("value"))
    return _over_group(rows.filter("value > 0"), parent, F.max("value")).withColumnRenamed("value", "intensity")


def merge_mz(values: Column, ppm: float) -> Column:
    """The mean of an array of m/z that lie within ``ppm`` of each other; an error if they are wider."""
    wide = (F.array_max(values) - F.array_min(values)) > F.array_min(values) * ppm / 1e6
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.when(~wide, mean).otherwise(F.raise_error(F.lit("m/z values are too far apart")).cast("double"))


def mask_peaks(df: DataFrame, ratio: float, seed: int, key: str = "spectrum_id") -> DataFrame:
    """max(1, floor(n ratio)) peaks with intensity 0 and mask true: those first by the hash of seed, key and place."""
    draw = F.transform(F.col("mz"), lambda m, i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key), i), 256).alias("h"), i.alias("i")))
    n = F.greatest(F.lit(1), F.floor(F.size("mz") * ratio)).cast("int")
    df = df.withColumn("__m", F.transform(F.slice(F.sort_array(draw), 1, n), lambda x: x["i"]))
    chosen = F.col("__m")
    df = df.withColumn("mask", F.transform("mz", lambda m, i: F.array_contains(chosen, i) & chosen.isNotNull()))
    return df.withColumn("intensity", F.zip_with("intensity", "mask", lambda x, m: F.when(m, 0.0).otherwise(x))).drop("__m")


def augment_peaks(df: DataFrame, seed: int, share: float = 0.1, noise: float = 0.03) -> DataFrame:
    """Without max(1, share) of the peaks, normal noise on intensities, clipped; unchanged where fewer than three would be left."""
    masked = mask_peaks(df.withColumn("__i", F.col("intensity")), share, seed)
    kept = F.filter(F.arrays_zip("mz", "intensity", "mask"), lambda p: ~p["mask"])
    masked = masked.withColumn("__k", kept).withColumn("__e", F.array(*[F.randn(seed + j) for j in range(8)]))
    noisy = F.transform("__k", lambda p, i: F.struct(p["mz"].alias("mz"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["intensity"] + noise * F.get(F.col("__e"), (i % 8).cast("int")))).alias("intensity")))
    masked = masked.withColumn("__n", noisy)
    fine = F.size("__k") >= 3
    masked = masked.withColumn("mz", F.when(fine, F.col("__n.mz")).otherwise(F.col("mz")))
    return masked.withColumn("intensity", F.when(fine, F.col("__n.intensity")).otherwise(F.col("__i"))).drop("mask", "__i", "__k", "__e", "__n")


def peak_features(df: DataFrame) -> DataFrame:
    """One row a peak: neutral loss, m/z ratio, log1p intensity, rt with the table's median for nulls, ion mode from polarity."""
    median = df.agg(F.percentile("rt", 0.5).alias("__median"))  # one row
    rows = df.crossJoin(F.broadcast(median)).withColumn("rt", F.coalesce("rt", "__median"))
    rows = long_peaks(rows, "spectrum_id", "precursor_mz", "rt", "polarity")
    return rows.select(
        "spectrum_id", "pos", (F.col("precursor_mz") - F.col("mz")).alias("neutral_loss"), (F.col("mz") / F.col("precursor_mz")).alias("mz_ratio"),
        F.log1p("intensity").alias("log_intensity"), "rt", F.when(F.col("polarity") == 1, "positive").when(F.col("polarity") == 0, "negative").otherwise("unknown").alias("ion_mode"),
    )


#: Neutral losses in Da.
NEUTRAL_LOSSES = {"H2O": 18.0106, "NH3": 17.0265, "CO": 27.9949, "CO2": 43.9898, "HCOOH": 46.0055, "CH3OH": 32.0262, "HCl": 35.9767}


def neutral_losses(df: DataFrame, tolerance: float = 0.02, losses: dict[str, float] = NEUTRAL_LOSSES) -> DataFrame:
    """A flag nl_<name> for each loss: some peak lies within the tolerance of precursor_mz minus it."""
    return df.withColumns({f"nl_{n}": F.exists("mz", _near(loss, tolerance)) for n, loss in losses.items()})


def _near(loss: float, tolerance: float):
    return lambda m: F.abs(m - (F.col("precursor_mz") - loss)) <= tolerance


def signature(mz: Column, intensity: Column, digits: int = 4) -> Column:
    """SHA-256 of the m/z texts, a bar and the intensity texts, in ten-thousandths for ``digits`` = 4."""
    def text(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.bround(x * 10**digits, 0).cast("bigint").cast("string")), ",")

    return F.sha2(F.concat(text(mz), F.lit("|"), text(intensity)), 256)


def stable_key(seed: int, text: Column) -> Column:
    """The first 8 hexadecimal digits of sha256(seed:text) as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), text), 256), 1, 8), 16, 10).cast("bigint")


def peak_key(mz: Column, digits: int = 5) -> Column:
    """The three smallest m/z as whole units of the last digit, joined."""
    return F.array_join(F.transform(F.slice(F.sort_array(mz), 1, 3), lambda x: F.bround(x * 10**digits, 0).cast("bigint").cast("string")), "_")


def normalize_rt(rt: Column, scale: float = 600.0) -> Column:
    """Seconds over the scale; null and NaN are 0."""
    return F.coalesce(F.nanvl(rt, F.lit(0.0)), F.lit(0.0)) / scale
