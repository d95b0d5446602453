"""Corpus audits: counters of a shard in one pass, closure, roll-up, manifests and gates.

A shard row has arrays mz and intensity (zero-padded), polarity, rt, precursor_mz and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MZ_ALIASES, INTENSITY_ALIASES = ("mz", "spectrum_mz"), ("intensity", "spectrum_intensity")


def check_schema(df: DataFrame) -> list[str]:
    """What is wrong with a shard's columns: one alias each of lists of floating numbers, numeric scalars."""
    kinds, errors = dict(zip(df.columns, (f.dataType for f in df.schema.fields))), []
    for names in (MZ_ALIASES, INTENSITY_ALIASES):
        found = [n for n in names if n in kinds]
        if len(found) != 1:
            errors.append(f"needs exactly one of {', '.join(names)}; has {', '.join(found) or 'none'}")
        for n in found:
            t = kinds[n]
            if not (isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType))):
                errors.append(f"{n} is {t.simpleString()}, not a list of floating numbers")
    for n in ("precursor_mz", "rt", "polarity"):
        if n in kinds and not isinstance(kinds[n], T.NumericType):
            errors.append(f"{n} is {kinds[n].simpleString()}, not a number")
    return errors


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _count(a: Column, test) -> Column:
    return F.sum(F.coalesce(F.size(F.filter(a, test)), F.lit(0)))


def audit(df: DataFrame, by: list[str] = ("shard",), length: int | None = None, most_mz: float = 1500.0, most_precursor: float = 1000.0, most_rt: float = 1500.0, least_peaks: int = 3, most_intensity: float | None = None) -> DataFrame:
    """All counters of each shard in one aggregate: polarity, rt, precursor, lengths, values of both lists, structure, pairs, peak counts."""
    mz, inten, rt, pre = F.col("mz"), F.col("intensity"), F.col("rt"), F.col("precursor_mz")
    positive = F.size(F.filter(mz, lambda m: _finite(m) & (m > 0)))
    n_peaks = F.coalesce(F.greatest(positive, F.lit(0)), F.lit(0))
    both = F.arrays_zip(mz.alias("mz"), inten.alias("i"))
    padded = F.filter(both, lambda p: (F.coalesce(p["mz"], F.lit(0.0)) == 0) != (F.coalesce(p["i"], F.lit(0.0)) == 0))
    after = F.filter(mz, lambda m, i: (m > 0) & (i > 0) & (F.get(mz, i - 1) == 0))
    unsorted = F.filter(mz, lambda m, i: (m > 0) & (i > 0) & (F.get(mz, i - 1) > m))
    counts = {
        "rows": F.count(F.lit(1)),
        "polarity_0": F.count_if(F.col("polarity") == 0), "polarity_1": F.count_if(F.col("polarity") == 1),
        "polarity_other": F.count_if(F.col("polarity").isNull() | ~F.col("polarity").isin(0, 1)),
        "rt_valid": F.count_if(_finite(rt) & (rt > 0) & (rt <= most_rt)), "rt_above": F.count_if(_finite(rt) & (rt > most_rt)),
        "rt_missing": F.count_if(~_finite(rt) | (rt <= 0)),
        "precursor_null": F.count_if(pre.isNull()), "precursor_bad": F.count_if(pre.isNotNull() & (~_finite(pre) | (pre <= 0))),
        "precursor_above": F.count_if(_finite(pre) & (pre > most_precursor)), "precursor_valid": F.count_if(_finite(pre) & (pre > 0) & (pre <= most_precursor)),
        "lists_null": F.count_if(mz.isNull() | inten.isNull()), "lengths_equal": F.count_if(F.size(mz) == F.size(inten)),
        "lengths_unequal": F.count_if(F.size(mz) != F.size(inten)),
        "length_expected": F.count_if(F.size(mz) == length) if length else F.count_if(mz.isNotNull()),
        "mz_total": F.sum(F.coalesce(F.size(mz), F.lit(0))), "mz_finite": _count(mz, _finite), "mz_nonfinite": _count(mz, lambda m: ~_finite(m)),
        "mz_negative": _count(mz, lambda m: _finite(m) & (m < 0)), "mz_above": _count(mz, lambda m: _finite(m) & (m > most_mz)),
        "intensity_total": F.sum(F.coalesce(F.size(inten), F.lit(0))), "intensity_finite": _count(inten, _finite), "intensity_nonfinite": _count(inten, lambda i: ~_finite(i)),
        "intensity_negative": _count(inten, lambda i: _finite(i) & (i < 0)),
        "intensity_above": F.lit(0) if most_intensity is None else _count(inten, lambda i: _finite(i) & (i > most_intensity)),
        "padding_mismatch": F.sum(F.size(padded)), "interleaved": F.count_if(F.size(after) > 0), "unsorted": F.count_if(F.size(unsorted) > 0),
        "pairs_valid": _count(both, lambda p: (p["mz"] > 0) & _finite(p["i"]) & (p["i"] >= 0)),
        "pairs_invalid": _count(both, lambda p: (p["mz"] > 0) & (p["i"].isNotNull() & (~_finite(p["i"]) | (p["i"] < 0)))),
        "pairs_unpaired": _count(both, lambda p: (p["mz"] > 0) & p["i"].isNull()),
        "peaks_0": F.count_if(n_peaks == 0), "peaks_1": F.count_if(n_peaks == 1), "peaks_2": F.count_if(n_peaks == 2), "peaks_3": F.count_if(n_peaks >= 3),
        "eligible": F.count_if(n_peaks >= least_peaks), "skipped": F.count_if(n_peaks < least_peaks),
    }
    return df.groupBy(*by).agg(*[c.cast("bigint").alias(n) for n, c in counts.items()])


#: Parts that must add up to a whole.
CLOSURES = {
    "polarity": ("rows", ["polarity_0", "polarity_1", "polarity_other"]),
    "rt": ("rows", ["rt_valid", "rt_above", "rt_missing"]),
    "precursor": ("rows", ["precursor_null", "precursor_bad", "precursor_above", "precursor_valid"]),
    "lists": ("rows", ["lists_null", "lengths_equal", "lengths_unequal"]),
    "mz": ("mz_total", ["mz_finite", "mz_nonfinite"]),
    "intensity": ("intensity_total", ["intensity_finite", "intensity_nonfinite"]),
    "peaks": ("rows", ["peaks_0", "peaks_1", "peaks_2", "peaks_3"]),
    "minimum": ("rows", ["eligible", "skipped"]),
}


def check_closure(audited: DataFrame, by: list[str] = ("shard",)) -> DataFrame:
    """(by, closure, whole, parts) of each sum that isn't its whole; no row means that all close."""
    checks = F.array(*[F.struct(F.lit(n).alias("closure"), F.col(w).alias("whole"), sum((F.col(p) for p in parts[1:]), F.col(parts[0])).alias("parts")) for n, (w, parts) in CLOSURES.items()])
    return audited.select(*by, F.explode(checks).alias("c")).select(*by, "c.*").filter("whole <> parts")


def rollup_audit(audited: DataFrame, by: str = "shard") -> DataFrame:
    """The sums of all counters, with the number of shards."""
    return audited.agg(F.count(F.lit(1)).alias("shards"), *[F.sum(c).alias(c) for c in audited.columns if c != by])


def file_inventory(spark, folder: str, pattern: str = "*", table_format: str = "parquet") -> DataFrame:
    """(name, bytes, rows, sha256, start, end): the files of a folder by name; start and end are running row numbers, end exclusive.

    A file is hashed as one value of at most 2 GB. Files without rows have start = end.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counted = spark.read.format(table_format).option("pathGlobFilter", pattern).load(folder)
    counted = counted.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    both = files.join(counted, "name", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    end = F.sum("rows").over(Window.orderBy("name"))  # a list of files
    return both.select("name", "bytes", "rows", "sha256", (end - F.col("rows")).alias("start"), end.alias("end"))


def diff_manifest(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, difference): only_left, only_right, or the names of the columns that differ."""
    values = [c for c in a.columns if c != key]
    left, right = a.select(key, F.struct(*values).alias("a")), b.select(key, F.struct(*values).alias("b"))
    both = left.join(right, key, "full")
    changed = F.array_join(F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in values]), lambda x: x.isNotNull()), ",")
    return both.select(key, F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").otherwise(changed).alias("difference")).filter("difference <> ''")


def read_sha_list(spark, path: str) -> DataFrame:
    """(name, sha256) of lines such as "<64 hexadecimal digits>  name"."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 2).alias("name"), F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{64})", 1)).alias("sha256")).filter("name <> ''")


def check_sha_list(inventory: DataFrame, listed: DataFrame) -> DataFrame:
    return diff_manifest(inventory.select("name", "sha256"), listed.select("name", "sha256"), "name")


def fingerprint(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """One SHA-256 of each group's rows as JSON in order of their own hashes: the same for any partitioning.

    Rows are first combined by the hash's first digits, so one text never holds more than a 256th of a group's hashes.
    """
    values = [c for c in df.columns if c not in by]
    rows = df.select(*by, F.sha2(F.to_json(F.struct(*sorted(values)), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = rows.groupBy(*by, F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return part.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def digest_lines(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, digest): the SHA-256 of each key's values in order, one a line."""
    return df.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), "\n"), 256).alias("digest"))


def check_release(df: DataFrame, fold: str, expected: dict[str, int]) -> DataFrame:
    """(fold, n, expected) of the folds whose count isn't the expected one."""
    spec = df.sparkSession.createDataFrame(list(expected.items()), f"{fold} string, expected bigint")
    counts = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).join(spec, fold, "full")
    return counts.filter(~F.col("n").eqNullSafe(F.col("expected")))


def check_lineage(child: DataFrame, parent: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose count in the child's record isn't the parent's."""
    c, p = child.select(key, F.col(count).alias("child")), parent.select(key, F.col(count).alias("parent"))
    return c.join(p, key, "full").filter(~F.col("child").eqNullSafe(F.col("parent")))


def fold_overlap(df: DataFrame, fold: str, keys: list[str]) -> DataFrame:
    """(field, a, b, shared): how many values of each field two folds share."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys])).alias("v")
    sets = df.select(fold, values).select(fold, "v.*").distinct().groupBy("field", "value").agg(F.array_sort(F.collect_set(fold)).alias("f"))
    a = sets.select("field", "f", F.explode("f").alias("a"))
    return a.select("field", "a", F.explode("f").alias("b")).filter("a < b").groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def profile_folds(df: DataFrame, fold: str) -> DataFrame:
    n = F.size("mz")
    return df.groupBy(fold).agg(
        F.min(n).alias("min"), F.percentile(n, 0.05).alias("p05"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.95).alias("p95"),
        F.max(n).alias("max"), F.count_if(n >= 5).alias("n_5"), F.count_if(n >= 10).alias("n_10"), F.count_distinct("adduct").alias("adducts"),
    )


def audit_candidates(queries: DataFrame, candidates: DataFrame, key: str, truth: str, candidate: str) -> DataFrame:
    """One row: queries, those without a list, with the truth in or missing, lists with repeats, and the lengths' distribution."""
    lists = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(candidate).alias("d"))
    hit = candidates.select(key, F.col(candidate).alias(truth)).distinct().withColumn("hit", F.lit(True))
    both = queries.join(lists, key, "left").join(hit, [key, truth], "left")
    return both.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n").isNull()).alias("missing_list"), F.count_if("hit").alias("truth_in"),
        F.count_if(F.col("n").isNotNull() & F.col("hit").isNull()).alias("truth_missing"), F.count_if(F.col("n") > F.col("d")).alias("with_repeats"),
        F.min("n").alias("min"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("max"),
    )


def assert_matches(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """One row: keys of either side alone, and values that differ by more than the tolerance."""
    l, r = a.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__l")), b.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    both = l.join(r, keys, "full")
    return both.agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.count_if(F.abs(F.col("__a") - F.col("__b")) > tolerance).alias("different"))


def skip_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """(reason, n): the first reason that holds for each row, "kept" for none."""
    out = F.lit("kept")
    for name, test in reversed(reasons.items()):
        out = F.when(test, name).otherwise(out)
    return df.groupBy(out.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def label_stats(df: DataFrame, fold: str, labels: list[str]) -> DataFrame:
    """(fold, label, prevalence, n): share of ones among non-null values."""
    long = df.select(fold, F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("double").alias("v")) for x in labels])).alias("s")).select(fold, "s.*")
    return long.groupBy(fold, "label").agg(F.avg("v").alias("prevalence"), F.count("v").alias("n"))


def check_same_population(df: DataFrame, method: str, key: str) -> DataFrame:
    """(key, methods, rows) of keys that not every method sees exactly once."""
    total = df.agg(F.count_distinct(method).alias("__m"))
    seen = df.groupBy(key).agg(F.count_distinct(method).alias("methods"), F.count(F.lit(1)).alias("rows"))
    return seen.crossJoin(F.broadcast(total)).filter("methods <> __m or rows <> __m").drop("__m")


def pending_shards(shards: DataFrame, done: DataFrame, key: str, found: DataFrame | None = None, digest: str = "sha256") -> DataFrame:
    """Shards that aren't recorded as done. With ``found`` (key, digest of what lies there now), a recorded output that is gone or
    has another digest is pending again."""
    finished = done.select(key)
    if found is not None:
        same = done.select(key, F.col(digest).alias("__was")).join(found.select(key, F.col(digest).alias("__is")), key)
        finished = same.filter("__was = __is").select(key)
    return shards.join(finished, key, "left_anti")


def drop_crossing_keys(df: DataFrame, key: str, fold: str) -> DataFrame:
    """Rows of keys that lie in one fold."""
    crossing = df.groupBy(key).agg(F.min(fold).alias("a"), F.max(fold).alias("b")).filter("a <> b").select(key)
    return df.join(crossing, key, "left_anti")


def gate(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(name, value, passed, all_passed) of rules (metric, ">=" or "<=", limit) on (name, value)."""
    spec = metrics.sparkSession.createDataFrame(rules, "name string, op string, bound double")
    rows = spec.join(metrics, "name", "left")
    passed = F.coalesce(F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")), F.lit(False))
    return rows.select("name", "value", passed.alias("passed")).withColumn("all_passed", F.every("passed").over(Window.partitionBy()))


def range_loss(df: DataFrame, most: float, by: list[str] = ()) -> DataFrame:
    """Shares of peaks and of intensity at or above an m/z, and rows without a peak below."""
    both = F.arrays_zip(F.col("mz").alias("mz"), F.col("intensity").alias("i"))
    lost = F.filter(both, lambda p: p["mz"] >= most)
    s = lambda a: F.aggregate(a, F.lit(0.0), lambda x, p: x + p["i"])
    return df.groupBy(*by).agg((F.sum(F.size(lost)) / F.sum(F.size("mz"))).alias("peak_share"), (F.sum(s(lost)) / F.sum(s(both))).alias("intensity_share"), F.count_if(F.size(lost) == F.size("mz")).alias("emptied"))


def validate_spectra(df: DataFrame, fail: bool = False) -> DataFrame:
    """Rows with reason (null if fine); with ``fail`` the first bad row raises an error."""
    bad = F.when(F.size("mz") != F.size("intensity"), "unequal lengths").when(
        F.exists("mz", lambda m: ~_finite(m)) | F.exists("intensity", lambda m: ~_finite(m)), "non-finite peak").when(
        ~_finite(F.col("precursor_mz")) | (F.col("precursor_mz") <= 0), "bad precursor")
    out = df.withColumn("reason", bad)
    return out.filter(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.col("reason")).cast("boolean"))) if fail else out


def header_mismatch(df: DataFrame, declared: str, found: str) -> DataFrame:
    return df.agg(F.count_if(~F.col(declared).eqNullSafe(F.col(found))).alias("mismatches"), F.count(F.lit(1)).alias("n"))


def run_identity(config: dict, inputs: DataFrame) -> str:
    """The digest of a configuration and of its inputs' fingerprint."""
    import hashlib
    import json

    own = fingerprint(inputs).first()
    return hashlib.sha256(json.dumps([config, own and own["fingerprint"]], sort_keys=True).encode()).hexdigest()
