"""Spectrum tables in other forms: peak texts, packed buffers, shards, rankings, candidate maps, block files, sinks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import before, value_range
from .textfiles import write_text_files

RANKING = (
    "sample_idx bigint, fold string, smiles string, adduct string, precursor_mz double, collision_energy double, rank int, n_candidates int, "
    "gt_score double, top_candidates array<string>, top_scores array<double>"
)


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def parse_peak_text(df: DataFrame, mz: str = "mzs", intensity: str = "intensities") -> DataFrame:
    """Arrays mz and intensity from two comma lists, cut to the shorter; finite peaks with mz > 0 and intensity >= 0."""
    n = F.least(F.size(_numbers(F.col(mz))), F.size(_numbers(F.col(intensity))))
    both = F.arrays_zip(F.slice(_numbers(F.col(mz)), 1, n).alias("m"), F.slice(_numbers(F.col(intensity)), 1, n).alias("i"))
    good = F.filter(both, lambda p: (p["m"] > 0) & (p["i"] >= 0) & (p["m"] < float("inf")) & (p["i"] < float("inf")))
    df = df.withColumn("__p", good)
    return df.withColumn("mz", F.col("__p.m")).withColumn("intensity", F.col("__p.i")).drop("__p")


def format_peak_text(df: DataFrame) -> DataFrame:
    text = {t: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for t, c in (("mzs", "mz"), ("intensities", "intensity"))}
    return df.withColumns(text)


def parse_peak_tuples(text: Column) -> Column:
    """array<struct<mz, intensity>> of "[('100.1', '5'), ...]"."""
    pairs = F.regexp_extract_all(text, F.lit(r"\('?([0-9.eE+-]+)'?,\s*'?([0-9.eE+-]+)'?\)"), F.lit(0))
    number = lambda p, k: F.regexp_extract(p, r"\('?([0-9.eE+-]+)'?,\s*'?([0-9.eE+-]+)'?\)", k).cast("double")
    return F.transform(pairs, lambda p: F.struct(number(p, 1).alias("mz"), number(p, 2).alias("intensity")))


def format_peak_tuples(mz: Column, intensity: Column, digits: int = 4) -> Column:
    one = F.transform(F.arrays_zip(mz.alias("m"), intensity.alias("i")), lambda p: F.concat(F.lit("('"), F.format_string(f"%.{digits}f", p["m"]), F.lit("', '"), F.format_string(f"%.{digits}f", p["i"]), F.lit("')")))
    return F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))


#: Pairs of a packed buffer.
PACKED = 150


def _places(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, value) of all entries of a list column, and each row's length; null rows are empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, column.flatten().to_numpy(zero_copy_only=False), sizes


@F.arrow_udf(T.BinaryType())
def pack_spectrum(mz: pa.Array, intensity: pa.Array) -> pa.Array:
    """A float32 buffer of 150 (m/z, intensity) pairs, zero-padded; what one list has more than the other is cut. Null for a null list."""
    out = np.zeros((len(mz), PACKED, 2), dtype="<f4")
    parts = [_places(mz), _places(intensity)]
    least = np.minimum(PACKED, np.minimum(parts[0][3], parts[1][3]))
    for i, (row, place, value, _) in enumerate(parts):
        fine = place < least[row]
        out[row[fine], place[fine], i] = value[fine]
    buffers = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * PACKED), len(mz), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return pc.if_else(pc.and_(mz.is_valid(), intensity.is_valid()), buffers, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mz", "intensity")]))
def unpack_spectrum(packed: pa.Array, length: pa.Array) -> pa.Array:
    """The first ``length`` pairs of each buffer; null for a null buffer or length."""
    found = [np.frombuffer(b, dtype="<f4").reshape(-1, 2)[:n].astype(np.float64) if b is not None and n is not None else None for b, n in zip(packed.to_pylist(), length.to_pylist())]
    known = [f for f in found if f is not None]
    pairs = np.concatenate(known) if known else np.zeros((0, 2))
    ends = pa.array(np.concatenate([[0], np.cumsum([0 if f is None else len(f) for f in found])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(pairs[:, i]))) for i in (0, 1)]
    return pa.StructArray.from_arrays(lists, names=["mz", "intensity"], mask=pa.array([f is None for f in found]))


#: What a shard's columns may be called, and what a missing one is.
ALIASES = {"mz": ("mz", "spectrum_mz"), "intensity": ("intensity", "spectrum_intensity"), "rt": ("rt", "RT")}
DEFAULTS = {"rt": "double", "collision_energy": "double", "adduct": "string", "smiles": "string", "polarity": "int"}


def shard_columns(df: DataFrame) -> DataFrame:
    """Aliases renamed, missing optional columns as nulls, "nan" texts and NaN as null."""
    for name, options in ALIASES.items():
        found = [c for c in options if c in df.columns]
        if found and found[0] != name:
            df = df.withColumnRenamed(found[0], name)
    for name, kind in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
        elif kind == "string":
            df = df.withColumn(name, F.when(~F.lower(name).isin("nan", "none", ""), F.col(name)))
        elif kind == "double":
            df = df.withColumn(name, F.when(~F.isnan(name), F.col(name).cast("double")))
    return df


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet shards by name; further paths are added, those without files left out."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = []
    for p in paths:
        at = jvm.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            there.append(p)
    out = None
    for p in there:
        one = shard_columns(spark.read.parquet(p))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(", ".join(paths))
    return out


def read_feather_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow files, one task a file."""
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                with pa.ipc.open_file(pa.py_buffer(content.as_py())) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i)

    return shard_columns(spark.read.format("binaryFile").option("pathGlobFilter", "*.{feather,arrow}").load(path).select("content").mapInArrow(read, schema))


def write_rankings(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANKING).json(path, mode="FAILFAST")


def candidate_rows(df: DataFrame, json: str) -> DataFrame:
    """(key, pos, candidate) of JSON maps of lists."""
    maps = df.select(F.explode(F.from_json(json, "map<string,array<string>>")).alias("key", "list"))
    return maps.select("key", F.posexplode("list").alias("pos", "candidate"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return candidate_rows(spark.read.text(path, wholetext=True), "value")


def read_split_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(spec, fold): the fold column is the first that isn't called spec."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    fold = next(c for c in df.columns if c != "spec")
    return df.select("spec", F.col(fold).alias("fold"))


def convert_table(spark: SparkSession, source: str, target: str, columns: list[str]) -> None:
    """A tab-separated table as CSV with a running number; another header or width is an error."""
    header = spark.read.text(source).first()["value"].split("\t")
    if header != columns:
        raise ValueError(f"columns are {header}, not {columns}")
    df = spark.read.csv(source, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in columns), mode="FAILFAST", enforceSchema=True)
    row_numbers(df, "index").select("index", *columns).write.csv(target, header=True)


def row_numbers(df: DataFrame, out: str) -> DataFrame:
    """``df``, read from files, with the place of each row from 0: files by name, rows as they lie in them.

    A row's place in its piece of a file comes from its running number in the task, and pieces are counted first: as many rows as Spark
    makes tasks. No row is moved or sorted.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__m"))
    pieces = placed.groupBy("__file", "__at").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__least"))
    before = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    starts = pieces.select("__file", "__at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__least")).alias("__start"))
    return placed.join(starts, ["__file", "__at"]).withColumn(out, F.col("__start") + F.col("__m")).drop("__file", "__at", "__m", "__start")


def write_embeddings(df: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    if df.isEmpty():
        raise ValueError("there are no embeddings to write")
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.parquet(path)


def equal_shards(df: DataFrame, order: str, shards: int | None = None, target: int = 100_000, world: int = 1) -> DataFrame:
    """Rows with shard: contiguous in ``order``, the first ``rows mod shards`` shards one row longer; by default
    ceil(rows / target) shards, rounded up to a multiple of ``world``."""
    rows = df.count()
    n = shards or max(world, math.ceil(math.ceil(rows / target) / world) * world)
    small, longer = divmod(rows, n)
    spark = df.sparkSession
    dealt = value_range(df, order, "__p")
    sizes = {r["__p"]: r["n"] for r in dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    firsts, at = [], 0
    for p in sorted(sizes):
        firsts.append((p, at))
        at += sizes[p]
    offsets = spark.createDataFrame(firsts, "__p int, __f bigint")
    i = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1 + F.col("__f")
    edge = longer * (small + 1)
    shard = F.when(F.col("__i") < edge, F.floor(F.col("__i") / (small + 1))).otherwise(longer + F.floor((F.col("__i") - edge) / max(1, small)))
    return dealt.join(F.broadcast(offsets), "__p").withColumn("__i", i).withColumn("shard", shard.cast("int")).drop("__p", "__f", "__i")


def write_equal_shards(df: DataFrame, path: str, order: str, **options) -> None:
    equal_shards(df, order, **options).write.partitionBy("shard").option("compression", "zstd").parquet(path)


def dictionary_encode(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Rows with a dense id from 0 by first appearance in ``order``, a number. Rows without a value go."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__o"), F.lit(1).alias("__one"))
    ids = before(firsts, "__o", {"__id": ("sum", "__one")}).select(column, F.col("__id").cast("int").alias(out))
    return df.join(ids, column)


def first_row_per_value(df: DataFrame, column: str, row: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(row).alias("first_row"))


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, compression="gzip")


def ms_blocks(text: str) -> list[tuple]:
    """(block, header, mz, intensity, meta) of each peak block of a .ms text; repeated keys get a prime; no parentmass is an error."""
    meta, out, header, peaks = {}, [], None, []

    def close() -> None:
        if header is not None and peaks:
            out.append((len(out), header, [p[0] for p in peaks], [p[1] for p in peaks]))

    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        if line[0] in ">#":
            key, _, value = line.lstrip("># ").partition(" ")
            if key.lower().startswith(("ms1", "ms2", "collision")):
                close()
                header, peaks = line, []
            else:
                while key in meta:
                    key += "'"
                meta[key] = value.strip()
        else:
            parts = line.split()
            peaks.append((float(parts[0]), float(parts[1])))
    close()
    if "parentmass" not in meta:
        raise ValueError("a .ms file without parentmass")
    return [(*b, meta) for b in out]


MS_SCHEMA = "file string, block int, header string, mz array<double>, intensity array<double>, meta map<string,string>"


def read_ms_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row a peak block of the .ms files below a path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.ms").withColumn("file", F.input_file_name())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *b) for f, t in zip(batch["file"], batch["value"]) for b in ms_blocks(t)]
            yield pd.DataFrame(rows, columns=["file", "block", "header", "mz", "intensity", "meta"])

    return files.mapInPandas(parse, MS_SCHEMA)


#: What begins a compound in a .ms file that holds several.
COMPOUND = ">compound "


def read_ms_compounds(spark: SparkSession, path: str) -> DataFrame:
    """One row a peak block, as ``read_ms_blocks``, of .ms files that may hold many compounds, each begun by its >compound line.

    Spark cuts the files at these lines, so that a large file is read by several tasks and a task holds few compounds at a time. Blocks are
    numbered and metadata hold within a compound. A file that begins otherwise is an error.
    """
    texts = spark.read.text(path, lineSep=f"\n{COMPOUND}", pathGlobFilter="*.ms").withColumn("file", F.input_file_name())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, t in zip(batch["file"], batch["value"]):
                t = t.removeprefix(COMPOUND)
                if t.startswith((">", "#")) or not t.partition("\n")[0].strip():
                    raise ValueError(f"{f}: a .ms file that doesn't begin with a named >compound")
                rows += [(f, *b) for b in ms_blocks(COMPOUND + t)]
            yield pd.DataFrame(rows, columns=["file", "block", "header", "mz", "intensity", "meta"])

    return texts.mapInPandas(parse, MS_SCHEMA)


def write_ms_compounds(df: DataFrame, path: str, name: str) -> None:
    """Each row as a compound called by the column ``name``, with its metadata and peaks, in one .ms file a task below the new folder ``path``.

    The number of files is that of tasks, not of compounds, so that neither a store nor the driver's listing meets a file a row.
    Names and metadata are single lines; others, names that are null or blank or begin with a mark, and "compound" as a key are errors.
    """
    named = F.col(name).cast("string")
    meta = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(F.lit("\n>"), e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("")))), "")
    peaks = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat_ws(" ", p["mz"], p["intensity"])), "\n")
    one_line = ~F.exists(F.flatten(F.array(F.map_keys("meta"), F.map_values("meta"))), lambda x: F.coalesce(x, F.lit("")).rlike("[\\r\\n]"))
    fine = named.rlike("^[^>#\\s][^\\r\\n]*$") & one_line & ~F.array_contains(F.map_keys("meta"), "compound")
    text = F.concat(F.lit(COMPOUND), named, meta, F.lit("\n\n>ms2\n"), peaks)
    bad = F.raise_error(F.concat(F.lit("no compound for a .ms file: "), F.coalesce(named, F.lit("null")))).cast("string")
    spark = df.sparkSession
    df.select(F.when(F.coalesce(fine, F.lit(False)), text).otherwise(bad).alias("value")).write.text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in store.listStatus(at):  # a file a task; Spark's text writer calls them .txt
        old = file.getPath()
        if old.getName().endswith(".txt") and not store.rename(old, spark._jvm.org.apache.hadoop.fs.Path(at, f"{old.getName()[:-4]}.ms")):
            raise OSError(f"{old.toString()} can't be renamed")


def write_ms(df: DataFrame, path: str, name: str | None = None) -> None:
    """A .ms file for each row below ``path``: metadata, then its peaks as an ms2 block. Files are named by the column ``name``, which must
    differ, or by number."""
    meta = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(F.lit(">"), e["key"], F.lit(" "), e["value"])), "\n")
    peaks = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat_ws(" ", p["mz"], p["intensity"])), "\n")
    named = F.col(name).cast("string") if name else F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    write_text_files(df.select(F.concat(named, F.lit(".ms")).alias("name"), F.concat(meta, F.lit("\n\n>ms2\n"), peaks, F.lit("\n")).alias("text")), path)
