"""Spectra, peaks, vectors and candidates derived from the relational test tables, in Spark and as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.lineage import shared_folder

PEAKS_SQL = """peaks AS (
  SELECT l_orderkey AS spectrum_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_quantity, l_partkey, l_suppkey, l_linenumber) AS INT) AS pos,
         l_extendedprice / 100 AS mz, l_quantity AS intensity
  FROM lineitem)"""

SPECTRA_SQL = """spectra AS (
  SELECT o_orderkey AS spectrum_id, o_totalprice / 500 AS precursor_mz, o_custkey AS molecule_id, c_nationkey AS formula_id,
         o_orderpriority AS adduct, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS polarity,
         CAST((o_orderkey * 37) % 1800 AS DOUBLE) AS rt, CAST(10 * (1 + o_orderkey % 6) AS DOUBLE) AS collision_energy,
         CASE WHEN o_custkey % 10 < 8 THEN 'train' WHEN o_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS fold,
         CAST(o_orderkey % 16 AS INT) AS shard
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""

#: A formula text for each part.
FORMULA_SQL = """formulas AS (
  SELECT p_partkey, 'C' || p_size || 'H' || (2 * p_size + 2) || CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE '' END
         || CASE WHEN p_partkey % 2 = 0 THEN 'O' || (p_partkey % 7 + 1) ELSE '' END
         || CASE WHEN p_partkey % 11 = 0 THEN 'Cl2' ELSE '' END || CASE WHEN p_partkey % 13 = 0 THEN 'S' ELSE '' END
         || CASE WHEN p_partkey % 17 = 0 THEN 'Si' ELSE '' END AS formula FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spectrum_id, pos, mz, intensity): one row a peak; pos is a total order from 1."""
    order = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("spectrum_id"), F.row_number().over(order).alias("pos"),
        (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order that has lines."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    found = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    last = F.col("o_custkey") % 10
    return found.select(
        F.col("o_orderkey").alias("spectrum_id"), (F.col("o_totalprice") / 500).alias("precursor_mz"), F.col("o_custkey").alias("molecule_id"),
        F.col("c_nationkey").alias("formula_id"), F.col("o_orderpriority").alias("adduct"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("polarity"),
        ((F.col("o_orderkey") * 37) % 1800).cast("double").alias("rt"), (10 * (1 + F.col("o_orderkey") % 6)).cast("double").alias("collision_energy"),
        F.when(last < 8, "train").when(last == 8, "val").otherwise("test").alias("fold"), (F.col("o_orderkey") % 16).cast("int").alias("shard"),
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metadata`` with the arrays mz and intensity by pos."""
    rows = peaks(spark, sf_dir).groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mz", "intensity"))).alias("p"))
    arrays = rows.select("spectrum_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    return metadata(spark, sf_dir).join(arrays, "spectrum_id")


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit("C"), size, F.lit("H"), 2 * size + 2, F.when(key % 3 == 0, "N").otherwise(""),
        F.when(key % 2 == 0, F.concat(F.lit("O"), key % 7 + 1)).otherwise(""), F.when(key % 11 == 0, "Cl2").otherwise(""),
        F.when(key % 13 == 0, "S").otherwise(""), F.when(key % 17 == 0, "Si").otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("formula"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vector array<double>, label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
