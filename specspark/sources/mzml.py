"""mzML by Spark's XML source: one row a spectrum element, binary arrays decoded in Arrow batches."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Accessions of the controlled vocabulary.
MS_LEVEL, SELECTED_MZ, MZ_ARRAY, INTENSITY_ARRAY, ZLIB, FLOAT64 = "MS:1000511", "MS:1000744", "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000523"
_CV = "array<struct<_accession:string,_value:string>>"
SCHEMA = (
    f"_id string, cvParam {_CV}, precursorList struct<precursor:array<struct<selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},binary:string>>>"
)


@F.pandas_udf(ArrayType(DoubleType()))
def decode(text: pd.Series, packed: pd.Series, wide: pd.Series) -> pd.Series:
    def one(t, z, w):
        if t is None:
            return None
        raw = base64.b64decode("".join(t.split()))
        return np.frombuffer(zlib.decompress(raw) if z else raw, dtype="<f8" if w else "<f4").astype(float).tolist()

    return pd.Series([one(*x) for x in zip(text, packed, wide)], dtype=object)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """(id, mz, intensity, precursor_mz) of the spectra of MS level 2: the first selected ion; a spectrum without peaks is an error."""
    rows = spark.read.format("xml").option("rowTag", "spectrum").schema(SCHEMA).load(path)

    def value(params, accession):
        return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))["_value"]

    def has(params, accession):
        return F.exists(params, lambda p: p["_accession"] == accession)

    arrays = F.col("binaryDataArrayList.binaryDataArray")
    rows = rows.filter(value(F.col("cvParam"), MS_LEVEL) == "2")
    for name, accession in (("mz", MZ_ARRAY), ("intensity", INTENSITY_ARRAY)):
        a = F.get(F.filter(arrays, lambda x: F.exists(x["cvParam"], lambda p: p["_accession"] == accession)), F.lit(0))
        rows = rows.withColumn(name, decode(a["binary"], has(a["cvParam"], ZLIB), has(a["cvParam"], FLOAT64)))
    ion = F.get(F.get(F.col("precursorList.precursor"), F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0))
    checked = F.when(F.size("mz") > 0, F.col("mz")).otherwise(F.raise_error(F.concat(F.lit("no peaks in "), F.col("_id"))).cast("array<double>"))
    return rows.select(F.col("_id").alias("id"), checked.alias("mz"), "intensity", value(ion["cvParam"], SELECTED_MZ).cast("double").alias("precursor_mz"))
