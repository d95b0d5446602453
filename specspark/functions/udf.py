"""The UDF surface: a user's encoder in batches, table functions, SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from . import chemistry


def encode_with(df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], key: str, dim: int | None = None, batch_size: int = 1024) -> DataFrame:
    """(key, embedding): ``fn`` maps a batch of rows to a matrix, of ``dim`` columns if that is given; rows keep their key, so order
    doesn't matter."""
    kind = dict(df.dtypes)[key]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                out = np.asarray(fn(part), dtype=np.float32)
                if out.ndim != 2 or len(out) != len(part) or dim not in (None, out.shape[1]):
                    raise ValueError(f"the encoder gave {out.shape} for {len(part)} rows, not {dim or 'any'} columns each")
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(out)})

    return df.mapInPandas(encode, f"{key} {kind}, embedding array<float>")


@udtf(returnType="key: string, pos: int, candidate: string")
class ExplodeCandidates:
    """Rows of a JSON map of lists."""

    def eval(self, text: str):
        for key, values in json.loads(text or "{}").items():
            for pos, value in enumerate(values):
                yield key, pos, value


@udtf(returnType="block: int, header: string, n_peaks: int")
class MsBlocks:
    """Blocks of a .ms text."""

    def eval(self, text: str):
        from ..sources.tables import ms_blocks

        for block, header, mz, _, _ in ms_blocks(text):
            yield block, header, len(mz)


#: SQL functions of the array and number projections.
SQL_FUNCTIONS = {
    "peak_max(intensity ARRAY<DOUBLE>) RETURNS DOUBLE": "array_max(intensity)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "count_above(mz ARRAY<DOUBLE>, bound DOUBLE) RETURNS INT": "size(filter(mz, m -> m > bound))",
    "nce_to_ev(nce DOUBLE, precursor_mz DOUBLE) RETURNS DOUBLE": "nce * precursor_mz / 500",
    "ev_to_nce(ev DOUBLE, precursor_mz DOUBLE) RETURNS DOUBLE": "ev * 500 / precursor_mz",
    "stable_key(seed INT, text STRING) RETURNS BIGINT": "cast(conv(substr(sha2(concat(seed, ':', text), 256), 1, 8), 16, 10) as bigint)",
    "total_intensity(intensity ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(intensity, 0D, (s, x) -> s + x)",
    "scale_to_max(intensity ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(intensity, x -> x / nullif(array_max(intensity), 0D))",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        " / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"
    ),
    "polarity_of(adduct STRING) RETURNS INT": "CASE WHEN endswith(adduct, '+') THEN 1 WHEN endswith(adduct, '-') THEN 0 END",
    "parse_collision(text STRING) RETURNS DOUBLE": "try_cast(regexp_extract(text, '([0-9]+([.][0-9]+)?)', 1) AS DOUBLE)",
    "block_type(header STRING) RETURNS STRING": "lower(regexp_extract(header, '^[># ]*([A-Za-z0-9_]+)', 1))",
    "dedup_list(list ARRAY<STRING>) RETURNS ARRAY<STRING>": "array_distinct(list)",
    "rt_scaled(rt DOUBLE) RETURNS DOUBLE": "coalesce(nanvl(rt, 0D), 0D) / 600",
}


_PAIR = "ARRAY<STRUCT<mz: DOUBLE, intensity: DOUBLE>>"
_LISTS = "mz ARRAY<DOUBLE>, intensity ARRAY<DOUBLE>"
_ZIP = "transform(zip_with(mz, intensity, (m, i) -> named_struct('mz', m, 'intensity', i)), (p, j) -> named_struct('mz', p.mz, 'intensity', p.intensity, 'pos', j))"
_FINE = f"filter({_ZIP}, p -> NOT isnan(p.mz) AND NOT isnan(p.intensity) AND abs(p.mz) < double('infinity') AND abs(p.intensity) < double('infinity') AND p.mz > 0 AND p.intensity > 0)"
_FORMULA = "'([A-Z][a-z]?)([0-9]*)'"


def _strongest(peaks: str, k: str) -> str:
    return f"slice(sort_array(transform({peaks}, p -> named_struct('intensity', p.intensity, 'pos', p.pos, 'mz', p.mz)), false), 1, {k})"


def _by_mz(peaks: str) -> str:
    return f"transform(sort_array(transform({peaks}, p -> named_struct('mz', p.mz, 'pos', p.pos, 'intensity', p.intensity))), p -> named_struct('mz', p.mz, 'intensity', p.intensity))"


def _pairs(peaks: str) -> str:
    return f"transform({peaks}, p -> named_struct('mz', p.mz, 'intensity', p.intensity))"


def _scaled(peaks: str) -> str:
    """Intensities over the largest, within 0 and 1; the array is bound once."""
    scale = "(CASE WHEN array_max(a.intensity) > 0 THEN array_max(a.intensity) ELSE 1D END)"
    one = f"greatest(0D, least(1D, p.intensity / {scale}))"
    return f"get(transform(array({peaks}), a -> transform(a, (p, j) -> named_struct('mz', p.mz, 'intensity', {one}, 'pos', j))), 0)"


def _unit(vector: str) -> str:
    return f"get(transform(array({vector}), v -> transform(v, x -> x / coalesce(nullif(sqrt(aggregate(v, 0D, (s, y) -> s + y * y)), 0D), 1D))), 0)"


def _text(values: str) -> str:
    return f"array_join(transform({values}, x -> cast(cast(bround(x * 10000, 0) AS BIGINT) AS STRING)), ',')"


def _map(values: dict[str, float]) -> str:
    return "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in values.items()) + ")"


def _has(*names: str) -> str:
    return " + ".join(f"coalesce(try_element_at(counts, '{n}'), 0)" for n in names) + " > 0"


_POSITIVE = f"filter({_ZIP}, p -> p.mz > 0)"
SQL_FUNCTIONS |= {
    f"prepare_peaks({_LISTS}, k INT) RETURNS {_PAIR}": f"CASE WHEN size({_POSITIVE}) >= 3 THEN {_by_mz(_strongest(_scaled(_POSITIVE), 'k'))} END",
    f"top_peaks({_LISTS}, n INT) RETURNS {_PAIR}": f"CASE WHEN size({_FINE}) >= 3 THEN {_pairs(_scaled(_by_mz(_strongest(_FINE, 'n'))))} END",
    f"normalize_spectrum({_LISTS}) RETURNS {_PAIR}": _pairs(_scaled(_FINE)),
    f"strongest_peaks({_LISTS}, n INT, above DOUBLE) RETURNS {_PAIR}": _pairs(_strongest(f"filter({_ZIP}, p -> p.intensity > above)", "n")),
    f"parent_filter({_LISTS}, precursor_mz DOUBLE) RETURNS {_PAIR}": _pairs(f"filter({_ZIP}, p -> p.mz <= precursor_mz + 1D)"),
    "pad_list(list ARRAY<DOUBLE>, length INT) RETURNS ARRAY<DOUBLE>": "concat(slice(list, 1, length), array_repeat(0D, length - least(size(list), length)))",
    "peak_mask(list ARRAY<DOUBLE>, length INT) RETURNS ARRAY<BOOLEAN>": "transform(sequence(1, length), i -> i <= size(list))",
    "has_neutral_loss(mz ARRAY<DOUBLE>, precursor_mz DOUBLE, loss DOUBLE, tolerance DOUBLE) RETURNS BOOLEAN": "exists(mz, m -> abs(m - (precursor_mz - loss)) <= tolerance)",
    f"spectrum_signature({_LISTS}) RETURNS STRING": f"sha2(concat({_text('mz')}, '|', {_text('intensity')}), 256)",
    "peak_key(mz ARRAY<DOUBLE>) RETURNS STRING": "array_join(transform(slice(sort_array(mz), 1, 3), x -> cast(cast(bround(x * 100000, 0) AS BIGINT) AS STRING)), '_')",
    "bin_floor(mz DOUBLE, width DOUBLE) RETURNS INT": "cast(floor(mz / width) AS INT)",
    "bin_even(mz DOUBLE, width DOUBLE) RETURNS INT": "cast(bround(mz / width, 0) AS INT)",
    "unit_vector(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": _unit("a"),
    "fuse_vectors(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": _unit(f"concat({_unit('a')}, {_unit('b')})"),
    "formula_counts(formula STRING) RETURNS MAP<STRING, INT>": (
        f"map_from_entries(transform(array_sort(array_distinct(regexp_extract_all(formula, {_FORMULA}, 1))), e -> struct(e, aggregate(filter(regexp_extract_all(formula, {_FORMULA}, 0),"
        " p -> regexp_extract(p, '[A-Za-z]+', 0) = e), 0, (s, p) -> s + coalesce(try_cast(regexp_extract(p, '[0-9]+', 0) AS INT), 1)))))"
    ),
    "element_count(counts MAP<STRING, INT>, element STRING) RETURNS INT": "coalesce(try_element_at(counts, element), 0)",
    "formula_mass(counts MAP<STRING, INT>) RETURNS DOUBLE": f"aggregate(map_entries(counts), 0D, (s, e) -> s + e.value * try_element_at({_map(chemistry.MASSES)}, e.key))",
    "has_valid_elements(counts MAP<STRING, INT>, allowed ARRAY<STRING>) RETURNS BOOLEAN": "forall(map_keys(counts), e -> array_contains(allowed, e))",
    "family_label(counts MAP<STRING, INT>) RETURNS STRING": (
        f"CASE WHEN counts IS NULL THEN 'unassigned' WHEN {_has('F', 'Cl', 'Br', 'I')} THEN 'halogen' WHEN {_has('S', 'P')} THEN 'sulfur_phosphorus' WHEN {_has('N')} THEN 'nitrogen'"
        " WHEN 2 * coalesce(try_element_at(counts, 'O'), 0) > coalesce(try_element_at(counts, 'C'), 0) THEN 'oxygen_rich'"
        f" WHEN {_has('C')} AND NOT {_has('O')} THEN 'hydrocarbon' ELSE 'other' END"
    ),
    "adduct_of(polarity INT) RETURNS STRING": "CASE polarity WHEN 1 THEN '[M+H]+' WHEN 0 THEN '[M-H]-' END",
    "neutral_mass(mz DOUBLE, adduct STRING) RETURNS DOUBLE": f"mz - try_element_at({_map(chemistry.ADDUCT_SHIFTS)}, adduct)",
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions and table functions of this session."""
    for head, body in SQL_FUNCTIONS.items():
        name, _, rest = head.partition("(")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({rest} RETURN {body}")
    spark.udtf.register("explode_candidates", ExplodeCandidates)
    spark.udtf.register("ms_blocks", MsBlocks)
