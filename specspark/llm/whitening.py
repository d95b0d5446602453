"""Whitening of vectors by a covariance that Spark adds up and a refined eigenvector solve.

Entries are put on a grid of whole numbers, so means and deviations are exact. Tasks multiply their centred vectors, Spark adds
the products, and only a matrix as wide as a vector comes to the driver. There single-precision eigenvectors are corrected by the
iterations of Ogita and Aishima: matrix products in double precision that converge quadratically. Eigenvalues too close for the
corrections to tell apart are solved again inside the space that they span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Vectors become floor(GRID * c) + SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Entries beyond this lie off the grid: their whole numbers aren't exact doubles.
LARGEST = 2.0**46
#: Widest vectors: the driver and every task hold matrices of this many rows and columns (134 MB).
MAX_DIM = 4096
#: Corrections in a row, turns of corrections and cluster solves, clusters inside clusters; the last are solved in double precision.
STEPS, ROUNDS, DEPTH = 8, 6, 6


def usable(vector: Column) -> Column:
    """Whether all entries are finite numbers on the grid; false for null and empty vectors."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    return F.coalesce(fine & (F.size(v) > 0), F.lit(False))


def on_grid(vector: Column) -> Column:
    """Whole numbers of usable vectors; filters may be tried after this, so other entries are null and no error."""
    return F.transform(vector.cast("array<double>"), lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * GRID).cast("bigint") + SHIFT))


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    at = sorted(sums)
    values = pa.array([sums[i] for i in at], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), values], names=["i", "v"])


def _matrix(parts: DataFrame, dim: int) -> np.ndarray:
    """The symmetric sum of upper triangles from (i, v): v are the entries of row i from column i on."""
    cells = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros((dim, dim))
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy() + cells["i"].to_numpy()
    m[i, j] = m[j, i] = cells["x"].to_numpy()
    return m


def _outer_sums(vectors: DataFrame, dim: int, of) -> np.ndarray:
    """The sum over all rows of ``vectors`` (x) of the outer products of ``of``'s rows, ``dim`` wide."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((dim, dim)), False
        for batch in batches:
            if batch.num_rows:
                y, any_row = of(batch.column(0)), True
                total += y.T @ y
        if any_row:
            yield _products({i: total[i, i:] for i in range(dim)})

    return _matrix(vectors.mapInArrow(add, "i int, v array<double>"), dim)


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction of approximate eigenvectors: (x, eigenvalues, bound, size of the correction).

    x becomes x + x e, where e comes from how far x is from orthogonal (r) and x' a x from diagonal (s). Eigenvalues that differ
    by no more than the bound can't be told apart at x's present error; of their directions only orthogonality is corrected.
    """
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (np.linalg.norm(s - np.diag(np.diag(s)), 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= bound
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1.0, gap))
    return x + x @ e, values, bound, float(np.abs(e).max())


def solve(a: np.ndarray, depth: int = 0) -> np.ndarray:
    """Unit eigenvectors (columns) of the symmetric ``a``: single-precision ones, corrected until corrections are of rounding size.

    Clusters that the bound can't tell apart then are solved in the space that they span, about their mean: differences that are
    small beside ``a`` are the whole of that small matrix. Corrections follow again, now with a smaller bound. Equal eigenvalues
    (to rounding) keep any basis of their space.
    """
    eps = np.finfo(float).eps
    x = np.linalg.eigh((a / np.abs(a).max()).astype(np.float32))[1].astype(np.float64)
    for _ in range(ROUNDS):
        size = np.inf
        for _ in range(STEPS):
            x, values, bound, now = corrected(a, x)
            if now < eps or now > size / 2:
                break
            size = now
        order = np.argsort(-values)
        found = False
        for cluster in np.split(order, np.flatnonzero(np.diff(-values[order]) > bound) + 1):
            if len(cluster) == 1:
                continue
            basis = np.linalg.qr(x[:, cluster])[0]
            small = basis.T @ (a @ basis) - values[cluster].mean() * np.eye(len(cluster))
            small = (small + small.T) / 2
            if np.abs(small - np.diag(np.diag(small))).max() <= 4 * eps * np.abs(values).max():
                continue  # equal to rounding
            deeper = depth < DEPTH and (len(cluster) < len(a) or np.abs(small).max() < np.abs(a).max() / 2)
            x[:, cluster] = basis @ (solve(small, depth + 1) if deeper else np.linalg.eigh(small)[1])
            found = True
        if not found:
            break
    x = np.linalg.qr(x)[0]  # corrections of nearly equal directions are rounding noise: they may turn, but not lean
    s = x.T @ (a @ x)
    joined = np.abs(s) > 16 * eps * np.abs(np.diag(s)).max()
    np.fill_diagonal(joined, True)
    label = np.arange(len(a))
    while (new := np.where(joined, label[None, :], len(a)).min(axis=1)).tolist() != label.tolist():
        label = new
    for first in np.unique(label):  # directions that still mix
        group = np.flatnonzero(label == first)
        if len(group) > 1:
            small = s[np.ix_(group, group)]
            x[:, group] = x[:, group] @ np.linalg.eigh((small + small.T) / 2)[1]
    return x


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns) of a symmetric matrix, in double precision."""
    if not np.abs(a).max():
        return np.zeros(len(a)), np.eye(len(a))
    x = solve(a)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.linalg.norm(x[:, order], axis=0)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error): a row for each usable vector of ``df``.

    Rows whose vector is null or empty or has null, non-finite or off-grid entries (2^46 and beyond) are left out, and so are those
    narrower or wider than most (ties: the widest). The others, n of them, are x = floor(64 c) + 1000000. whitened and explained
    hold a number for each of the first ``components`` eigenvectors of x's covariance, those left out whose eigenvalue
    is zero to rounding (equal vectors have none). deviation is the sum of (n x - S)^2 over dimensions, null if it passes 64 bits.

    ``df`` is read four times: write it first if its plan is costly or gives other rows each time. Keys may be null or equal.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("c")).filter(usable(F.col("c")))
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()}
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if not sizes:
        return spark.createDataFrame([], schema)
    ((dim, n),) = sizes.items()
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIM}")
    rows = rows.filter(F.size("c") == dim).select("k", on_grid(F.col("c")).alias("x"))
    total = _sums(rows, dim)
    exact = 2 * n * max(1, *(abs(s) // n + 1 for s in total)) < 2**62  # n x - S stays within 64 bits for x near the mean

    def centred(column: pa.ListArray) -> np.ndarray:
        return _deviations(_rows(column, dim), n, total, exact).astype(np.float64) / n

    covariance = _outer_sums(rows.select("x"), dim, centred) / n
    values, vectors = eigenvectors(covariance)
    kept = min(components, int((values > dim * np.finfo(float).eps * max(values[0], 0)).sum())) if values[0] > 0 else 0
    turn = vectors[:, :kept] / np.sqrt(values[:kept])
    explained = (values[:kept] / np.trace(covariance)).tolist() if kept else []

    def projected(column: pa.ListArray) -> np.ndarray:
        return centred(column) @ turn

    mean = _mean(rows.select("x"), kept, projected, n) if kept else np.zeros(0)
    error = float(np.abs(_outer_sums(rows.select("x"), kept, lambda c: projected(c) - mean) / n - np.eye(kept)).max()) if kept else 0.0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _deviations(_rows(batch.column(1), dim), n, total, exact)
            squares = _square_sums(far)
            white = (far.astype(np.float64) / n) @ turn
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * kept)
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), squares, lists], names=["k", "deviation", "whitened"])

    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(finish, f"k {kind}, deviation bigint, whitened array<double>")
    return out.select(
        F.col("k").alias(key), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"),
    )


def _sums(rows: DataFrame, dim: int) -> list[int]:
    """The exact sum of every dimension."""
    cells = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"))
    found = {r["i"]: int(r["s"]) for r in cells.collect()}  # one row a dimension
    return [found[i] for i in range(dim)]


def _mean(vectors: DataFrame, dim: int, of, n: int) -> np.ndarray:
    """The mean of ``of``'s rows: zero but for rounding."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    cells = vectors.mapInArrow(add, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(dim)
    out[cells["i"].to_numpy()] = cells["x"].to_numpy()
    return out / n


def _deviations(x: np.ndarray, n: int, total: list[int], exact: bool) -> np.ndarray:
    """n x - S: in 64-bit whole numbers where these hold it, else in Python's."""
    if exact and len(x) and int(np.abs(x).max()) * n < 2**62:
        return x * n - np.array(total, dtype=np.int64)
    return x.astype(object) * n - np.array(total, dtype=object)


def _square_sums(far: np.ndarray) -> pa.Array:
    if far.dtype == np.int64 and len(far) and int(np.abs(far).max()) ** 2 * far.shape[1] < 2**63:
        return pa.array((far * far).sum(axis=1))
    sums = [sum(int(v) * int(v) for v in row) for row in far]
    return pa.array([s if s < 2**63 else None for s in sums], pa.int64())
