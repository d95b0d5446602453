"""Products of two vector tables, tile against tile.

Queries are dealt to tiles of bounded size; a tile is a matrix, and library rows stream past it in chunks, each multiplied with it at
once. Queries of few bytes (counted first) are sent to all tasks, so that the library is read where it lies. Otherwise the library is
dealt to parts, too. A cell is one tile and one part: its queries are repeated for every part and its library rows for every
tile, and both meet by a shuffle on the cell, queries first. Then nothing is collected or broadcast, whichever side is the larger.
A cell holds several tiles, so that there are about as many cells' tiles as parts: what is shuffled is both tables times the square root of the
number of partitions, however many rows they have, until a cell's queries reach ``HELD_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a tile and library rows of a chunk: their product is 16 MB of scores. Bytes of queries that may be sent to all tasks.
QUERY_TILE, LIBRARY_CHUNK, BROADCAST_BYTES = 4096, 512, 32 << 20
#: Bytes of queries that a cell holds.
HELD_BYTES = 64 << 20


@dataclass
class Rows:
    """Some rows of a cell: their carried columns and their unit vectors (zero for vectors without a direction)."""

    carried: list[pa.Array]
    unit: np.ndarray

    def __len__(self) -> int:
        return len(self.unit)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column; null and zero vectors give zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    known = np.flatnonzero(sizes == sizes)  # null lists have no length
    if (sizes[known] != dim).any():
        raise ValueError(f"vectors of {sorted({int(s) for s in sizes[known]} | {dim})} entries can't be compared")
    out = np.zeros((len(column), dim))
    out[known] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


class Meeting:
    """What one tile of queries makes of the library rows that it meets: batches of a chunk, and batches at the end."""

    def __init__(self, queries: Rows):
        self.queries = queries

    def add(self, chunk: Rows) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def finish(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _cut(unit: np.ndarray, carried: list[pa.Array], size: int) -> Iterator[Rows]:
    for at in range(0, len(unit), size):
        yield Rows([c.slice(at, size) for c in carried], unit[at : at + size])


def _chunks(batch: pa.RecordBatch, vector: int, dim: int, matrix: Callable) -> Iterator[Rows]:
    yield from _cut(matrix(batch.column(vector), dim), [batch.column(i) for i in range(vector + 1, batch.num_columns)], LIBRARY_CHUNK)


def _over_cells(batches: Iterator[pa.RecordBatch], dim: int, meet: Callable[[Rows], Meeting], tile: int = QUERY_TILE, matrix: Callable = _unit) -> Iterator[pa.RecordBatch]:
    """Batches (cell, side, vector, carried) of a partition sorted by cell and side, queries (side 0) first."""
    cell, meetings, waiting = None, [], []
    for batch in batches:
        cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(cells)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if cells[lo] != cell:
                for m in meetings:
                    yield from m.finish()
                cell, meetings, waiting = cells[lo], [], []
            part = batch.slice(lo, hi - lo)
            if sides[lo] == 0:
                waiting.append(part)
                continue
            if waiting:
                held = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                tiles = _cut(matrix(held.column(2), dim), [held.column(i) for i in range(3, held.num_columns)], tile)
                meetings, waiting = [meet(t) for t in tiles], []
            if meetings:  # else no query is in this cell
                for chunk in _chunks(part, 2, dim, matrix):
                    for m in meetings:
                        yield from m.add(chunk)
    for m in meetings:
        yield from m.finish()


def multiply(queries: DataFrame, library: DataFrame, vector: str, carried: list[str], meet: Callable[[Rows], Meeting], schema: str, tile: int = QUERY_TILE, most: int | None = None, matrix: Callable = _unit, kind: str = "array<double>", order: str | None = None) -> DataFrame:
    """What ``meet`` makes of all queries and all library rows, as rows of ``schema``.

    ``carried`` are the columns of both tables that it sees, of equal types. Up to ``most`` bytes of queries are sent to all tasks. ``matrix`` makes
    rows of a matrix from lists of ``kind`` and their length: unit vectors, if not stated. With ``order``, a carried column, both sides come in its order.
    """
    spark = library.sparkSession
    v = F.col(vector).cast(kind).alias("__v")
    wide = 8 * F.coalesce(F.size(vector), F.lit(0)).cast("bigint") + sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in carried)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("dim"), F.sum(wide).alias("bytes")).first()
    dim = size["dim"] or 0
    if dim <= 0:
        return spark.createDataFrame([], schema)
    if size["bytes"] <= (BROADCAST_BYTES if most is None else most):
        table = queries.select(v, *carried).toArrow().combine_chunks()
        table = table.sort_by(order) if order else table
        sent = spark.sparkContext.broadcast(list(_cut(matrix(table.column(0).combine_chunks(), dim), [table.column(c).combine_chunks() for c in carried], tile)))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            meetings = [meet(t) for t in sent.value]
            for batch in batches:
                for chunk in _chunks(batch, 0, dim, matrix):
                    for m in meetings:
                        yield from m.add(chunk)
            for m in meetings:
                yield from m.finish()

        # a table of few files is dealt to all tasks: the work is what the queries make of its rows, not its reading
        dealt = library.select(v, *carried).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return (dealt.sortWithinPartitions(order) if order else dealt).mapInArrow(stream, schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = min(-(-size["n"] // tile), max(math.isqrt(n), -(-size["bytes"] // HELD_BYTES)))
    parts = max(1, -(-n // tiles))
    own, other = (F.pmod(F.xxhash64(*carried, vector), F.lit(k)) for k in (tiles, parts))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("__each")
    q = queries.select(own.alias("__own"), each(parts), F.lit(0).cast("tinyint").alias("__side"), v, *carried)
    rows = library.select(other.alias("__own"), each(tiles), F.lit(1).cast("tinyint").alias("__side"), v, *carried)
    cell = F.when(F.col("__side") == 0, F.col("__own") * parts + F.col("__each")).otherwise(F.col("__each") * parts + F.col("__own"))
    met = q.unionByName(rows).select(cell.alias("__cell"), "__side", "__v", *carried)
    met = met.repartitionById(n, (F.col("__cell") % n).cast("int")).sortWithinPartitions("__cell", "__side", *([order] if order else []))
    return met.mapInArrow(lambda batches: _over_cells(batches, dim, meet, tile, matrix), schema)


def top_k(queries: DataFrame, library: DataFrame, key: str, vector: str, k: int, exclude_self: bool = True, tile: int = QUERY_TILE, most: int | None = None) -> DataFrame:
    """(query, key, score, rank): for each query the ``k`` library rows of largest cosine, to 12 digits, ties by key.

    Each tile keeps ``k`` rows a query while the library streams past, and these are merged by a rank that Spark limits on both
    sides of its shuffle. Queries of equal key and vector are one. Rows without key or vector are left out on both sides; vectors
    of zeros score 0; vectors of different lengths are an error.
    """
    kind = library.schema[key].dataType.simpleString()
    schema = f"query {kind}, {key} {kind}, score double"
    text = kind == "string"

    def keys(rows: Rows) -> np.ndarray:
        found = rows.carried[0].to_numpy(zero_copy_only=False)
        return found.astype(str) if text else found

    class Best(Meeting):
        def __init__(self, queries: Rows):
            super().__init__(queries)
            self.names = keys(queries)
            self.kept = [np.empty(0, dtype=np.int64), np.empty(0), self.names[:0]]  # row of the query, score, key
            self.worst = np.full(len(queries), -np.inf)

        def add(self, chunk: Rows) -> Iterator[pa.RecordBatch]:
            own, scores = keys(chunk), np.round(self.queries.unit @ chunk.unit.T, 12)
            if exclude_self:
                scores[self.names[:, None] == own[None, :]] = -np.inf
            least = self.worst
            if scores.shape[1] > k:
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            at, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            if len(at):
                at, score, found = (np.concatenate(x) for x in zip(self.kept, (at, scores[at, col], own[col])))
                order = np.lexsort((found, -score, at))
                at, score, found = at[order], score[order], found[order]
                place = np.arange(len(at)) - np.searchsorted(at, np.arange(len(self.names)))[at]
                self.kept = [at[place < k], score[place < k], found[place < k]]
                self.worst[at[place == k - 1]] = score[place == k - 1]
            return iter(())

        def finish(self) -> Iterator[pa.RecordBatch]:
            at, score, found = self.kept
            names = [pa.array(x.tolist() if text else x) for x in (self.names[at], found)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(score)], names=["query", key, "score"])

    asked, rows = (d.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector) for d in (queries, library))
    found = multiply(asked.dropDuplicates([key, vector]), rows, vector, [key], Best, schema, tile, most)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def all_scores(queries: DataFrame, library: DataFrame, key: str, vector: str, label: str, tile: int = QUERY_TILE, most: int | None = None) -> DataFrame:
    """(query, query_label, key, label, score): the cosine of each query with every library row of another key; null without a direction."""
    types = {c: library.schema[c].dataType.simpleString() for c in (key, label)}
    schema = f"query {types[key]}, query_label {types[label]}, {key} {types[key]}, {label} {types[label]}, score double"
    names = ["query", "query_label", key, label, "score"]

    class Scores(Meeting):
        def add(self, chunk: Rows) -> Iterator[pa.RecordBatch]:
            queries = self.queries
            scores = queries.unit @ chunk.unit.T
            known = queries.unit.any(axis=1)[:, None] & chunk.unit.any(axis=1)[None, :]
            mine, own = (r.carried[0].to_numpy(zero_copy_only=False) for r in (queries, chunk))
            for lo in range(0, len(queries), 128):  # batches of bounded size
                at, col = np.nonzero(mine[lo : lo + 128, None] != own[None, :])
                at += lo
                values = pa.array(scores[at, col], mask=~known[at, col])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in queries.carried), *(c.take(pa.array(col)) for c in chunk.carried), values], names=names)

    columns = list(dict.fromkeys([key, label, vector]))
    return multiply(queries.select(*columns), library.select(*columns), vector, [key, label], Scores, schema, tile, most)
