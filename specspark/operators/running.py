"""Running sums and maxima over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import Rounds


def value_range(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add ``out``: the place from 0 of the value range that ``order`` lies in; nulls lie in the first, NaN in the last.

    There are at most as many ranges as shuffle partitions, cut at the table's quantiles; only these cuts come to the driver,
    and they are fixed there, so that all later steps deal rows alike. ``order`` is a number, date or time.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = df.select(F.percentile_approx(order, shares, 100 * n).alias("q")).first()["q"] or []
    lower = F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(order)) if cuts else F.array()
    return df.withColumn(out, F.size(lower))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: what made it runs once, however often it is read."""
    return Rounds(df.sparkSession, "settled").keep(df)


def before(df: DataFrame, order: str, folds: dict[str, tuple[str, str]], by: list[str] = (), descending: bool = False, written: bool = False) -> DataFrame:
    """Add for each out: (fold, column) of ``folds`` the fold of the column over the group's earlier rows.

    ``fold`` is sum (0 if there are none) or max (null if there are none). Rows are ordered inside value ranges; one row for
    each group and range carries what the ranges before hold. Rows of equal ``order`` follow each other in any order. ``df`` is read three times, so it
    is written first unless it is ``written`` already.
    """
    df = df if written else settled(df)
    fold = {"sum": F.sum, "max": F.max}
    dealt = value_range(df, order, "__range")
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    parts = dealt.groupBy(*by, "__range").agg(*[fold[f](c).alias(f"__{out}") for out, (f, c) in folds.items()])
    earlier = Window.partitionBy(*by).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__r"), *[fold[f](f"__{out}").over(earlier).alias(f"__{out}") for out, (f, _) in folds.items()])
    same = F.col("__range") == F.col("__r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = Window.partitionBy(*by, "__range").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *[fold[f](c).over(inside).alias(f"__in_{out}") for out, (f, c) in folds.items()]).join(heads, same)
    outs = [
        (F.coalesce(f"__in_{out}", F.lit(0)) + F.coalesce(f"__{out}", F.lit(0)) if f == "sum" else F.greatest(f"__in_{out}", f"__{out}")).alias(out)
        for out, (f, _) in folds.items()
    ]
    return rows.select(*df.columns, *outs)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, a column for each name of ``shares``): exact percentiles, interpolated, nulls left out; no row for a group without values.

    Values are counted by a shuffled aggregate and numbered by ``before``, so that no task holds the distinct values of a group.
    """
    counts = settled(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
    rows = before(counts, "__v", {"__less": ("sum", "__n")}, by, written=True)
    totals = counts.groupBy(*by).agg((F.sum("__n") - 1).alias("__last")).select(*[F.col(c).alias(f"__of_{c}") for c in by], "__last")
    rows = rows.join(F.broadcast(totals), _same(by)) if by else rows.crossJoin(F.broadcast(totals))
    at = lambda place: F.max(F.when((F.col("__less") <= place) & (place < F.col("__less") + F.col("__n")), F.col("__v").cast("double")))
    place = {n: F.lit(p) * F.col("__last") for n, p in shares.items()}
    found = rows.groupBy(*by).agg(F.max("__last").alias("__last"), *[x for n, p in place.items() for x in (at(F.floor(p)).alias(f"__a_{n}"), at(F.ceil(p)).alias(f"__b_{n}"))])
    mixed = lambda n, p: F.when(F.floor(p) == F.ceil(p), F.col(f"__a_{n}")).otherwise((F.ceil(p) - p) * F.col(f"__a_{n}") + (p - F.floor(p)) * F.col(f"__b_{n}"))
    return found.select(*by, *[mixed(n, p).alias(n) for n, p in place.items()])


def with_percentiles(groups: DataFrame, df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``groups``, a row for each group of ``df`` by ``by``, with its ``percentiles``; null where a group has no values."""
    found = percentiles(df, value, shares, by).select(*[F.col(c).alias(f"__of_{c}") for c in by], *shares)
    return groups.join(found, _same(by), "left").select(*groups.columns, *shares) if by else groups.crossJoin(found)


def _same(by: list[str]):
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return same
