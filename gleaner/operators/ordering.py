"""Ranks, positions and running sums over an order that spans the whole table.

A window without a partition, or over one label that holds half of all rows,
would run in one task. Here the order is cut into value ranges first:

1. split points are taken from an approximate quantile pass over the column;
   they are literals afterwards, so a recomputed task buckets its rows alike;
2. each range is counted, and a window over that small table gives every range
   its offset;
3. ranks inside a range are local windows, joined with the offset on the same
   keys, so join and window share one shuffle.

A value that fills several quantiles gets a range of its own, which is cut
further by the tie column. Split points only decide balance; the result is
exact wherever they fall.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.typed_order import exact_as_double, ranked_typed

MAX_RANGES = 8192


def default_ranges(df: DataFrame) -> int:
    """A few ranges for every shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(MAX_RANGES, 2 * partitions))


@dataclass(frozen=True)
class Splits:
    """Inner split points of a value, and of the tie column that orders equal values."""

    values: tuple[float, ...]
    shares: tuple[int, ...]  # quantiles that fall into each range, 1 at least
    ties: tuple[float, ...]

    @property
    def ranges(self) -> int:
        return len(self.ties) + 1


def find_splits(df: DataFrame, value: str, tie: str | None = None, ranges: int | None = None) -> Splits:
    """Split points from one pass that reads only the named columns."""
    ranges = ranges or default_ranges(df)
    if ranges < 2:
        return Splits((), (1,), ())
    probabilities = [i / ranges for i in range(1, ranges)]
    columns = [F.col(value).cast("double").alias("v")]
    columns += [F.col(tie).cast("double").alias("t")] if tie else []
    names = ["v", "t"] if tie else ["v"]
    found = df.select(*columns).approxQuantile(names, probabilities, 1 / (2 * ranges))
    points: dict[float, int] = {}
    for q in found[0]:
        if math.isfinite(q):
            points[q + 0.0] = points.get(q + 0.0, 0) + 1
    values, shares = [], [1]
    for q, times in sorted(points.items()):
        if values and values[-1] == q:
            shares[-1] = times
        else:
            values.append(q)
            shares.append(times)
        if times > 1:  # close the range right above the value
            values.append(math.nextafter(q, math.inf))
            shares.append(1)
    ties = tuple(sorted({t + 0.0 for t in found[1]})) if tie else ()
    return Splits(tuple(values), tuple(shares), ties)


def _range_number(df: DataFrame, column: Column, points: Sequence[float], name: str) -> DataFrame:
    """Number of split points that are not above the column, by binary search."""
    if not points:
        return df.withColumn(name, F.lit(0))
    source = f"{name}_source"
    bucketizer = Bucketizer(splits=[-math.inf, *points, math.inf], inputCol=source, outputCol=name)
    return (bucketizer.transform(df.withColumn(source, column))
            .withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(0))).drop(source))


def _plain(value: str) -> Column:
    """The value as a double with one zero and without NaN."""
    as_double = F.col(value).cast("double") + F.lit(0.0)
    return F.when(F.isnan(as_double), F.lit(None)).otherwise(as_double)


def present(names: Sequence[str]) -> Column:
    """True where every named column has a value.

    Stated on both sides of a later join, it keeps the plans below them equal,
    and Spark then runs their common shuffle once.
    """
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).isNotNull()
    return out


def with_group(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The group columns as one struct, which joins equal NULLs, and the keys to group by."""
    return (df.withColumn("_g", F.struct(*groups)), ["_g"]) if groups else (df, [])


def join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns that may be NULL; the columns stay on the left."""
    left, keys = with_group(left, groups)
    right, _ = with_group(right, groups)
    return left.join(right.drop(*groups), keys, how).drop(*keys)


def _ordered(names: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(n) if descending else F.asc(n) for n in names]


def with_cells(df: DataFrame, score: str, tie: str, splits: Splits) -> DataFrame:
    """Add the cell ``(_vr, _tr)`` of every row and the ``_share`` of its range.

    A range of several quantiles holds one value and is cut by the tie column into
    as many cells; unscored rows, range -1, are cut into all of them.
    """
    out = _range_number(df, F.coalesce(_plain(score), F.lit(0.0)), splits.values, "_vr")
    out = _range_number(out, F.col(tie).cast("double"), splits.ties, "_tr")
    scored = _plain(score).isNotNull()
    share = F.when(scored, F.get(F.lit(np.array(splits.shares)), F.col("_vr"))).otherwise(F.lit(splits.ranges))
    return (out.withColumn("_share", share)
            .withColumn("_vr", F.when(scored, F.col("_vr")).otherwise(F.lit(-1)))
            .withColumn("_tr", F.floor(F.col("_tr") * F.col("_share") / splits.ranges).cast("int")))


def ranked(df: DataFrame, score: str, tie: str, groups: Sequence[str] = (), *, rank: str | None = None,
           position: str | None = None, descending: bool = True, ranges: int | None = None,
           splits: Splits | None = None) -> DataFrame:
    """Add the rank of ``score`` inside each group, over any number of rows.

    ``rank`` gives ties their lowest rank; ``position`` counts 1..n with ties in
    the order of the unique column ``tie``. Rows without a score keep NULL; a NULL
    group is a group. The input is read three times, so a score that is costly to
    compute should be stored first. Values that doubles cannot tell apart, or that
    are no numbers, are ordered by :mod:`gleaner.operators.typed_order`.
    """
    groups = list(groups)
    if splits is None and not (exact_as_double(df.schema[score].dataType) and isinstance(df.schema[tie].dataType, T.NumericType)):
        return ranked_typed(df, score, tie, groups, rank=rank, position=position, descending=descending, ranges=ranges)
    splits = splits or find_splits(df, score, tie, ranges)
    scored = _plain(score).isNotNull()
    out, held = with_group(with_cells(df, score, tie, splits), groups)
    cells = out.where("_vr >= 0").groupBy(*held, "_vr", "_tr").agg(F.count("*").alias("_n"))
    order = [*_ordered(["_vr"], descending), F.asc("_tr")]
    ahead = Window.partitionBy(*held).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    start = Window.partitionBy(*held, "_vr")
    cells = cells.withColumn("_start", F.min("_ahead").over(start)).drop("_n")

    keys = [*held, "_vr", "_tr"]
    joined = out.join(cells.hint("shuffle_hash"), keys, "left")
    local = Window.partitionBy(*keys)
    by_score = _ordered([score], descending)
    if rank:
        inner = F.when(F.col("_share") > 1, F.col("_start") + 1).otherwise(
            F.col("_ahead") + F.rank().over(local.orderBy(*by_score)))
        joined = joined.withColumn(rank, F.when(scored, inner).cast("bigint"))
    if position:
        inner = F.col("_ahead") + F.row_number().over(local.orderBy(*by_score, F.asc(tie)))
        joined = joined.withColumn(position, F.when(scored, inner).cast("bigint"))
    kept = [c for c in (rank, position) if c]
    return joined.select(*[c for c in df.columns if c not in kept], *kept)


def running_sums(weights: DataFrame, value: str, sums: Sequence[str], groups: Sequence[str] = (), *,
                 splits: Splits, descending: bool = True, ahead: Sequence[str] = ()) -> DataFrame:
    """Running and total sums over distinct values, one input row per group and value.

    Adds ``cum_<c>`` (up to and including the row) and ``all_<c>`` (whole group)
    for each column of ``sums``, and ``next_<c>`` for each column of ``ahead``:
    its value on the following row of the group, NULL on the last. A NULL group is a group.
    """
    out = _range_number(weights.where(present([value])), _plain(value), splits.values, "_vr")
    out, groups = with_group(out, groups)
    first = F.min_by if not descending else F.max_by
    cells = out.groupBy(*groups, "_vr").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums],
        *[first(c, value).alias(f"_f_{c}") for c in ahead])
    by_range = Window.partitionBy(*groups).orderBy(*_ordered(["_vr"], descending))
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    cells = cells.select(
        *groups, "_vr",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in sums],
        *[F.lead(f"_f_{c}").over(by_range).alias(f"_l_{c}") for c in ahead])
    keys = [*groups, "_vr"]
    joined = out.join(cells.hint("shuffle_hash"), keys)
    local = Window.partitionBy(*keys).orderBy(*_ordered([value], descending))
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *weights.columns,
        *[(F.col(f"_o_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
        *[F.coalesce(F.lead(c).over(local), F.col(f"_l_{c}")).alias(f"next_{c}") for c in ahead])


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], groups: Sequence[str] = (), *,
              splits: Splits | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probabilities`` maps result columns to probabilities. Values are counted
    before they are ordered, and only the rows at the wanted places go on.
    """
    splits = splits or find_splits(df, value)
    groups = list(groups)
    counted = (df.select(*groups, _plain(value).alias("_value")).where(present(["_value"]))
               .groupBy(*groups, "_value").agg(F.count("*").alias("_n")))
    placed = running_sums(counted, "_value", ["_n"], groups, splits=splits, descending=False)
    n, upto = F.col("all__n"), F.col("cum__n")
    aggregates = [F.max("all__n").alias("_all")]
    for i, p in enumerate(probabilities.values()):
        place = (n - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (index >= upto - F.col("_n")) & (index < upto)
            aggregates.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*groups).agg(*aggregates)
    columns = []
    for i, (name, p) in enumerate(probabilities.items()):
        place = (F.col("_all") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        columns.append((F.col(f"_lo{i}") + part * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name))
    return found.select(*groups, *columns)
