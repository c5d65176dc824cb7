"""Ranks and positions over values of any ordered type: wide integers and decimals, strings, dates, timestamps.

The order (groups, score, tie) is cut into ranges by Spark's own range partitioner, which compares the typed values, so
no value passes through a double. A range is sorted once; a pass over it numbers its rows and notes where the run of
equal scores and the group of each row begin. What a range cannot know, that a run or a group began in an earlier one, is told by a
table of one row per range: its size, and its first and last row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import materialize

_DOUBLE_DIGITS = 15


def exact_as_double(kind: T.DataType) -> bool:
    """Whether different values of the type stay different as doubles."""
    if isinstance(kind, T.DecimalType):
        return kind.precision <= _DOUBLE_DIGITS
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType))


def _changes(column: pa.Array, before: pa.Scalar | None) -> pa.Array:
    """True where a value differs from the one before it; two NULLs are equal, and so are two NaNs."""
    if before is None:
        shifted = pa.concat_arrays([pa.nulls(1, column.type), column.slice(0, len(column) - 1)])
    else:
        shifted = pa.concat_arrays([pa.array([before.as_py()], column.type), column.slice(0, len(column) - 1)])
    same = pc.fill_null(pc.equal(column, shifted), False)
    same = pc.or_(same, pc.and_(pc.is_null(column, nan_is_null=True), pc.is_null(shifted, nan_is_null=True)))
    if before is None and len(same):
        same = pa.concat_arrays([pa.array([False]), same.slice(1)])
    return pc.invert(same)


def _numbered(groups: list[str], score: str, schema_names: list[str]):
    """Adds part, place in the part, and the places where the row's run of equal scores and its group begin."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, last, starts = TaskContext.get().partitionId(), 0, None, [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = {c: batch.column(schema_names.index(c)) for c in [*groups, score]}
            group = np.zeros(n, dtype=bool)
            if last is None:
                group[0] = True
            for c in groups:
                group |= _changes(of[c], last and last[c]).to_numpy(zero_copy_only=False)
            value = group | _changes(of[score], last and last[score]).to_numpy(zero_copy_only=False)
            places, out = np.arange(seen, seen + n), []
            for k, change in enumerate((value, group)):
                begun = np.maximum.accumulate(np.where(change, places, starts[k]))
                out.append(begun)
                starts[k] = int(begun[-1])
            last, seen = {c: of[c][n - 1] for c in of}, seen + n
            extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(places), pa.array(out[0]), pa.array(out[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*schema_names, "_part", "_place", "_run", "_group"])
    return run


def ranked_typed(df: DataFrame, score: str, tie: str, groups: Sequence[str] = (), *, rank: str | None = None,
                 position: str | None = None, descending: bool = True, ranges: int | None = None) -> DataFrame:
    """As :func:`gleaner.operators.ordering.ranked`, for a score and a tie column of any ordered type.

    A NULL group is a group. One shuffle; the sorted rows are stored, because ranges are found anew in every run of a plan.
    """
    groups = list(groups)
    kept = [c for c in df.columns if c not in (rank, position)]
    by_score = F.desc_nulls_last(score) if descending else F.asc_nulls_last(score)
    order = [*[F.asc(g) for g in groups], by_score, F.asc(tie)]
    parts = ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*kept).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_part", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("_place", "_run", "_group")]])
    held = materialize(ordered.mapInArrow(_numbered(groups, score, kept), schema), "typed-order")

    key = F.struct(*groups, score)
    ends = held.groupBy("_part").agg(
        F.max("_place").alias("_last"), F.min_by(key, "_place").alias("_first_key"), F.max_by(key, "_place").alias("_last_key"),
        F.max_by("_run", "_place").alias("_last_run"), F.max_by("_group", "_place").alias("_last_group"))
    # One row per range from here on.
    line = Window.orderBy("_part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_ahead", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)))
    previous = F.lag("_last_key").over(line)
    same_group = F.lit(True)
    for g in groups:
        same_group = same_group & F.col(f"_first_key.{g}").eqNullSafe(previous[g])
    ends = ends.withColumn("_on_group", F.lag("_part").over(line).isNotNull() & same_group)
    ends = ends.withColumn("_on_run", F.col("_on_group") & F.col(f"_first_key.{score}").eqNullSafe(previous[score]))
    for name in ("run", "group"):
        # Where a range's last run begins, unless it came in from the range before.
        begins = F.when(~((F.col(f"_last_{name}") == 0) & F.col(f"_on_{name}")), F.col("_ahead") + F.col(f"_last_{name}"))
        ends = ends.withColumn(f"_begins_{name}", begins)
        ends = ends.withColumn(f"_from_{name}", F.when(F.col(f"_on_{name}"), F.last(f"_begins_{name}", ignorenulls=True).over(before)))
    ends = F.broadcast(ends.select("_part", "_ahead", "_from_run", "_from_group"))

    out = held.join(ends, "_part")
    start = {name: F.when(F.col(f"_{name}") == 0, F.coalesce(f"_from_{name}", "_ahead")).otherwise(F.col("_ahead") + F.col(f"_{name}"))
             for name in ("run", "group")}
    scored = F.col(score).isNotNull()
    columns = [F.col(c) for c in kept]
    if rank:
        columns.append(F.when(scored, start["run"] - start["group"] + 1).alias(rank))
    if position:
        columns.append(F.when(scored, F.col("_ahead") + F.col("_place") - start["group"] + 1).alias(position))
    return out.select(*columns)
