"""Tables keyed by an identifier, kept in hash buckets so that a batch touches only the buckets it falls into.

A store is a Parquet folder partitioned by ``bucket_of`` its identifier. Adding a batch reads the identifiers of the
batch's buckets, not of the table; replacing rewrites those buckets' files by dynamic partition overwrite and leaves all
others as they are. Files of a rewrite are staged and moved in when the job commits, so a failed rewrite leaves the stored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import gathered, materialize

BUCKETS = 64
#: Partition column of the files; ``read_store`` hides it.
BUCKET = "_bucket"
_LAYOUT = "_layout"


def bucket_of(id_: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _layout(spark: SparkSession, path: str, id_: str, buckets: int | None) -> tuple[int, bool]:
    """Buckets of the store, from the note written when it was made, and whether it was there."""
    try:
        noted = spark.read.schema("id string, buckets int").parquet(f"{path}/{_LAYOUT}").first()
    except AnalysisException as error:
        if not _missing(error):
            raise
        made = buckets or BUCKETS
        spark.createDataFrame([(id_, made)], "id string, buckets int").coalesce(1).write.parquet(f"{path}/{_LAYOUT}")
        return made, False
    if noted["id"] != id_ or (buckets and buckets != noted["buckets"]):
        raise ValueError(f"{path} is keyed by {noted['id']} in {noted['buckets']} buckets")
    return noted["buckets"], True


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    wide = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    try:
        return spark.read.schema(wide).parquet(path)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise


def read_store(spark: SparkSession, path: str, schema: T.StructType | None = None, ids: Sequence | None = None,
               id_: str | None = None) -> DataFrame:
    """Rows of a store; with ``ids`` only those identifiers, from their buckets' files alone."""
    rows = (spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])) if schema else spark.read).parquet(path)
    if ids is not None:
        wanted = F.col(id_).isin(list(ids))
        made, _ = _layout(spark, path, id_, None)
        key = spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(id_, rows.schema[id_].dataType)]))
        buckets = [r[0] for r in key.select(bucket_of(id_, made)).distinct().collect()]
        rows = rows.where(F.col(BUCKET).isin(buckets) & wanted)
    return rows.drop(BUCKET)


def one_per_id(rows: DataFrame, id_: str, order: str | Column | None = None, latest: bool = True) -> DataFrame:
    """One row per identifier: the one with the greatest (or least) ``order``, equal ones by a hash of the row.

    Rows without an identifier are left out. The choice does not depend on partitions; a NULL order comes first.
    """
    held = rows.where(F.col(f"`{id_}`").isNotNull())
    names = [F.col(f"`{c}`") for c in rows.columns]
    at = order if isinstance(order, Column) else F.col(order) if order else F.lit(0)
    key = F.struct(at.alias("at"), F.xxhash64(F.to_json(F.struct(*names))).alias("tie"))
    pick = (F.max_by if latest else F.min_by)(F.struct(*names), key)
    return held.groupBy(F.col(f"`{id_}`").alias("__id")).agg(pick.alias("__row")).select("__row.*")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    gathered(rows, BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def ingest(arrivals: DataFrame, path: str, id_: str, overwrite: bool = False, buckets: int | None = None,
           order: str | Column | None = None) -> None:
    """Store a batch: identifiers not stored yet are added; with ``overwrite`` the batch's rows replace stored ones.

    Among a batch's repeats the greatest ``order`` stays where rows replace, the least where the first counts. A store
    has one writer at a time, as any table of plain files.
    """
    spark = arrivals.sparkSession
    made, _ = _layout(spark, path, id_, buckets)
    fresh = one_per_id(arrivals, id_, order, latest=overwrite).select(*[F.col(f"`{c}`") for c in arrivals.columns])
    fresh = materialize(fresh.withColumn(BUCKET, bucket_of(id_, made)), "arrived")
    stored = _rows(spark, path, arrivals.schema)
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most one per bucket
    if not touched:
        return
    if stored is not None:
        held = stored.where(F.col(BUCKET).isin(touched))
        keys = [id_, BUCKET]  # the bucket as a key keeps both sides' rows of a bucket together
        if overwrite:
            kept = held.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns)
            _write(kept.unionByName(fresh), path, "overwrite")
            return
        fresh = fresh.join(held.select(*keys), keys, "left_anti").select(*fresh.columns)
    _write(fresh, path, "append")
