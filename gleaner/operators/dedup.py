"""Required columns, keep-first duplicates and label conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every named column has a value."""
    return df.na.drop(subset=list(columns))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key.

    Spark limits each key to one row per input partition before the shuffle, so
    a key with a third of all rows sends no more than one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def cascade_survivors(df: DataFrame, id_: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Identifiers left after keep-first on each column in turn.

    A pass sees only what the passes before it left, and drops rows whose column
    is NULL, so the passes cannot be swapped. Only digests travel.
    """
    slim = df.select(id_, *[c for c in order if c != id_], *[F.md5(c).alias(f"_d_{c}") for c in columns])
    for c in columns:
        slim = keep_first(slim.where(F.col(f"_d_{c}").isNotNull()), [f"_d_{c}"], list(order))
    return slim.select(id_)


def clean_corpus(df: DataFrame, id_: str = "id", order: Sequence[str] = ("priority", "id"),
                 required: Sequence[str] = ("title", "abstract", "Keywords", "labels"),
                 columns: Sequence[str] = ("title", "abstract", "doi")) -> DataFrame:
    """Drop incomplete rows, then duplicates by title, abstract and doi, curated rows first.

    The full rows meet the surviving identifiers in one join at the end.
    """
    complete = require(df, required)
    return complete.join(cascade_survivors(complete, id_, columns, order), id_, "left_semi")


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that carry more than one label."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.countDistinct(label).alias("n_labels")).where("n_labels > 1"))


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """One row: how many records share their key with another, and how many keys that is."""
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"))


def cascade_audit(df: DataFrame, id_: str, label: str, columns: Sequence[str] = ("title", "abstract", "doi"),
                  order: Sequence[str] = ("priority", "id")) -> DataFrame:
    """Per pass of the cascade: rows in, rows in duplicates, label conflicts, rows out."""
    slim = df.select(id_, label, *[c for c in order if c not in (id_, label)],
                     *[F.md5(c).alias(f"_d_{c}") for c in columns])
    steps = []
    for number, c in enumerate(columns):
        key = f"_d_{c}"
        slim = slim.where(F.col(key).isNotNull())
        per_key = slim.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"))
        steps.append(per_key.agg(
            F.lit(number).alias("step"), F.lit(c).alias("key"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
            F.count_if(F.col("k") > 1).alias("conflicts"), F.count("*").alias("rows_out")))
        slim = keep_first(slim, [key], list(order))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out
