"""Seeded orders, samples and splits that give the same rows in every run.

Random order is the order of ``md5(seed:id)``. The digest is uniform, so its
first digits cut any table into even ranges whatever the labels look like.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 3  # 16^3 ranges per group


def seeded_key(id_: Column, *seed: Column | int | str) -> Column:
    """Digest of seed parts and identifier, joined by colons."""
    parts = [s if isinstance(s, Column) else F.lit(str(s)) for s in seed]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], id_.cast("string")))


def seeded_position(df: DataFrame, id_: str, seed: Column | int, groups: Sequence[str] = (),
                    name: str = "position", prefix: int = PREFIX) -> DataFrame:
    """Exact place 1..n of each row in the seeded order of its group."""
    seed_parts = seed if isinstance(seed, (list, tuple)) else [seed]
    keyed = df.withColumn("_key", seeded_key(F.col(id_), *seed_parts))
    keyed = keyed.withColumn("_range", F.substring("_key", 1, prefix))
    keys = [*groups, "_range"]
    before = (Window.partitionBy(*groups).orderBy("_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    cells = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    cells = cells.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("_key", id_))
    placed = keyed.join(cells.hint("shuffle_hash"), keys).withColumn(name, (F.col("_ahead") + local).cast("bigint"))
    return placed.select(*[c for c in df.columns if c != name], name)


def sample_exact(df: DataFrame, n: int, id_: str, seed: int, prefix: int = PREFIX) -> DataFrame:
    """Exactly ``n`` rows, or all when there are fewer.

    Ranges that lie wholly past the cut are dropped before any row moves. The
    list of kept ranges has at most 16^prefix rows, so it may be broadcast.
    """
    keyed = df.withColumn("_key", seeded_key(F.col(id_), seed))
    keyed = keyed.withColumn("_range", F.substring("_key", 1, prefix))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_upto", F.sum("_n").over(upto))
    cells = cells.select("_range", (F.col("_upto") - F.col("_n")).alias("_ahead")).where(F.col("_ahead") < n)
    local = F.row_number().over(Window.partitionBy("_range").orderBy("_key", id_))
    kept = keyed.join(F.broadcast(cells), "_range").where(F.col("_ahead") < n)
    kept = kept.withColumn("_place", F.col("_ahead") + local).where(F.col("_place") <= n)
    return kept.select(*df.columns)


def seeded_shuffle(df: DataFrame, id_: str, seed: int) -> DataFrame:
    """All rows in seeded order; Spark range-partitions on the even digest."""
    return df.orderBy(seeded_key(F.col(id_), seed), F.col(id_))


def undersample(df: DataFrame, label: str, id_: str, coefficient: int, seed: int) -> DataFrame:
    """All positives with at most ``coefficient`` negatives for each, drawn by seed.

    Negatives stay whole while they do not outnumber the positives.
    """
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    positives, negatives = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    if counts["neg"] > counts["pos"]:
        negatives = sample_exact(negatives, coefficient * counts["pos"], id_, seed)
    return positives.unionByName(negatives)
