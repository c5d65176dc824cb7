"""Joins that stay balanced when one key holds a large part of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 256
SALTS = 128
SAMPLE = 0.01
ENOUGH = 500  # sampled rows that make a key hot, some 50,000 in all


def hot_keys(df: DataFrame, key: str, sample: float = SAMPLE, enough: int = ENOUGH) -> list:
    """Keys with very many rows, at most 256 of them, from counts over a sample.

    The list only steers balance: a key it names or misses is joined all the same.
    """
    held = df.where(F.col(key).isNotNull()).select(key)
    drawn = held.sample(sample, seed=7) if sample < 1 else held
    counted = drawn.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    return [r[key] for r in counted.orderBy(F.desc("n")).limit(MOST_HOT).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salt_by: str | None = None,
                hot: list | None = None) -> DataFrame:
    """Join on ``key`` with a right side that has each key once.

    Left rows of hot keys are spread over salts, and the one right row of each hot
    key is repeated per salt. Left rows with a NULL key match nothing; they go
    along under a spread of salts as well. ``hot`` names the keys where they are
    known.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    hot = hot_keys(left, key) if hot is None else hot
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    rest = [c for c in left.columns if c != key]
    spread = F.xxhash64(salt_by) if salt_by else F.xxhash64(*rest or [key])
    salt = F.pmod(spread, F.lit(SALTS)).cast("int")
    salted = left.withColumn("_salt", F.when(F.col(key).isNull() | is_hot, salt).otherwise(F.lit(0)))
    single = right.where(F.col(key).isNotNull())
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = single.withColumn("_salt", F.explode(copies) if hot else F.lit(0))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
