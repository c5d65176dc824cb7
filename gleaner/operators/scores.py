"""Ensembles over score rows, score summaries, filters and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.ensemble import consensus
from gleaner.functions.labels import decision, ranking_band, relevance_band
from gleaner.operators.ordering import Splits, find_splits, join_groups, quantiles
from gleaner.session import materialize


def ensemble_rows(scores: DataFrame, keys: Sequence[str], score: str = "score", fold: str = "fold",
                  threshold: float = 0.5) -> DataFrame:
    """Ensemble statistics per record from one row per fold score."""
    positive, n = F.count_if(F.col(score) > threshold), F.count(score)
    out = scores.groupBy(*keys).agg(
        F.avg(score).alias("ensemble_score"), F.stddev_pop(score).alias("std_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        positive.alias("positive_folds"), consensus(positive, n).alias("consensus_strength"),
        F.transform(F.array_sort(F.collect_list(F.struct(fold, score))), lambda s: s[score]).alias("fold_scores"))
    return out.withColumn("ensemble_prediction", decision(F.col("ensemble_score"), threshold))


def ensemble_models(predictions: DataFrame, keys: Sequence[str], models: int, model: str = "model",
                    score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Mean score over models per record; the job fails if any record lacks a model."""
    out = predictions.groupBy(*keys).agg(F.avg(score).alias("score"), F.max("label").alias("label"),
                                         F.countDistinct(model).alias("n_models"))
    complete = F.assert_true(F.col("n_models") == models, F.lit(f"a record has not been scored by {models} models"))
    out = out.where(complete.isNull())
    return out.withColumn("prediction", decision(F.col("score"), threshold))


def score_summary(df: DataFrame, score: str, groups: Sequence[str] = (), *, population: bool = True,
                  band=relevance_band, splits: Splits | None = None) -> DataFrame:
    """Mean, std, range, quartiles, count and three band counts per group.

    ``population`` picks the divisor of the standard deviation.
    """
    value = F.col(score).cast("double")
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    level = band(value)
    keyed = df if groups else df.withColumn("_whole", F.lit(1))
    keys = list(groups) or ["_whole"]
    plain = keyed.where(value.isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("count"), *[F.count_if(level == b).alias(f"{b}_count") for b in ("high", "medium", "low")])
    cuts = quantiles(keyed, score, {"q25": 0.25, "median": 0.5, "q75": 0.75}, keys, splits=splits)
    # Both tables have one row per group; stacking them needs no join.
    both = plain.unionByName(cuts, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys]).drop("_whole")


def ranking_summary(df: DataFrame, score: str, rank: str, groups: Sequence[str]) -> DataFrame:
    """Score and rank statistics per class, sample standard deviation.

    Reads its input several times, so the three columns it needs are written once.
    """
    held = materialize(df.select(*groups, score, rank), "ranking")
    by_score, by_rank = find_splits(held, score), find_splits(held, rank)
    scores = score_summary(held, score, groups, population=False, band=ranking_band, splits=by_score)
    ranks = held.groupBy(*groups).agg(F.min(rank).alias("rank_min"), F.max(rank).alias("rank_max"),
                                      F.avg(rank).alias("rank_mean"))
    middle = quantiles(held, rank, {"rank_median": 0.5}, groups, splits=by_rank)
    return join_groups(join_groups(scores, ranks, groups), middle, groups)


def batch_kpis(df: DataFrame, score: str = "ensemble_score") -> DataFrame:
    """Records, relevant ones, mean and highest score of a scored batch; 0 where nothing was scored."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(score) >= 0.6).alias("high_relevance"),
                  F.coalesce(F.avg(score), F.lit(0.0)).alias("average_score"),
                  F.coalesce(F.max(score), F.lit(0.0)).alias("highest_score"))


def score_between(df: DataFrame, score: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.where(F.col(score).between(low, high))


def at_least(df: DataFrame, score: str, low: float) -> DataFrame:
    """Rows at or above ``low``; unscored rows stay."""
    return df.where(F.col(score).isNull() | (F.col(score) >= low))


def by_score(df: DataFrame, score: str, tie: str, ascending: bool = False) -> DataFrame:
    """Sorted by score, unscored rows last either way."""
    order = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    return df.orderBy(order, F.asc(tie))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int,
              groups: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins of [low, high]; the upper edge belongs to the last bin."""
    number = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)),
                     F.lit(bins).cast("bigint"))
    held = df.where(F.col(value).between(low, high)).select(*groups, number.alias("bin"))
    width = (high - low) / bins
    return held.groupBy(*groups, "bin").agg(F.count("*").alias("n")).withColumn(
        "bin_start", F.lit(float(low)) + (F.col("bin") - 1) * F.lit(width))


def merge_scores(records: DataFrame, scored: DataFrame, id_: str) -> DataFrame:
    """Every input record with its scores, NULL where it was not scored."""
    return records.join(scored, id_, "left")


def scale(value: Column, low: Column, high: Column) -> Column:
    """Min-max normalisation; NULL where all values are equal."""
    return F.when(high > low, (value - low) / (high - low))
