"""Comparison of models and configurations over their fold metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.distributions import NORMAL_975
from gleaner.operators.confusion import ratio
from gleaner.operators.ordering import Splits, find_splits, join_groups, quantiles
from gleaner.operators.scores import scale


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form: one row per id and metric."""
    doubles = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(ids), list(metrics), "metric", "value")


def mean_metrics(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], digits: int | None = 4) -> DataFrame:
    """Mean of each metric over folds."""
    def shown(m: str):
        return F.avg(m) if digits is None else F.round(F.avg(m), digits)
    return df.groupBy(*groups).agg(*[shown(m).alias(m) for m in metrics])


def describe(df: DataFrame, groups: Sequence[str], metric: str) -> DataFrame:
    """Count, mean, sample std, min and max."""
    return df.groupBy(*groups).agg(
        F.count(metric).alias("count"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.min(metric).alias("min"), F.max(metric).alias("max"))


def mean_interval(df: DataFrame, groups: Sequence[str], metric: str, divisor: int | None = None) -> DataFrame:
    """Mean with its normal 95 % interval.

    The standard error divides by the root of the number of values, or of
    ``divisor`` where one is given.
    """
    n = F.count(metric) if divisor is None else F.lit(divisor)
    half = F.lit(NORMAL_975) * F.stddev_samp(metric) / F.sqrt(n)
    return df.groupBy(*groups).agg(F.avg(metric).alias("mean"), (F.avg(metric) - half).alias("ci_low"),
                                   (F.avg(metric) + half).alias("ci_high"))


def best_by_mean(df: DataFrame, config: Sequence[str], candidate: Sequence[str], metric: str) -> DataFrame:
    """Candidate with the highest mean metric in each configuration; ties by name."""
    means = df.groupBy(*config, *candidate).agg(F.avg(metric).alias("mean_score"),
                                                F.stddev_samp(metric).alias("std_score"))
    place = F.row_number().over(Window.partitionBy(*config).orderBy(
        F.desc_nulls_last("mean_score"), *[F.asc(c) for c in candidate]))
    return means.withColumn("_place", place).where("_place = 1").drop("_place")


def best_row(df: DataFrame, groups: Sequence[str], metric: str, tie: Sequence[str]) -> DataFrame:
    """Row with the highest metric in each group."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(
        F.desc_nulls_last(metric), *[F.asc(t) for t in tie]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def leaderboard(df: DataFrame, metric: str, tie: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best rows by metric."""
    return df.orderBy(F.desc_nulls_last(metric), *[F.asc(t) for t in tie]).limit(n)


def condition_difference(long: DataFrame, groups: Sequence[str], condition: str, base, other) -> DataFrame:
    """Mean under two conditions, their difference and change in percent, per group."""
    is_base, is_other = F.col(condition) == base, F.col(condition) == other
    out = long.where(is_base | is_other).groupBy(*groups).agg(
        *[f(F.when(cond, F.col("value"))).alias(f"{stat}_{side}")
          for side, cond in (("base", is_base), ("other", is_other))
          for stat, f in (("mean", F.avg), ("std", F.stddev_samp))])
    difference = F.col("mean_other") - F.col("mean_base")
    return out.withColumn("difference", difference).withColumn(
        "change_pct", ratio(100 * difference, F.col("mean_base"), None))


def improvement_matrix(differences: DataFrame, row: str, metrics: Sequence[str]) -> DataFrame:
    """Change in percent as a row x metric table."""
    return differences.groupBy(row).pivot("metric", list(metrics)).agg(F.first("change_pct"))


def fold_matrix(df: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """Fold x model table of a metric."""
    return df.groupBy("fold").pivot("model", list(models)).agg(F.avg(metric))


def box_summary(df: DataFrame, groups: Sequence[str], value: str = "value",
                splits: Splits | None = None) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 quartile ranges, mean, and outlier count."""
    splits = splits or find_splits(df, value)
    keys = list(groups)
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value"))
               .agg(F.count("*").alias("_n")))
    cuts = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, splits=splits)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_value").between(F.col("q1") - reach, F.col("q3") + reach)
    return join_groups(counted, cuts, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_value"))).alias("whisker_high"),
        (F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.sum("_n").alias("n"), F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("outliers"))


# --- search trials ----------------------------------------------------------

def final_per_trial(trials: DataFrame, metric: str, trial: str = "trial_id",
                    iteration: str = "training_iteration") -> DataFrame:
    """Last reported metric of every trial."""
    return trials.groupBy(trial).agg(F.max_by(metric, iteration).alias(metric),
                                     F.max(iteration).alias(iteration))


def best_trial(trials: DataFrame, metric: str, trial: str = "trial_id",
               iteration: str = "training_iteration", mode: str = "max") -> DataFrame:
    """Trial whose last metric is best; ties by trial name."""
    last = final_per_trial(trials, metric, trial, iteration)
    order = F.desc_nulls_last(metric) if mode == "max" else F.asc_nulls_last(metric)
    return last.orderBy(order, F.asc(trial)).limit(1)


def metric_by_cell(trials: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    return trials.groupBy(*params).agg(F.avg(metric).alias(metric), F.count("*").alias("n"))


def normalized_metric(trials: DataFrame, metric: str, params: Sequence[str]) -> DataFrame:
    """Metric scaled to 0..1 over all complete rows; the bounds are scalar subqueries."""
    complete = trials.na.drop(subset=[*params, metric])
    low = complete.agg(F.min(metric)).scalar()
    high = complete.agg(F.max(metric)).scalar()
    return complete.withColumn(metric, scale(F.col(metric), low, high))


def loss_by_epoch(log: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Mean training and validation loss per epoch from log rows that hold either."""
    return log.groupBy(epoch).agg(F.avg("loss").alias("loss"), F.avg("eval_loss").alias("eval_loss"))
