"""Exact, tie-aware ROC, precision-recall and gain figures per group.

Predictions are first counted per group and distinct score, which collapses
ties on the map side. All curves come from one running sum over that table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import confusion as cm
from gleaner.operators.ordering import Splits, find_splits, join_groups, present, running_sums

EXACT_POSITIONS = 256
INFINITE = float("inf")


def score_counts(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per group and distinct score."""
    plain = F.col(score).cast("double") + F.lit(0.0)
    return (df.where(present([score]) & F.col(label).isin(0, 1))
            .groupBy(*groups, plain.alias("score"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def curve_table(counts: DataFrame, groups: Sequence[str], splits: Splits) -> DataFrame:
    """One row per group and distinct score with the counts at or above it."""
    table = running_sums(counts, "score", ["pos", "neg"], groups, splits=splits, ahead=["pos", "neg"])
    return table.select(
        *groups, "score", "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        (F.col("all_pos") - F.col("cum_pos")).alias("fn"), (F.col("all_neg") - F.col("cum_neg")).alias("tn"),
        F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"),
        F.col("next_pos"), F.col("next_neg"))


def curves(df: DataFrame, label: str, score: str, groups: Sequence[str] = (),
           splits: Splits | None = None) -> DataFrame:
    splits = splits or find_splits(df, score)
    return curve_table(score_counts(df, label, score, groups), groups, splits)


# --- discounted gain -------------------------------------------------------

STEPS_PER_DOUBLING = 8
NODES, WEIGHTS = np.polynomial.legendre.leggauss(5)


def _discount(x):
    return math.log(2) / np.log(x + 1)


def _slope(x):
    return -math.log(2) / ((x + 1) * np.log(x + 1) ** 2)


@lru_cache(maxsize=1)
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact sums of the first positions; then places eight per doubling, and the sum up to each.

    The second sum leaves out the end terms that a step away from its place adds.
    """
    first = np.concatenate([[0.0], np.cumsum(_discount(np.arange(1, EXACT_POSITIONS + 1)))])
    begin = STEPS_PER_DOUBLING * int(math.log2(EXACT_POSITIONS))
    places = np.round(2.0 ** (np.arange(begin, 62 * STEPS_PER_DOUBLING) / STEPS_PER_DOUBLING))
    half, middle = np.diff(places) / 2, (places[1:] + places[:-1]) / 2
    area = half * np.sum(WEIGHTS * _discount(middle[:, None] + half[:, None] * NODES), axis=1)
    ends = _discount(places) / 2 + _slope(places) / 12
    sums = first[-1] + np.concatenate([[0.0], np.cumsum(area + np.diff(ends))])
    return first, places, sums - ends


def discount_sum(m: Column) -> Column:
    """Sum of 1 / log2(i + 1) for i = 1..m.

    The first positions are looked up; beyond them the sum is a known value at a
    nearby place plus an Euler-Maclaurin step to ``m``, so a tie of any length
    costs the same.
    """
    first, places, sums = _grid()
    x = F.greatest(m, F.lit(EXACT_POSITIONS)).cast("double")
    begin = STEPS_PER_DOUBLING * int(math.log2(EXACT_POSITIONS))
    index = F.floor(F.log2(x) * STEPS_PER_DOUBLING + 1e-9).cast("int") - begin
    start = F.get(F.lit(places), index)
    area = F.lit(0.0)
    for node, weight in zip((1 + NODES) / 2, WEIGHTS):
        area = area + float(weight * math.log(2)) / F.log(start + (x - start) * float(node) + 1)
    log = F.log(x + 1)
    ends = math.log(2) / 2 / log - math.log(2) / 12 / ((x + 1) * log * log)
    beyond = F.get(F.lit(sums), index) + (x - start) / 2 * area + ends
    exact = F.get(F.lit(first), F.least(m, F.lit(EXACT_POSITIONS)).cast("int"))
    return F.when(m <= EXACT_POSITIONS, exact).otherwise(beyond)


# --- results ----------------------------------------------------------------

def curve_summary(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, average precision and NDCG of every group.

    AUC is NULL when a class is missing; AP and NDCG are 0 without positives.
    """
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    through, here = F.col("tp") + F.col("fp"), F.col("pos") + F.col("neg")
    gain = F.when(pos > 0, pos / here * (discount_sum(through) - discount_sum(through - here))).otherwise(0.0)
    summed = table.groupBy(*groups).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.sum(neg * (tp - pos / 2)).alias("_won"), F.sum(pos * tp / (tp + fp)).alias("_area"),
        F.sum(gain).alias("_dcg"))
    p, n = F.col("positives"), F.col("negatives")
    return summed.select(
        *groups, "positives", "negatives",
        cm.ratio(F.col("_won"), p.cast("double") * n, None).alias("roc_auc"),
        cm.ratio(F.col("_area"), p).alias("ap"),
        cm.ratio(F.col("_dcg"), discount_sum(p)).alias("ndcg"))


def _corners(table: DataFrame) -> DataFrame:
    """Drop points whose neighbours continue with the same step."""
    same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    return table.where(first | ~F.coalesce(same, F.lit(False)))


def _with_origin(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add the point above the highest score of each group, where nothing is called positive."""
    origin = table.groupBy(*groups).agg(F.max("positives").alias("positives"),
                                        F.max("negatives").alias("negatives"))
    zero = F.lit(0).cast("bigint")
    origin = origin.select(*groups, F.lit(INFINITE).alias("score"), zero.alias("tp"), zero.alias("fp"),
                           F.col("positives").alias("fn"), F.col("negatives").alias("tn"))
    return table.select(*origin.columns).unionByName(origin)


def roc_points(table: DataFrame, groups: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """False and true positive rate at every threshold, the infinite one included."""
    kept = _with_origin(_corners(table) if drop_intermediate else table, groups)
    return kept.select(*groups, F.col("score").alias("threshold"),
                       cm.ratio(F.col("fp"), F.col("fp") + F.col("tn"), None).alias("fpr"),
                       cm.ratio(F.col("tp"), F.col("tp") + F.col("fn"), None).alias("tpr"))


def pr_points(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, closed by (1, 0) without a threshold."""
    points = table.select(*groups, F.col("score").alias("threshold"),
                          cm.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                          cm.ratio(F.col("tp"), F.col("positives"), 1.0).alias("recall"))
    closing = table.groupBy(*groups).agg(F.lit(None).cast("double").alias("threshold"),
                                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(closing)


SWEEP = ("f1", "accuracy", "precision", "recall", "kappa")


def threshold_sweep(table: DataFrame, metric: str = "f1", groups: Sequence[str] = (),
                    drop_intermediate: bool = True) -> DataFrame:
    """Metric at every ROC threshold, a record counting as positive at or above it."""
    if metric not in SWEEP:
        raise ValueError(f"unsupported metric: {metric}")
    points = _with_origin(_corners(table) if drop_intermediate else table, groups)
    value = cm.METRICS[metric](*[F.col(c) for c in cm.COUNTS])
    return points.select(*groups, F.col("score").alias("threshold"), F.coalesce(value, F.lit(0.0)).alias("value"))


def best_threshold(table: DataFrame, metric: str = "f1", groups: Sequence[str] = (),
                   drop_intermediate: bool = True) -> DataFrame:
    """Threshold with the best metric per group; of equals the highest.

    The sweep calls a score at the threshold positive. ``labels.decision``, which
    applies a threshold, does not: the two rules are kept apart on purpose.
    """
    swept = threshold_sweep(table, metric, groups, drop_intermediate)
    best = swept.groupBy(*groups).agg(F.max(F.struct("value", "threshold")).alias("_best"))
    return best.select(*groups, F.col("_best.threshold").alias("threshold"), F.col("_best.value").alias(metric))


def detailed_metrics(df: DataFrame, label: str, prediction: str, score: str, groups: Sequence[str],
                     splits: Splits | None = None) -> DataFrame:
    """Confusion, threshold metrics and curve figures, one row per group."""
    counted = cm.add_metrics(cm.confusion(df, label, prediction, groups))
    summary = curve_summary(curves(df, label, score, groups, splits), groups)
    return join_groups(counted, summary, groups, "left") if groups else counted.join(summary, how="left")


def naive_baselines(df: DataFrame, label: str, groups: Sequence[str]) -> DataFrame:
    """Metrics of calling every record positive, or every record negative."""
    held = df.where(F.col(label).isin(0, 1)).groupBy(*groups).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cases = F.explode(F.array(
        F.struct(F.lit("always pos").alias("approach"), F.lit(1).alias("said")),
        F.struct(F.lit("always neg").alias("approach"), F.lit(0).alias("said"))))
    said, p, n = F.col("case.said"), F.col("p"), F.col("n")
    counts = held.select("*", cases.alias("case")).select(
        *groups, F.col("case.approach").alias("approach"),
        (n * (1 - said)).alias("tn"), (n * said).alias("fp"), (p * (1 - said)).alias("fn"), (p * said).alias("tp"))
    # One score for all records is one tie: AUC 1/2, precision the class share.
    # The gain is spread evenly, which the share of discounts expresses.
    total, held_pos = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("tp") + F.col("fn")
    both = (held_pos > 0) & (held_pos < total)
    return cm.add_metrics(counts).select(
        "*", F.when(both, F.lit(0.5)).alias("roc_auc"), cm.ratio(held_pos, total).alias("ap"),
        cm.ratio(held_pos * discount_sum(total) / total, discount_sum(held_pos)).alias("ndcg"))
