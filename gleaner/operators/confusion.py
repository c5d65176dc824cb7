"""Confusion counts and the metrics that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["tn", "fp", "fn", "tp"]


def ratio(top: Column, bottom: Column, undefined: float | None = 0.0) -> Column:
    """top / bottom, ``undefined`` where the bottom is zero."""
    other = F.lit(undefined).cast("double")
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(other)


def precision(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return ratio(tp, tp + fn)


def specificity(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return ratio(tn, tn + fp)


def accuracy(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return ratio(tp + tn, tn + fp + fn + tp)


def f_beta(tn: Column, fp: Column, fn: Column, tp: Column, beta: float = 1.0) -> Column:
    square = beta * beta
    return ratio((1 + square) * tp, (1 + square) * tp + square * fn + fp)


def matthews(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Correlation of label and prediction, 0 when either never varies."""
    def root(c: Column) -> Column:
        return F.sqrt(c.cast("double"))
    tn_, fp_, fn_, tp_ = (c.cast("double") for c in (tn, fp, fn, tp))
    return ratio(tp_ * tn_ - fp_ * fn_, root(tp + fp) * root(tp + fn) * root(tn + fp) * root(tn + fn))


def cohen_kappa(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Agreement beyond chance; NULL when both sides name one and the same class."""
    n = (tn + fp + fn + tp).cast("double")
    seen = (tp + tn) / n
    chance = ((tp + fp) / n) * ((tp + fn) / n) + ((tn + fn) / n) * ((tn + fp) / n)
    return F.when(chance < 1, (seen - chance) / (1 - chance))


METRICS = {
    "precision": precision, "recall": recall, "f1": f_beta,
    "f2": lambda *c: f_beta(*c, beta=2.0), "accuracy": accuracy,
    "specificity": specificity, "mcc": matthews, "kappa": cohen_kappa,
}


def confusion(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP of every group in one aggregation."""
    actual, said = F.col(label), F.col(prediction)
    return df.groupBy(*groups).agg(
        F.count_if((actual == 0) & (said == 0)).alias("tn"),
        F.count_if((actual == 0) & (said == 1)).alias("fp"),
        F.count_if((actual == 1) & (said == 0)).alias("fn"),
        F.count_if((actual == 1) & (said == 1)).alias("tp"))


def add_metrics(counts: DataFrame, names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    cells = [F.col(c) for c in COUNTS]
    return counts.select("*", *[METRICS[n](*cells).alias(n) for n in names])


def add_shares(counts: DataFrame) -> DataFrame:
    """Total and the share of each cell in percent."""
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return counts.select("*", total.alias("total"),
                         *[ratio(100 * F.col(c), total).alias(f"{c}_pct") for c in COUNTS])
