"""Per-record ensemble statistics over an array of fold scores.

The scores of one record sit in one array, so every statistic is a column
expression and needs no shuffle. ``operators.scores`` holds the grouped form
for scores that arrive as rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.labels import decision


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def array_std_pop(values: Column) -> Column:
    """Population standard deviation; the mean is bound once per row."""
    def spread(state: Column) -> Column:
        squares = F.aggregate(state.values, F.lit(0.0), lambda acc, x: acc + (x - state.mean) * (x - state.mean))
        return F.sqrt(squares / F.size(state.values))
    state = F.struct(values.alias("values"), array_mean(values).alias("mean"))
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(state), spread), F.lit(0)))


def positive_folds(values: Column, threshold: float = 0.5) -> Column:
    return F.size(F.filter(values, lambda x: x > threshold))


def consensus(positive: Column, total: Column) -> Column:
    """Share of the folds that side with the majority."""
    return F.when(total > 0, F.greatest(positive, total - positive) / total)


def ensemble_statistics(values: Column, threshold: float = 0.5) -> Column:
    """Struct of mean, population std, min, max, positive folds, consensus; NULL for no scores."""
    positive = positive_folds(values, threshold)
    return F.when(F.size(values) > 0, F.struct(
        array_mean(values).alias("mean_score"),
        array_std_pop(values).alias("std_score"),
        F.array_min(values).alias("min_score"),
        F.array_max(values).alias("max_score"),
        positive.alias("positive_folds"),
        consensus(positive, F.size(values)).alias("consensus_strength"),
    ))


def ensemble_result(values: Column, threshold: float = 0.5) -> Column:
    """Nested result of one record: score, decision, fold scores, statistics."""
    score = array_mean(values)
    return F.when(F.size(values) > 0, F.struct(
        score.alias("ensemble_score"),
        decision(score, threshold).alias("ensemble_prediction"),
        values.alias("fold_scores"),
        ensemble_statistics(values, threshold).alias("statistics"),
    ))
