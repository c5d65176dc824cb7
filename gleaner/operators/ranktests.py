"""Rank tests between models: Friedman, Nemenyi, Mann-Whitney, effect size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.distributions import (EXACT_CELLS, chi_square_tail, normal_two_sided, range_critical, range_tail_of,
                                             u_two_sided)
from gleaner.operators.confusion import ratio
from gleaner.operators.ordering import Splits, find_splits, present, running_sums


# Fixed value: the smaller side up to which the exact distribution is asked.
EXACT_SIDE = 8


def block_ranks(df: DataFrame, block: Sequence[str], treatment: str, value: str,
                descending: bool = True) -> DataFrame:
    """Average-tie rank of each treatment inside its block.

    Values are averaged to one per block and treatment first, so a block holds no
    more rows than there are treatments.
    """
    cells = df.groupBy(*block, treatment).agg(F.avg(value).alias("value"))
    order = F.desc("value") if descending else F.asc("value")
    ranked = cells.withColumn("_low", F.rank().over(Window.partitionBy(*block).orderBy(order)))
    ties = F.count("*").over(Window.partitionBy(*block, "value"))
    return ranked.withColumn("ties", ties).withColumn(
        "rank", F.col("_low") + (F.col("ties") - 1) / 2).drop("_low")


def friedman(df: DataFrame, block: Sequence[str], treatment: str, value: str,
             groups: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected chi-square of the rank sums, with its p-value, per group."""
    ranks = block_ranks(df, [*groups, *block], treatment, value, descending=False)
    per_treatment = ranks.groupBy(*groups, treatment).agg(
        F.sum("rank").alias("_sum"), F.count("*").alias("_blocks"),
        F.sum(F.col("ties") * F.col("ties") - 1).alias("_ties"))
    total = per_treatment.groupBy(*groups).agg(
        F.count("*").alias("k"), F.max("_blocks").alias("n"), F.min("_blocks").alias("_least"),
        F.sum(F.col("_sum") * F.col("_sum")).alias("_squares"), F.sum("_ties").alias("_tied"))
    k, n = F.col("k"), F.col("n")
    # Each tied value adds t^2 - 1, which sums to t^3 - t over its tie.
    correction = 1 - F.col("_tied") / (n * k * (k * k - 1))
    statistic = ratio(12 / (n * k * (k + 1)) * F.col("_squares") - 3 * n * (k + 1), correction, None)
    complete = F.col("_least") == n
    stat = F.when(complete & (k >= 3), statistic)
    return (total.select(*groups, "k", "n", stat.alias("statistic"))
            .withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("k") - 1)))


def average_ranks(df: DataFrame, block: Sequence[str], treatment: str, value: str,
                  descending: bool = True) -> DataFrame:
    """Mean rank of each treatment over the blocks, 1 being best."""
    return block_ranks(df, block, treatment, value, descending).groupBy(treatment).agg(
        F.avg("rank").alias("avg_rank"), F.avg("value").alias("mean_value"), F.count("*").alias("blocks"))


def nemenyi(df: DataFrame, block: Sequence[str], treatment: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Every pair of treatments: rank difference, q, p-value, critical difference and decision.

    Works on one row per treatment; the number of treatments sets the critical
    value, so it is read first.
    """
    ranks = average_ranks(df, block, treatment, value)
    k = ranks.count()
    critical = range_critical(k, alpha) if k >= 2 else float("nan")
    left = ranks.select(F.col(treatment).alias("model_a"), F.col("avg_rank").alias("rank_a"), "blocks")
    right = ranks.select(F.col(treatment).alias("model_b"), F.col("avg_rank").alias("rank_b"))
    pairs = left.join(right, F.col("model_a") < F.col("model_b"))
    spread = F.sqrt(k * (k + 1) / (F.lit(6.0) * F.col("blocks")))
    difference = F.abs(F.col("rank_a") - F.col("rank_b"))
    distance = F.lit(critical / 2 ** 0.5) * spread
    return pairs.select(
        "model_a", "model_b", difference.alias("rank_difference"), (difference / spread).alias("q"),
        range_tail_of(difference / spread * 2 ** 0.5, max(k, 2)).alias("p_value"), distance.alias("critical_difference"), (difference >= distance).alias("significant"))


def undistinguished(df: DataFrame, block: Sequence[str], treatment: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Groups of treatments that do not differ: the longest stretches of average ranks within the critical difference.

    One row per group of two or more, best first, with its treatments in the order of their ranks; a treatment may be in several.
    Works on one row per treatment.
    """
    ranks = average_ranks(df, block, treatment, value)
    k, blocks = ranks.agg(F.count("*"), F.max("blocks")).first()
    critical = range_critical(k, alpha) / 2 ** 0.5 * (k * (k + 1) / (6.0 * blocks)) ** 0.5 if k >= 2 else 0.0
    order = Window.orderBy("avg_rank", treatment)
    numbered = ranks.withColumn("_no", F.row_number().over(order))
    # The stretch from a treatment ends before the first rank that is a critical difference away.
    start = numbered.select(F.col("_no").alias("_from"), F.col("avg_rank").alias("_start"))
    near = start.join(numbered, (F.col("_no") >= F.col("_from")) & (F.col("avg_rank") - F.col("_start") < critical))
    reach = near.groupBy("_from").agg(F.max("_no").alias("_to"))
    # A stretch that ends where an earlier one does lies inside it.
    longest = reach.groupBy("_to").agg(F.min("_from").alias("_from")).where("_to > _from")
    inside = longest.select("_from", "_to").join(numbered, F.col("_no").between(F.col("_from"), F.col("_to")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("avg_rank", treatment))), lambda x: x[treatment])
    return inside.groupBy("_from").agg(F.min("avg_rank").alias("best_rank"), F.max("avg_rank").alias("worst_rank"),
                                       F.count("*").alias("members"), listed.alias("treatments")).drop("_from")


def mann_whitney(df: DataFrame, side: str, first, second, value: str, groups: Sequence[str] = (),
                 splits: Splits | None = None) -> DataFrame:
    """Two-sided test of two sides: U of the first, z and p-value.

    Values are counted per distinct value, then ranked by one running sum. The p-value is exact where no values tie, one
    side has at most eight of them and there are at most ``EXACT_CELLS`` pairs, else the tie-corrected normal one with
    continuity correction; ``method`` says which.
    """
    splits = splits or find_splits(df, value)
    in_a, in_b = F.col(side) == first, F.col(side) == second
    counted = (df.where((in_a | in_b) & present([value]))
               .groupBy(*groups, F.col(value).cast("double").alias("_value"))
               .agg(F.count_if(in_a).alias("a"), F.count_if(in_b).alias("b")))
    table = running_sums(counted, "_value", ["a", "b"], groups, splits=splits, descending=False)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    tied = a + b
    summed = table.groupBy(*groups).agg(
        F.max("all_a").alias("n1"), F.max("all_b").alias("n2"),
        F.sum(a * (F.col("cum_b") - b / 2)).alias("u"), F.sum(tied * tied * tied - tied).alias("_ties"))
    n1, n2, u = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("u")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = ratio(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread, None)
    exact = (F.col("_ties") == 0) & (F.least(n1, n2).between(1, EXACT_SIDE)) & (n1 * n2 <= EXACT_CELLS)
    normal = F.least(normal_two_sided(F.greatest(z, F.lit(0.0))), F.lit(1.0))
    return summed.select(
        *groups, "n1", "n2", "u", z.alias("z"), F.when(exact, u_two_sided(u, n1, n2)).otherwise(normal).alias("p_value"),
        F.when(exact, "exact").otherwise("asymptotic").alias("method"))


def pooled_effect(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column) -> Column:
    """Cohen's d with the mean of the two variances; 0 when both vanish."""
    return ratio(mean_a - mean_b, F.sqrt((var_a + var_b) / 2))


def cohens_d(df: DataFrame, side: str, first, second, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Effect size of two sides with population variances."""
    a = F.when(F.col(side) == first, F.col(value))
    b = F.when(F.col(side) == second, F.col(value))
    return df.groupBy(*groups).agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        pooled_effect(F.avg(a), F.avg(b), F.var_pop(a), F.var_pop(b)).alias("d"))
