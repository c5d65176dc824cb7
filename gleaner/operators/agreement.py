"""Agreement of two raters, and screening labels from rating sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.labels import kappa_level
from gleaner.functions.text import clean_or_null


def rating_pairs(ratings: DataFrame, keys: Sequence[str], raters: tuple[str, str],
                 rater: str = "rater", rating: str = "rating") -> DataFrame:
    """Both ratings of each record side by side, only where both exist."""
    def of(who: str) -> Column:
        return F.max(F.when(F.col(rater) == who, F.col(rating)))
    pairs = ratings.groupBy(*keys).agg(of(raters[0]).alias("rating_a"), of(raters[1]).alias("rating_b"))
    return pairs.where("rating_a is not null and rating_b is not null")


def rater_kappa(pairs: DataFrame, groups: Sequence[str], a: str = "rating_a", b: str = "rating_b") -> DataFrame:
    """Agreement counts and Cohen's kappa per group; one shared class throughout counts as 1."""
    table = pairs.groupBy(*groups, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    sides = F.explode(F.array(
        F.struct(F.col("_a").alias("category"), F.col("_n").alias("of_a"), F.lit(0).cast("bigint").alias("of_b"),
                 F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0).alias("agreed")),
        F.struct(F.col("_b").alias("category"), F.lit(0).cast("bigint").alias("of_a"), F.col("_n").alias("of_b"),
                 F.lit(0).cast("bigint").alias("agreed"))))
    margins = table.select(*groups, sides.alias("m")).groupBy(*groups, "m.category").agg(
        F.sum("m.of_a").alias("_ra"), F.sum("m.of_b").alias("_rb"), F.sum("m.agreed").alias("_agreed"))
    summed = margins.groupBy(*groups).agg(
        F.sum("_agreed").alias("agreements"), F.sum("_ra").alias("total"),
        F.sum(F.col("_ra").cast("double") * F.col("_rb")).alias("_chance"))
    n = F.col("total").cast("double")
    seen, chance = F.col("agreements") / n, F.col("_chance") / (n * n)
    kappa = F.when(chance < 1, (seen - chance) / (1 - chance)).otherwise(F.lit(1.0))
    return summed.select(*groups, "agreements", "total", (100 * seen).alias("agreement_pct"), kappa.alias("kappa"),
                         ).withColumn("interpretation", kappa_level(F.col("kappa")))


def mean_kappa(kappas: DataFrame) -> DataFrame:
    """Mean over criteria that are not perfect."""
    return kappas.agg(F.avg(F.when(F.col("kappa") < 1, F.col("kappa"))).alias("mean_kappa"),
                      F.count_if(F.col("kappa") < 1).alias("criteria"))


def has_rating(columns: Sequence[str]) -> Column:
    """True if any rating column holds something."""
    def rated(c: Column) -> Column:
        text = F.lower(clean_or_null(c))
        return text.isNotNull() & ~text.isin("nan", "none")
    return F.exists(F.array(*[F.col(c).cast("string") for c in columns]), rated)


def screening_labels(sheet: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sheet rows with ``screened_in``: rated by anyone on any listed column that exists."""
    present = [c for c in columns if c in sheet.columns]
    if not present:
        raise ValueError("none of the rating columns exists")
    return sheet.withColumn("screened_in", has_rating(present))
