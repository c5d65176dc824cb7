"""Joins of labelled records, predictions and metadata on normalised keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.labels import error_type
from gleaner.functions.text import match_key, normalize_title
from gleaner.operators.columns import stacked
from gleaner.operators.dedup import keep_first
from gleaner.operators.joins import spread_join

TOP_RANKS = (10, 50, 100, 500, 1000, 5000)


def best_per_key(df: DataFrame, key: str, rank: str | None = None, score: str | None = None,
                 tie: str | None = None) -> DataFrame:
    """Whole row with the lowest rank, else the highest score, per key."""
    order = _preference(rank, score, tie)
    return keep_first(df.where(F.col(key).isNotNull()), [key], order)


def _preference(rank: str | None, score: str | None, tie: str | None) -> list[Column]:
    order = [F.asc_nulls_last(rank)] if rank else [F.desc_nulls_last(score)] if score else []
    order += [F.asc(tie)] if tie else []
    if not order:
        raise ValueError("a rank, a score or a tie column is needed")
    return order


def first_values_per_key(df: DataFrame, key: str, rank: str | None = None, score: str | None = None,
                         tie: str | None = None) -> DataFrame:
    """Per key and column the best-ranked value that is not NULL; may mix rows."""
    rest = [c for c in df.columns if c != key]
    parts = []
    if rank:
        parts += [F.col(rank).isNull(), F.col(rank)]
    elif score:
        parts += [F.col(score).isNull(), -F.col(score)]
    parts += [F.col(tie)] if tie else []
    order = F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*picks)


def match_ranked(labeled: DataFrame, predictions: DataFrame, field: str, kind: str, rank: str | None = None,
                 score: str | None = None, tie: str | None = None, whole_rows: bool = True) -> DataFrame:
    """Inner join of labelled records with their best prediction on a normalised key.

    NULL and blank keys never match. Shared column names get the suffixes
    ``_labeled`` and ``_pred``. Predictions are reduced to one row per key first,
    so a hot key can only swell the labelled side, where its rows are salted.
    """
    left = labeled.withColumn("match_key", match_key(F.col(field), kind)).where("match_key is not null")
    right = predictions.withColumn("match_key", match_key(F.col(field), kind))
    pick = best_per_key if whole_rows else first_values_per_key
    right = pick(right, "match_key", rank, score, tie)
    shared = (set(left.columns) & set(right.columns)) - {"match_key"}
    left = left.withColumnsRenamed({c: f"{c}_labeled" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}_pred" for c in shared})
    return spread_join(left, right, "match_key")


def find_errors(predictions: DataFrame) -> DataFrame:
    """False positives and false negatives, tagged."""
    tagged = predictions.withColumn("error_type", error_type(F.col("label"), F.col("prediction")))
    return tagged.where("error_type is not null")


def without_listed_titles(errors: DataFrame, listed: DataFrame, title: str = "title") -> DataFrame:
    """Errors whose normalised title is not on the list; a NULL title is kept."""
    keys = listed.select(normalize_title(F.col(title)).alias("_key")).where("_key is not null").distinct()
    keyed = errors.withColumn("_key", normalize_title(F.col(title)))
    return spread_join(keyed, keys, "_key", "left_anti").select(*errors.columns)


def backfill_metadata(errors: DataFrame, sources: Sequence[tuple[str, DataFrame]], order: str,
                      title: str = "title") -> DataFrame:
    """Add ``doi``, ``abstract`` and ``source`` from metadata tables tried in order.

    Each table counts with its first row per normalised title. The first table
    with a DOI wins; where its abstract is NULL, the first table whose row has an
    abstract fills it. Titles are reduced to one lookup row, so one join does both
    passes, and source rows that no error asks for are dropped first.
    """
    keyed = errors.withColumn("_key", normalize_title(F.col(title)))
    wanted = keyed.select("_key").where("_key is not null").distinct()
    slim = [table.select(normalize_title(F.col(title)).alias("_key"), F.col(order).alias("_order"), "doi", "abstract",
                         F.lit(priority).alias("priority"), F.lit(name).alias("source"))
            for priority, (name, table) in enumerate(sources)]
    asked = stacked(slim).join(wanted, "_key", "left_semi")
    lookup = keep_first(asked, ["_key", "priority"], ["_order"])
    hit = F.struct("doi", "abstract", "source")
    found = lookup.groupBy("_key").agg(
        F.min_by(hit, F.when(F.col("doi").isNotNull(), F.col("priority"))).alias("_hit"),
        F.min_by("abstract", F.when(F.col("abstract").isNotNull(), F.col("priority"))).alias("_fill"))
    joined = spread_join(keyed.drop("doi", "abstract", "source"), found, "_key", "left")
    filled = F.when(F.col("_hit.doi").isNotNull(), F.coalesce(F.col("_hit.abstract"), F.col("_fill")))
    return (joined.withColumn("doi", F.col("_hit.doi")).withColumn("abstract", filled)
            .withColumn("source", F.col("_hit.source")).drop("_key", "_hit", "_fill"))


def completeness(errors: DataFrame) -> DataFrame:
    """Per error type, how many records have a DOI and an abstract."""
    n = F.count("*")
    return errors.groupBy("error_type").agg(
        n.alias("n"), F.count("doi").alias("with_doi"), (100 * F.count("doi") / n).alias("doi_pct"),
        F.count("abstract").alias("with_abstract"), (100 * F.count("abstract") / n).alias("abstract_pct"))


def error_rate(predictions: DataFrame) -> DataFrame:
    wrong = F.count_if(error_type(F.col("label"), F.col("prediction")).isNotNull())
    return predictions.agg(F.count("*").alias("predictions"), wrong.alias("errors"),
                           (100 * wrong / F.count("*")).alias("error_rate_pct"))


def errors_by_fold(errors: DataFrame) -> DataFrame:
    """Fold x error type counts, absent cells 0."""
    kinds = ["False Negative", "False Positive"]
    return errors.groupBy("fold").pivot("error_type", kinds).count().na.fill(0, kinds)


def top_rank_share(matched: DataFrame, label: str, rank: str, tops: Sequence[int] = TOP_RANKS) -> DataFrame:
    """Per class, the share of its records inside the first N ranks, N up to the last rank."""
    hits = F.array(*[F.struct(F.lit(n).alias("top"), F.count_if(F.col(rank) <= n).alias("hits")) for n in tops])
    per_class = matched.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"), F.max(rank).alias("_last"), hits.alias("cells"))
    last = F.max("_last").over(Window.partitionBy())  # a row per class
    rows = per_class.withColumn("_last", last).select(label, "n", "_last", F.explode("cells").alias("cell"))
    return rows.where("cell.top <= _last").select(
        label, "cell.top", "cell.hits", "n", (100 * F.col("cell.hits") / F.col("n")).alias("pct"))


def extremes(matched: DataFrame, label: str, rank: str, tie: str, n: int = 5) -> DataFrame:
    """The ``n`` best and ``n`` worst ranked records of each class."""
    held = matched.where(F.col(label).isNotNull() & F.col(rank).isNotNull())
    parts = []
    for side, order in (("best", F.asc(rank)), ("worst", F.desc(rank))):
        place = F.row_number().over(Window.partitionBy(label).orderBy(order, F.asc(tie)))
        parts.append(held.withColumn("place", place).where(F.col("place") <= n).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])
