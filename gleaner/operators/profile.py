"""Word, n-gram and length profiles of texts per class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import BLANK, blank_tokens, ngrams, word_tokens
from gleaner.session import materialize


def english_stop_words() -> list[str]:
    """Spark's own list; callers with another list pass theirs."""
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def top_counts(counted: DataFrame, term: str, groups: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent terms of each group, ties by term.

    Spark keeps ``n`` per task and group before the final shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), F.asc(term)))
    return counted.withColumn("place", place).where(F.col("place") <= n)


def _words(df: DataFrame, text: str, groups: Sequence[str]) -> DataFrame:
    """One row per blank-separated word.

    The outer form keeps Spark from testing the array for emptiness first, which
    would split every text twice.
    """
    words = df.select(*groups, F.explode_outer(F.split(text, f"[{BLANK}]+")).alias("word"))
    return words.where("word != ''")


def word_counts(df: DataFrame, text: str, groups: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """Counts of blank-separated words, as written, without stop words."""
    words = _words(df, text, groups).where(~F.col("word").isin(list(stop_words)))
    return words.groupBy(*groups, "word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, text: str, groups: Sequence[str], stop_words: Sequence[str], n: int) -> DataFrame:
    return top_counts(word_counts(df, text, groups, stop_words), "word", groups, n)


BUCKETS = 1 << 20  # per group
LISTED = 100_000  # buckets that every task may hold


def _ngrams(df: DataFrame, text: str, groups: Sequence[str], size: int) -> DataFrame:
    grams = df.select(*groups, F.explode_outer(ngrams(word_tokens(F.col(text)), size)).alias("ngram"))
    return grams.where("ngram is not null")


def _in_group(groups: Sequence[str]) -> list[Column]:
    return [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]


def frequent_buckets(df: DataFrame, text: str, groups: Sequence[str], size: int, n: int) -> DataFrame:
    """Stored ``_bucket`` numbers, by hash of group and run, outside of which no run is among the ``n`` most frequent of its group.

    Some runs, the most frequent ones in a sixty-fourth of the texts, are counted in all texts, and so is every bucket. The
    n-th largest of a group's exact counts is one that the n-th best run reaches at least, so a bucket with
    fewer runs holds none of the best. The choice of the runs decides how much is left out, never what is found; a group with fewer of
    them than ``n`` keeps all its buckets.
    """
    part = df.where(F.pmod(F.xxhash64(text), F.lit(64)) == 0)
    some = top_counts(_ngrams(part, text, groups, size).groupBy(*groups, "ngram").agg(F.count("*").alias("n")), "ngram", groups, n)
    some = materialize(some.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("ngram").alias("_known")), "ngram-candidates")
    same = reduce(lambda x, y: x & y, _in_group(groups), F.col("ngram") == F.col("_known"))
    runs = _ngrams(df, text, groups, size).join(some, same, "left")
    counts = runs.groupBy(*groups, _bucket(groups).alias("_bucket"), "_known").agg(F.count("*").alias("n"))
    counts = materialize(counts, "ngram-buckets")
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n")))
    least = counts.where("_known is not null").withColumn("_place", place).where(F.col("_place") == n)
    least = least.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("n").alias("_least"))
    full = counts.groupBy(*groups, "_bucket").agg(F.sum("n").alias("n"))
    full = full.join(least, reduce(lambda x, y: x & y, _in_group(groups), F.lit(True)), "left")
    return materialize(full.where(F.col("n") >= F.coalesce("_least", F.lit(0))).select("_bucket").distinct(), "ngram-frequent")


def _bucket(groups: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*groups, "ngram"), F.lit(BUCKETS)).cast("int")


def top_ngrams(df: DataFrame, text: str, groups: Sequence[str], size: int = 4, n: int = 10) -> DataFrame:
    """Most frequent runs of ``size`` lower-cased words of two or more characters.

    Runs are texts longer than their words, and most occur once, so only those of frequent buckets are shuffled and
    counted as texts. Where more than ``LISTED`` buckets are frequent, as in tables in which nothing repeats much, all runs are.
    """
    grams = _ngrams(df, text, groups, size)
    buckets = frequent_buckets(df, text, groups, size, n)
    if buckets.count() <= LISTED:
        grams = grams.withColumn("_bucket", _bucket(groups)).join(F.broadcast(buckets), "_bucket", "left_semi")
    counted = grams.groupBy(*groups, "ngram").agg(F.count("*").alias("n"))
    return top_counts(counted, "ngram", groups, n)


def word_length_counts(df: DataFrame, text: str, groups: Sequence[str] = ()) -> DataFrame:
    """Number of blank-separated words of each length."""
    return _words(df, text, groups).groupBy(*groups, F.length("word").alias("length")).agg(F.count("*").alias("n"))


def longest_sequence(df: DataFrame, text: str, groups: Sequence[str] = ()) -> DataFrame:
    """Largest and mean number of words in a text."""
    size = F.size(blank_tokens(F.col(text)))
    return df.groupBy(*groups).agg(F.max(size).alias("max_words"), F.avg(size).alias("mean_words"))
