"""Stratified folds over several runs, their nested dev split, and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.labels import recode_optional
from gleaner.operators.sampling import seeded_key, seeded_position


class FoldOverlap(ValueError):
    """Raised when two test folds of a run share records."""


def assign_test_folds(df: DataFrame, id_: str, label: str, n_folds: int, n_runs: int, seed: int) -> DataFrame:
    """(run, id, label, place, test_fold): every class dealt evenly over the folds of each run.

    The run is part of the hash key, which gives each run its own order.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1)))
    slim = df.select(runs.alias("run"), F.col(id_), F.col(label))
    placed = seeded_position(slim, id_, [seed, F.col("run")], ["run", label], "place")
    return placed.withColumn("place", F.col("place") - 1).withColumn(
        "test_fold", (F.col("place") % n_folds).cast("int"))


def _hex_digits(digest: Column, count: int) -> Column:
    return F.conv(F.substring(digest, 1, count), 16, 10).cast("bigint")


def fold_splits(assigned: DataFrame, id_: str, label: str, n_folds: int, seed: int,
                dev_one_in: int = 4) -> DataFrame:
    """(run, fold, split, id, label) with split in train, dev, test.

    Within a fold the records of a class outside the test set keep their seeded
    order; each block of ``dev_one_in`` neighbours gives one record to dev, picked
    by a digest of run, fold, class and block. Place and block follow from
    arithmetic, so the split needs no shuffle.
    """
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    out = assigned.select("run", id_, label, "place", "test_fold", folds.alias("fold"))
    tested_before = F.floor((F.col("place") + (n_folds - 1) - F.col("fold")) / n_folds)
    rest = F.col("place") - tested_before
    block = F.floor(rest / dev_one_in).cast("bigint")
    digest = seeded_key(block, seed, F.col("run"), F.col("fold"), F.col(label))
    picked = _hex_digits(digest, 8) % dev_one_in == rest % dev_one_in
    split = (F.when(F.col("test_fold") == F.col("fold"), "test")
             .when(picked, "dev").otherwise("train"))
    return out.select("run", "fold", split.alias("split"), id_, label)


def build_folds(corpus: DataFrame, id_: str, label: str, n_folds: int = 5, n_runs: int = 2, seed: int = 42,
                dev_one_in: int = 4, optional_label: int = -1) -> DataFrame:
    """Split table of a cleaned corpus; optional negatives go to train only, as class 0.

    Carries identifiers and labels alone. Texts are joined on the identifier when
    a split is written or trained on.
    """
    is_optional = F.col(label) == optional_label
    assigned = assign_test_folds(corpus.where(~is_optional), id_, label, n_folds, n_runs, seed)
    curated = fold_splits(assigned, id_, label, n_folds, seed, dev_one_in)
    runs = F.sequence(F.lit(0), F.lit(n_runs - 1))
    folds = F.sequence(F.lit(0), F.lit(n_folds - 1))
    extra = (corpus.where(is_optional).select(id_, label, F.explode(runs).alias("run"))
             .select("run", F.explode(folds).alias("fold"), F.lit("train").alias("split"), id_, label))
    both = curated.withColumn("is_optional", F.lit(False)).unionByName(
        extra.withColumn("is_optional", F.lit(True)))
    return both.withColumn(label, recode_optional(F.col(label), optional_label))


def label_distribution(df: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count and share of each label inside every group."""
    counted = df.groupBy(*groups, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*groups))
    return counted.withColumn("share", F.col("n") / total)


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("run", "fold").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test")])


def membership(folds: DataFrame, id_: str) -> DataFrame:
    """Per run and record, the splits it was ever in."""
    return folds.groupBy("run", id_).agg(
        *[F.bool_or(F.col("split") == s).alias(f"in_{s}") for s in ("train", "dev", "test")])


def coverage(folds: DataFrame, id_: str) -> DataFrame:
    """Per run, how many records reached each split at least once, and how many never reached train."""
    return membership(folds, id_).groupBy("run").agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col(f"in_{s}")).alias(f"in_{s}") for s in ("train", "dev", "test")],
        F.count_if(~F.col("in_train")).alias("never_in_train"))


def never_in_train(folds: DataFrame, id_: str) -> DataFrame:
    seen = folds.where("split = 'train'").select("run", id_).distinct()
    return folds.select("run", id_).distinct().join(seen, ["run", id_], "left_anti")


def test_overlaps(folds: DataFrame, id_: str, n_folds: int) -> DataFrame:
    """Shared records of every pair of test folds, zero included.

    The folds of a record are gathered (never more than ``n_folds``) and only
    records in several of them are paired.
    """
    tested = folds.where("split = 'test'").groupBy("run", id_).agg(
        F.array_sort(F.collect_set("fold")).alias("folds"))
    pairs = F.flatten(F.transform("folds", lambda a: F.transform(
        F.filter("folds", lambda b: b > a), lambda b: F.struct(a.alias("fold_a"), b.alias("fold_b")))))
    shared = tested.where(F.size("folds") > 1).select("run", F.explode(pairs).alias("pair"))
    shared = shared.groupBy("run", "pair").agg(F.count("*").alias("shared"))
    numbers = F.sequence(F.lit(0), F.lit(n_folds - 1))
    wanted = F.flatten(F.transform(numbers, lambda a: F.transform(
        F.filter(numbers, lambda b: b > a), lambda b: F.struct(a.alias("fold_a"), b.alias("fold_b")))))
    every = folds.select("run").distinct().select("run", F.explode(wanted).alias("pair"))
    return (every.join(shared, ["run", "pair"], "left")
            .select("run", "pair.fold_a", "pair.fold_b", F.coalesce("shared", F.lit(0)).alias("shared")))


def require_disjoint(folds: DataFrame, id_: str, n_folds: int) -> DataFrame:
    """The folds unchanged, or an error naming the first overlapping pair."""
    bad = test_overlaps(folds, id_, n_folds).where("shared > 0").orderBy("run", "fold_a", "fold_b").first()
    if bad:
        raise FoldOverlap(f"run {bad['run']}: test folds {bad['fold_a']} and {bad['fold_b']} "
                          f"share {bad['shared']} records")
    return folds


def selected_split(corpus: DataFrame, folds: DataFrame, id_: str, run: int, fold: int, split: str) -> DataFrame:
    """Corpus rows of one split, with the label the split table gives them."""
    wanted = folds.where((F.col("run") == run) & (F.col("fold") == fold) & (F.col("split") == split))
    return corpus.drop("labels").join(wanted.select(id_, "labels", "is_optional"), id_)
