"""Learners, searches and throughput."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.plans import models as P


def test_throughput_counts_what_a_plan_gives(spark):
    from gleaner.plans.throughput import timed
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("some"))
    stored, out = timed(df, {"with_some": "some"})
    assert (out["records"], out["with_some"]) == (1000, 250) and out["records_per_sec"] > 0
    assert stored.count() == 1000 and timed(df.where("id < 0"))[1]["records"] == 0


def test_focal_fit_lowers_its_loss_and_ends_where_its_gradient_does(spark):
    from pyspark.ml.functions import array_to_vector
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.3)
        rows.append((y, [rng.gauss(1.5 * y, 1), rng.gauss(-0.5 * y, 1)]))
    train = spark.createDataFrame(rows, "label int, x array<double>").select("label", array_to_vector("x").alias("features")).cache()
    model, losses = P.fit_focal(train, 0.6, 3.0, reg=0.0, rounds=40, least_gain=1e-9)
    assert len(losses) > 3 and all(b < a for a, b in zip(losses, losses[1:]))

    def mean_loss(w, b):
        total = 0.0
        for y, x in rows:
            z = sum(a * c for a, c in zip(w, x)) + b
            p = 1 / (1 + math.exp(-z if y else z))
            total -= (0.6 if y else 0.4) * (1 - p) ** 3 * math.log(p)
        return total / len(rows)
    w, b = list(model.coefficients), model.intercept
    here = mean_loss(w, b)
    assert here == pytest.approx(losses[-1], abs=1e-9)
    for k in range(3):  # no small step in any direction leads lower
        for step in (-0.02, 0.02):
            v, c = list(w), b
            if k < 2:
                v[k] += step
            else:
                c += step
            assert mean_loss(v, c) > here - 1e-7


def test_both_losses_are_searched(spark):
    from pyspark.ml.functions import array_to_vector
    rng = random.Random(3)
    rows = [(i % 2, [rng.gauss(i % 2, 1), rng.random()]) for i in range(120)]
    held = spark.createDataFrame(rows, "label int, x array<double>").select("label", array_to_vector("x").alias("features")).cache()
    for loss, names in (("BCE", {"pos_weight", "reg"}), ("focal", {"alpha", "gamma", "reg"})):
        best, results = P.random_search(held, held, 3, 1, iterations=10, loss=loss)
        assert len(results) == 3 and best in results and names < set(best)
        for name, (_, low, high) in P.search_space(500, loss).items():
            assert all(low <= r[name] <= high for r in results)
    with pytest.raises(ValueError):
        P.search_space(0, "hinge")


def word_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 30))), i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "id long, text string, labels int")


def test_vocabularies_of_several_parts_are_those_of_each(spark):
    rows = P.add_words(word_rows(spark), "text")
    members = [F.col("id") % 3 != k for k in range(3)] + [F.col("id") < 0]
    for size in (3, 8, 12, 500):
        assert P.vocabularies(rows, members, size) == [P.vocabulary(rows.where(m), size) for m in members]


def test_frequent_words_meet_pairs_without_a_shuffle_of_pairs(spark, monkeypatch):
    rows = P.add_words(word_rows(spark), "text").localCheckpoint()
    plans = []
    stored = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        P.vocabularies(rows, [F.col("id") < 30, F.col("id") >= 30], 5)
        pairs = dict(plans)["pair-counts"].split("== Initial Plan ==")[0]
        assert pairs.count("LeftSemi") == 2 and "SortMergeJoin" not in pairs and pairs.count("Exchange hashpartitioning") == 1
        monkeypatch.setattr(P, "FREQUENT", 0)  # a list too long to send is joined by a shuffle, with the same result
        assert P.vocabularies(rows, [F.col("id") < 30], 5) == [P.vocabulary(rows.where("id < 30"), 5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fold_vectors_are_those_of_a_fit_on_the_folds_own_train_rows(spark):
    from gleaner.operators.folds import build_folds
    rows = word_rows(spark)
    folds = build_folds(rows, "id", "labels", 3, 1, 4)
    parts = P.fold_parts(rows, folds, "id", "text", 3, max_features=20)
    stored = P.texts_with_splits(rows, folds, "id", "text", 0).localCheckpoint()
    for fold in range(3):
        of = lambda name: P.add_terms(stored.where(F.get("splits", F.lit(fold)) == name))  # noqa: B023, E731
        own = P.fit_tfidf(of("train"), max_features=20)
        for name in ("train", "dev", "test"):
            want = {r["id"]: r["features"] for r in own.transform(of(name)).collect()}
            assert {r["id"]: r["features"] for r in parts.split(fold, name).collect()} == want and want
    assert len({stages[0].uid for stages in parts.stages}) == 1


def test_fold_models_look_terms_up_once(spark):
    from gleaner.operators.folds import build_folds
    rows = word_rows(spark)
    folds = build_folds(rows, "id", "labels", 3, 1, 4)
    fit = lambda train, dev: P.weighted_logistic(iterations=2).fit(P.with_class_weight(train, 1.0))
    _, models = P.cross_validate(rows, folds, "id", "text", 3, fit=fit, max_features=20)
    alone = P.score_with_folds(rows, [models[1]], "text")
    both = P.score_with_folds(rows, models, "text")
    assert both.columns == [*rows.columns, "result"]
    one = {r["id"]: r["result"]["fold_scores"][0] for r in alone.collect()}
    assert {r["id"]: r["result"]["fold_scores"][1] for r in both.collect()} == one
    loaded = [m.copy() for m in models]
    assert {r["id"]: r["result"]["fold_scores"][1] for r in P.score_with_folds(rows, loaded, "text").collect()} == one


def test_equal_learners_are_fitted_once(spark, monkeypatch):
    from gleaner.operators.folds import build_folds
    rows = word_rows(spark)
    folds = build_folds(rows, "id", "labels", 2, 1, 4)
    fits, fit = [], P.RandomForestClassifier.fit
    monkeypatch.setattr(P.RandomForestClassifier, "fit", lambda self, df: fits.append(self.getImpurity()) or fit(self, df))
    learners = P.forest_grid([2], seed=3, depth=2)
    held = P.baseline_predictions(rows, folds, "id", "text", 2, learners, max_features=20).collect()
    assert sorted(fits) == ["entropy", "entropy", "gini", "gini"]
    by = {name: {(r["id"], r["fold"], r["score"], r["prediction"]) for r in held if r["model"] == name} for name in learners}
    assert by["rf entropy 2"] == by["rf log_loss 2"] and all(len(x) == 60 for x in by.values())
    other = {"a": P.forest(2, "gini", 3, 2), "b": P.forest(2, "gini", 4, 2)}  # another seed is another model
    fits.clear()
    P.baseline_predictions(rows, folds, "id", "text", 2, other, max_features=20)
    assert len(fits) == 4


def test_vectors_of_the_rows_themselves_are_those_of_the_fitted_stages(spark):
    held = P.add_terms(P.add_words(word_rows(spark), "text"))
    want = {r["id"]: r["features"] for r in P.fit_tfidf(held, max_features=20).transform(held).collect()}
    out = P.tfidf_vectors(held, ["id"], max_features=20)
    assert out.columns == ["id", "features"] and {r["id"]: r["features"] for r in out.collect()} == want
    assert "terms" not in out._jdf.queryExecution().analyzed().toString()  # no text is looked up again by what reads the vectors
