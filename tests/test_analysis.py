import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import distributions as D
from gleaner.functions import vectors
from gleaner.functions.ensemble import ensemble_result
from gleaner.operators import agreement as A
from gleaner.operators import compare as M
from gleaner.operators import linkage as J
from gleaner.operators import profile as P
from gleaner.operators import ranktests as R
from gleaner.operators import scores as S
from gleaner.operators.joins import hot_keys, spread_join


# --- ensembles ---------------------------------------------------------------

def test_nested_result_and_long_form_agree(spark):
    rows = [(1, [0.9, 0.8, 0.2, 0.6, 0.5]), (2, [0.1, 0.1, 0.1, 0.1, 0.1]), (3, [])]
    df = spark.createDataFrame(rows, "id long, s array<double>")
    nested = {r["id"]: r["r"] for r in df.select("id", ensemble_result(F.col("s")).alias("r")).collect()}
    assert nested[3] is None
    first = nested[1]
    assert first["ensemble_score"] == pytest.approx(0.6)
    assert first["ensemble_prediction"] == 1
    assert first["fold_scores"] == rows[0][1]
    assert first["statistics"]["std_score"] == pytest.approx(np.std(rows[0][1]))
    assert (first["statistics"]["positive_folds"], first["statistics"]["consensus_strength"]) == (3, 0.6)
    assert nested[2]["statistics"]["consensus_strength"] == 1
    long = df.select("id", F.posexplode("s").alias("fold", "score"))
    for r in S.ensemble_rows(long, ["id"]).collect():
        want = nested[r["id"]]
        assert r["fold_scores"] == want["fold_scores"]
        for name in ("std_score", "min_score", "max_score", "positive_folds", "consensus_strength"):
            assert r[name] == pytest.approx(want["statistics"][name])


def test_a_missing_model_fails_the_job(spark):
    df = spark.createDataFrame([(1, "a", 0.2, 0), (1, "b", 0.9, 0), (2, "a", 0.5, 1)], "id long, model string, score double, label int")
    with pytest.raises(Exception, match="has not been scored by 2 models"):
        S.ensemble_models(df, ["id"], 2).collect()
    assert S.ensemble_models(df.where("id = 1"), ["id"], 2).first()["prediction"] == 1


def test_filters_keep_unscored(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.8), (3, None)], "id long, score double")
    assert {r["id"] for r in S.at_least(df, "score", 0.5).collect()} == {2, 3}
    assert {r["id"] for r in S.score_between(df, "score", 0.2, 0.5).collect()} == {1}
    assert [r["id"] for r in S.by_score(df, "score", "id").collect()] == [2, 1, 3]
    assert [r["id"] for r in S.by_score(df, "score", "id", ascending=True).collect()] == [1, 2, 3]
    empty = S.batch_kpis(df.where("id = 3"), "score").first()
    assert (empty["total"], empty["average_score"], empty["highest_score"]) == (1, 0, 0)


def test_score_summary_divisors(spark):
    values = [0.1, 0.45, 0.5, 0.95, 0.6]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    a, b = (S.score_summary(df, "s", population=p).first() for p in (True, False))
    assert a["std"] == pytest.approx(np.std(values)) and b["std"] == pytest.approx(np.std(values, ddof=1))
    assert (a["q25"], a["median"], a["q75"]) == tuple(pytest.approx(np.percentile(values, q)) for q in (25, 50, 75))
    assert (a["high_count"], a["medium_count"], a["low_count"]) == (2, 2, 1)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.049, 0.05, 1.0, 1.2, None)], "s double")
    got = {r["bin"]: r["n"] for r in S.histogram(df, "s", 0, 1, 20).collect()}
    assert got == {1: 2, 2: 1, 20: 1}


def test_embedding_gate_edges(spark, value):
    def array(*v):
        return F.array(*[F.lit(float(x)) for x in v])
    assert value(vectors.cosine(array(1, 0), array(1, 0))) == pytest.approx(1)
    assert value(vectors.cosine(array(0, 0), array(1, 0))) == 0
    for sim, want in ((0.8499, "old"), (0.85, "new"), (0.9, "new")):
        assert value(vectors.semantic_gate(F.lit("new"), F.lit("old"), F.lit(sim))) == want


# --- linkage -----------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
                                    .otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("key"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 1500, 2)], "key string, v int")
    want = left.join(right, "key", how)
    rows = sorted(map(str, want.collect()))
    assert hot_keys(left, "key", sample=1.0, enough=100) == ["hot"]
    for hot in (None, ["hot"], ["hot", "k2", "absent"]):
        got = spread_join(left, right, "key", how, hot=hot)
        assert sorted(map(str, got.select(want.columns).collect())) == rows


def test_null_keys_never_match(spark):
    labeled = spark.createDataFrame([(None, "p"), ("A!", "p"), ("  ", "n"), ("b", "n")], "title string, label string")
    preds = spark.createDataFrame([(None, 1, 0.9), ("a", 7, 0.3), ("a ", 3, 0.2), (" ", 2, 0.8)], "title string, rank long, score double")
    out = J.match_ranked(labeled, preds, "title", "title", "rank", "score").collect()
    assert [(r["title_labeled"], r["rank"], r["score"]) for r in out] == [("A!", 3, 0.2)]
    by_score = J.match_ranked(labeled, preds.drop("rank"), "title", "title", None, "score").collect()
    assert [r["score"] for r in by_score] == [0.3]


def test_first_values_may_mix_rows(spark):
    df = spark.createDataFrame([("k", 2, "x", 1), ("k", 1, None, 2), ("k", None, "z", 3)], "key string, rank int, a string, b int")
    r = J.first_values_per_key(df, "key", rank="rank").first()
    assert (r["rank"], r["a"], r["b"]) == (1, "x", 2)
    assert J.best_per_key(df, "key", rank="rank").first()["a"] is None


def test_backfill_priorities(spark):
    errors = spark.createDataFrame([(i, t, "False Positive") for i, t in enumerate(["One", "Two", "three", None, "four"])],
                                   "id int, title string, error_type string")
    schema = "n int, title string, doi string, abstract string"
    first = spark.createDataFrame([(1, "one", "d1", None), (2, "two", None, "skip"), (3, "four", "d4", None), (4, "four", "d5", "late")], schema)
    second = spark.createDataFrame([(1, "ONE", "d9", "text"), (2, "<b>two</b>", "d2", None), (3, "four", None, None)], schema)
    out = {r["id"]: (r["doi"], r["abstract"], r["source"])
           for r in J.backfill_metadata(errors, [("a", first), ("b", second)], "n").collect()}
    assert out == {0: ("d1", "text", "a"), 1: ("d2", "skip", "b"), 2: (None, None, None), 3: (None, None, None), 4: ("d4", None, "a")}
    assert J.without_listed_titles(errors, first).count() == 2


def test_error_tables(spark):
    rows = [(0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 1, 0), (0, 0, 2)]
    df = spark.createDataFrame(rows, "label int, prediction int, fold int")
    assert Counter(r["error_type"] for r in J.find_errors(df).collect()) == {"False Positive": 2, "False Negative": 1}
    table = {r["fold"]: (r["False Negative"], r["False Positive"]) for r in J.errors_by_fold(J.find_errors(df)).collect()}
    assert table == {0: (1, 1), 1: (0, 1)}
    assert J.error_rate(df).first()["error_rate_pct"] == pytest.approx(60)


def test_top_share_and_extremes(spark):
    df = spark.createDataFrame([(i, "p" if i % 2 else "n", i) for i in range(1, 61)], "id long, label string, rank long")
    got = {(r["label"], r["top"]): r["hits"] for r in J.top_rank_share(df, "label", "rank").collect()}
    assert got == {("p", 10): 5, ("n", 10): 5, ("p", 50): 25, ("n", 50): 25}
    ends = J.extremes(df, "label", "rank", "id", 2).collect()
    assert {(r["label"], r["side"], r["place"]): r["rank"] for r in ends}[("n", "worst", 1)] == 60
    assert len(ends) == 8


# --- comparison --------------------------------------------------------------

def test_box_summary(spark):
    values = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 30.0]
    r = M.box_summary(spark.createDataFrame([("g", v) for v in values], "g string, value double"), ["g"]).first()
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    assert (r["q1"], r["median"], r["q3"]) == (q1, med, q3)
    assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["n"]) == (1, 5, 1, 7)
    assert r["mean"] == pytest.approx(np.mean(values))


def test_interval_divisor(spark):
    df = spark.createDataFrame([("m", v) for v in (0.8, 0.9, 0.7, 0.85)], "model string, f1 double")
    for divisor in (None, 9):
        r = M.mean_interval(df, ["model"], "f1", divisor).first()
        half = 1.959963984540054 * np.std([0.8, 0.9, 0.7, 0.85], ddof=1) / np.sqrt(divisor or 4)
        assert r["ci_high"] - r["mean"] == pytest.approx(half)


def test_trials(spark):
    rows = [("a", 1, 0.9, 0.1), ("a", 2, 0.5, 0.1), ("b", 1, 0.2, 0.2), ("b", 3, 0.6, 0.2)]
    df = spark.createDataFrame(rows, "trial_id string, training_iteration int, f1 double, alpha double")
    assert M.best_trial(df, "f1").first()["trial_id"] == "b"
    assert M.best_trial(df, "f1", mode="min").first()["trial_id"] == "a"
    assert sorted(r["f1"] for r in M.normalized_metric(df, "f1", ["alpha"]).collect()) == pytest.approx([0, 3 / 7, 4 / 7, 1])
    flat = df.withColumn("f1", F.lit(0.5))
    assert [r["f1"] for r in M.normalized_metric(flat, "f1", ["alpha"]).collect()] == [None] * 4


# --- rank tests --------------------------------------------------------------

def average_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_friedman_by_definition(spark):
    rng = random.Random(4)
    table = [[round(rng.random() + m / 8, 1) for m in range(4)] for _ in range(9)]
    df = spark.createDataFrame([(b, f"m{m}", v) for b, row in enumerate(table) for m, v in enumerate(row)],
                               "fold int, model string, v double")
    ranks = np.array([average_ranks(row) for row in table])
    n, k = ranks.shape
    ties = sum(c ** 3 - c for row in table for c in Counter(row).values())
    want = (12 / (n * k * (k + 1)) * (ranks.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    r = R.friedman(df, ["fold"], "model", "v").first()
    assert r["statistic"] == pytest.approx(want)
    assert (r["k"], r["n"]) == (4, 9)
    assert 0 < r["p_value"] < 1
    holes = df.where("not (fold = 0 and model = 'm1')")
    assert R.friedman(holes, ["fold"], "model", "v").first()["statistic"] is None


def test_friedman_published_example(spark):
    # Four treatments, five blocks without ties, perfect agreement: statistic n (k - 1), df 3.
    df = spark.createDataFrame([(b, m, float(m)) for b in range(5) for m in range(4)], "fold int, model int, v double")
    r = R.friedman(df, ["fold"], "model", "v").first()
    assert r["statistic"] == pytest.approx(15)
    assert r["p_value"] == pytest.approx(0.0018166, abs=1e-6)


def test_nemenyi_has_no_limit_on_models(spark):
    df = spark.range(3).withColumnRenamed("id", "fold").crossJoin(spark.range(120).withColumnRenamed("id", "model"))
    df = df.withColumn("v", (F.col("model") * 7 + F.col("fold")) % 113)
    assert R.nemenyi(df, ["fold"], "model", "v").count() == 120 * 119 // 2


def test_nemenyi_pairs(spark, value):
    df = spark.createDataFrame([(b, f"m{m}", float(-m)) for b in range(10) for m in range(3)], "fold int, model string, v double")
    out = {(r["model_a"], r["model_b"]): r for r in R.nemenyi(df, ["fold"], "model", "v").collect()}
    assert set(out) == set(itertools.combinations(["m0", "m1", "m2"], 2))
    far = out["m0", "m2"]
    assert far["rank_difference"] == 2 and far["significant"]
    assert far["critical_difference"] == pytest.approx(2.343 * np.sqrt(12 / 60), abs=2e-3)
    assert value(D.range_tail_of(F.lit(2.343 * 2 ** 0.5), 3)) == pytest.approx(0.05, abs=1e-3)


def test_models_that_do_not_differ(spark):
    """Maximal stretches of average ranks against a plain search."""
    rng = random.Random(12)
    rows = [(b, m, m * 0.35 + rng.random() * 3) for b in range(25) for m in range(9)]
    df = spark.createDataFrame([(b, f"m{m}", v) for b, m, v in rows], "fold int, model string, v double")
    ranks = sorted((r["avg_rank"], r["model"]) for r in R.average_ranks(df, ["fold"], "model", "v").collect())
    reach = D.range_critical(9) / 2 ** 0.5 * (9 * 10 / (6 * 25)) ** 0.5
    stretches = [[m for r, m in ranks[i:] if r - ranks[i][0] < reach] for i in range(9)]
    want = sorted(s for s in stretches if len(s) > 1 and not any(set(s) < set(t) for t in stretches))
    assert sorted(r["treatments"] for r in R.undistinguished(df, ["fold"], "model", "v").collect()) == want and len(want) > 1


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 3), (4, 5), (3, 8), (8, 5)])
def test_exact_distribution_of_u_by_enumeration(value, n1, n2):
    counts = Counter(sum(ranks) - n1 * (n1 + 1) // 2 for ranks in itertools.combinations(range(1, n1 + n2 + 1), n1))
    assert value(D.u_counts(F.lit(n1), F.lit(n2))) == [counts[u] for u in range(n1 * n2 + 1)]
    total = sum(counts.values())
    for u in (0, 1, n1 * n2 // 2, n1 * n2):
        want = min(1.0, 2 * sum(n for x, n in counts.items() if x >= max(u, n1 * n2 - u)) / total)
        assert value(D.u_two_sided(F.lit(float(u)), F.lit(float(n1)), F.lit(float(n2)))) == pytest.approx(want, abs=1e-12)


def test_mann_whitney_is_exact_for_small_samples_without_ties(spark):
    groups = {"small": ([1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0]), "tied": ([1.0, 2.0], [2.0, 3.0]),
              "large": ([i + 0.5 for i in range(9)], [float(i) for i in range(9)]), None: ([9.0, 8.0], [1.0, 2.0, 3.0])}
    rows = [(g, side, v) for g, pair in groups.items() for side, values in zip("ab", pair) for v in values]
    out = {r["g"]: r for r in R.mann_whitney(spark.createDataFrame(rows, "g string, side string, v double"), "side", "a", "b", "v", ["g"]).collect()}
    assert {g: r["method"] for g, r in out.items()} == {"small": "exact", "tied": "asymptotic", "large": "asymptotic", None: "exact"}
    assert out[None]["p_value"] == pytest.approx(2 / 10) and out[None]["u"] == 6
    assert out["small"]["p_value"] == pytest.approx(1.0 if out["small"]["u"] == 6 else 2 * sum(
        sum(r) - 6 >= max(out["small"]["u"], 12 - out["small"]["u"]) for r in itertools.combinations(range(1, 8), 3)) / 35)


def test_mann_whitney_by_definition(spark):
    rng = random.Random(6)
    a = [rng.randint(0, 9) / 10 for _ in range(40)]
    b = [rng.randint(2, 11) / 10 for _ in range(25)]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("c", 0.1)], "side string, v double")
    r = R.mann_whitney(df, "side", "a", "b", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (r["u"], r["n1"], r["n2"]) == (u, 40, 25)
    n = 65
    ties = sum(c ** 3 - c for c in Counter(a + b).values())
    z = (max(u, 1000 - u) - 500 - 0.5) / np.sqrt(1000 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert r["z"] == pytest.approx(z)
    d = R.cohens_d(df, "side", "a", "b", "v").first()["d"]
    assert d == pytest.approx((np.mean(a) - np.mean(b)) / np.sqrt((np.var(a) + np.var(b)) / 2))


# --- raters and words --------------------------------------------------------

def kappa(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    cats = {c for p in pairs for c in p}
    pe = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in cats) / n ** 2
    return 1.0 if pe == 1 else (po - pe) / (1 - pe)


def test_rater_kappa(spark):
    rng = random.Random(7)
    pairs = [(rng.choice("xyz"), rng.choice("xyz")) for _ in range(50)]
    rows = [("c", i, "r1", a) for i, (a, _) in enumerate(pairs)] + [("c", i, "r2", b) for i, (_, b) in enumerate(pairs)]
    rows += [("one", i, r, "x") for i in range(4) for r in ("r1", "r2")] + [("one", 9, "r1", "y"), ("one", 9, "r2", None)]
    df = spark.createDataFrame(rows, "criterion string, paper int, rater string, rating string")
    out = {r["criterion"]: r for r in A.rater_kappa(A.rating_pairs(df, ["criterion", "paper"], ("r1", "r2")), ["criterion"]).collect()}
    assert out["c"]["kappa"] == pytest.approx(kappa(pairs))
    assert out["c"]["agreements"] == sum(a == b for a, b in pairs)
    assert (out["one"]["kappa"], out["one"]["total"], out["one"]["interpretation"]) == (1.0, 4, "Almost Perfect")
    swapped = A.rater_kappa(A.rating_pairs(df, ["criterion", "paper"], ("r2", "r1")), ["criterion"])
    assert swapped.where("criterion = 'c'").first()["kappa"] == pytest.approx(out["c"]["kappa"])
    mean = A.mean_kappa(spark.createDataFrame([(1.0,), (0.4,), (0.6,), (None,)], "kappa double")).first()
    assert (mean["mean_kappa"], mean["criteria"]) == (pytest.approx(0.5), 2)


def test_screening_labels(spark):
    df = spark.createDataFrame([(1, "yes", None), (2, " NaN ", "none"), (3, None, "x"), (4, "", " ")], "id int, a string, b string")
    out = {r["id"]: r["screened_in"] for r in A.screening_labels(df, ["a", "b", "absent"]).collect()}
    assert out == {1: True, 2: False, 3: True, 4: False}
    with pytest.raises(ValueError):
        A.screening_labels(df, ["absent"])


def test_word_profile(spark):
    df = spark.createDataFrame([("x", "the Cat  sat\tthe cat"), ("x", "Cat and dog"), ("y", "the the")], "label string, t string")
    out = [(r["label"], r["word"], r["n"], r["place"]) for r in P.top_words(df, "t", ["label"], ["the", "and"], 2).orderBy("label", "place").collect()]
    assert out == [("x", "Cat", 2, 1), ("x", "cat", 1, 2)]
    grams = P.top_ngrams(spark.createDataFrame([("x", "A big, big dog ran; a big dog!")], "label string, t string"), "t", ["label"], 2, 3)
    assert [(r["ngram"], r["n"]) for r in grams.orderBy("place").collect()] == [("big dog", 2), ("big big", 1), ("dog ran", 1)]
    assert "the" in P.english_stop_words()
