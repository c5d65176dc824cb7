import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import distributions as D
from gleaner.functions import losses
from gleaner.operators import confusion as C
from gleaner.operators import curves as K


def counts(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")


def test_recorded_counts_give_recorded_metrics(spark):
    r = C.add_metrics(counts(spark, 50, 24, 31, 125)).first()
    assert r["precision"] == pytest.approx(125 / 149)
    assert r["recall"] == pytest.approx(125 / 156)
    assert r["f1"] == pytest.approx(250 / 305)
    assert r["accuracy"] == pytest.approx(175 / 230)
    p = 175 / 230
    e = (149 * 156 + 81 * 74) / 230 ** 2
    assert r["kappa"] == pytest.approx((p - e) / (1 - e))
    assert r["mcc"] == pytest.approx((125 * 50 - 24 * 31) / math.sqrt(149 * 156 * 74 * 81))


def test_undefined_metrics(spark):
    r = C.add_metrics(counts(spark, 5, 0, 0, 0)).first()
    assert (r["precision"], r["recall"], r["f1"], r["mcc"], r["kappa"]) == (0, 0, 0, 0, None)


def brute(rows):
    """AUC, AP and NDCG of (label, score) pairs, straight from their definitions."""
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        called = [y for y, s in rows if s >= t]
        recall = sum(called) / len(pos) if pos else 0
        ap += (recall - last) * sum(called) / len(called)
        last = recall
    place, dcg = 0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tie = [y for y, s in rows if s == t]
        dcg += sum(tie) / len(tie) * sum(1 / math.log2(place + k + 2) for k in range(len(tie)))
        place += len(tie)
    ideal = sum(1 / math.log2(k + 2) for k in range(len(pos)))
    return auc, ap, dcg / ideal if pos else 0.0


def fixture(seed, n, kinds):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.4), 0.5 if i % 3 == 0 else rng.randint(0, kinds) / kinds) for i in range(n)]


@pytest.mark.parametrize("seed,n,kinds", [(1, 60, 4), (2, 400, 50), (3, 900, 2), (4, 5, 1000)])
def test_curves_equal_their_definitions(spark, seed, n, kinds):
    rows = fixture(seed, n, kinds)
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, 0.3), (2, 0, 0.9)], "g int, label int, score double")
    out = {r["g"]: r for r in K.curve_summary(K.curves(df, "label", "score", ["g"]), ["g"]).collect()}
    auc, ap, ndcg = brute(rows)
    assert out[1]["ap"] == pytest.approx(ap)
    assert out[1]["ndcg"] == pytest.approx(ndcg)
    assert out[1]["roc_auc"] == (pytest.approx(auc) if auc is not None else None)
    assert (out[2]["roc_auc"], out[2]["ap"], out[2]["ndcg"]) == (None, 0.0, 0.0)


def test_reversed_scores_mirror_the_auc(spark):
    rows = fixture(5, 300, 30)
    df = spark.createDataFrame(rows, "label int, score double")
    a = K.curve_summary(K.curves(df, "label", "score")).first()["roc_auc"]
    b = K.curve_summary(K.curves(df.withColumn("score", -F.col("score")), "label", "score")).first()["roc_auc"]
    assert a + b == pytest.approx(1)


def test_constant_scores_and_baselines(spark):
    df = spark.createDataFrame([(0, 1)] * 30 + [(0, 0)] * 10, "fold int, label int").withColumn("score", F.lit(1.0))
    r = K.curve_summary(K.curves(df, "label", "score")).first()
    assert (r["roc_auc"], r["ap"]) == (0.5, 0.75)
    base = {b["approach"]: b for b in K.naive_baselines(df, "label", ["fold"]).collect()}
    assert base["always pos"]["f1"] == pytest.approx(60 / 70)
    assert base["always neg"]["accuracy"] == 0.25
    for b in base.values():
        assert (b["roc_auc"], b["ap"], b["ndcg"]) == (0.5, 0.75, pytest.approx(r["ndcg"]))


def test_discount_sum_is_exact_at_any_length(spark):
    places = [0, 1, 255, 256, 257, 300, 511, 512, 513, 4096, 5000, 65535, 1_000_000]
    df = spark.createDataFrame([(p,) for p in places], "m long")
    sums = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(1, 1_000_001) + 1))])
    for r in df.select("m", K.discount_sum(F.col("m")).alias("d")).collect():
        assert r["d"] == pytest.approx(sums[r["m"]], rel=1e-12)


def sweep(rows, metric):
    """Best threshold over the corners of the ROC curve, first of equals from the top."""
    scores = sorted({s for _, s in rows}, reverse=True)
    steps = [(sum(y == 1 and s == t for y, s in rows), sum(y == 0 and s == t for y, s in rows)) for t in scores]
    kept = [math.inf] + [t for i, t in enumerate(scores) if i in (0, len(scores) - 1) or steps[i + 1] != steps[i]]

    def value(t):
        tp = sum(y == 1 and s >= t for y, s in rows)
        fp = sum(y == 0 and s >= t for y, s in rows)
        p, n = sum(y for y, _ in rows), len(rows)
        if metric == "f1":
            return 2 * tp / (tp + fp + p)
        if metric == "accuracy":
            return (tp + (n - p) - fp) / n
        return tp / (tp + fp) if tp + fp else 0.0
    best = max(value(t) for t in kept)
    return next(t for t in kept if value(t) == best), best


@pytest.mark.parametrize("metric", ["f1", "accuracy", "precision"])
def test_best_threshold(spark, metric):
    rows = fixture(8, 120, 25)
    df = spark.createDataFrame(rows, "label int, score double")
    r = K.best_threshold(K.curves(df, "label", "score"), metric).first()
    threshold, best = sweep(rows, metric)
    assert (r["threshold"], r[metric]) == (threshold, pytest.approx(best))


def test_curve_points_have_their_ends(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6)], "label int, score double")
    table = K.curves(df, "label", "score")
    roc = K.roc_points(table).orderBy(F.desc("threshold")).collect()
    assert [(r["threshold"], r["fpr"], round(r["tpr"], 3)) for r in roc] == [
        (math.inf, 0, 0), (0.9, 0, 0.333), (0.7, 0, 1), (0.6, 1, 1)]
    assert K.roc_points(table, drop_intermediate=False).count() == 5
    last = K.pr_points(table).where("threshold is null").first()
    assert (last["precision"], last["recall"]) == (1, 0)
    with pytest.raises(ValueError):
        K.best_threshold(table, "mcc")


def test_losses(value):
    x, y1, y0 = F.lit(1.3), F.lit(1), F.lit(0)
    p = 1 / (1 + math.exp(-1.3))
    assert value(losses.sigmoid(x)) == pytest.approx(p)
    assert value(losses.sigmoid(F.lit(-800.0))) == pytest.approx(0)
    assert value(losses.bce_with_logits(x, y1)) == pytest.approx(-5 * math.log(p))
    assert value(losses.bce_with_logits(x, y0)) == pytest.approx(-math.log(1 - p))
    assert value(losses.sigmoid_focal(x, y1)) == pytest.approx(-0.25 * (1 - p) ** 2 * math.log(p))
    assert value(losses.sigmoid_focal(x, y0, alpha=-1)) == pytest.approx(-p ** 2 * math.log(1 - p))
    with pytest.raises(ValueError):
        losses.loss("hinge", x, y1)


def test_tail_probabilities(value):
    for z in (0.0, 0.3, 1.0, 1.959963984540054, 3.5, 7.0):
        assert value(D.normal_two_sided(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    # Published points of the chi-square table at .05.
    for df, x in {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 7: 14.06714, 10: 18.30704}.items():
        assert value(D.chi_square_tail(F.lit(x), F.lit(df))) == pytest.approx(0.05, abs=1e-6)
    # Published studentized ranges at .05 with infinite degrees of freedom.
    for k, q in {2: 2.772, 3: 3.314, 5: 3.858, 10: 4.474, 20: 5.012}.items():
        assert D.range_critical(k) == pytest.approx(q, abs=2e-3)


def test_chi_square_tail_of_many_degrees_is_a_number(value):
    tail = value(D.chi_square_tail(F.lit(2000.0), F.lit(700)))
    assert 0 <= tail < 1e-100
    assert value(D.chi_square_tail(F.lit(700.0), F.lit(700))) == pytest.approx(0.4929, abs=1e-3)
