"""Evaluation of predictions: confusion, threshold metrics, curves, baselines."""

from pyspark.sql import functions as F

from gleaner.operators import confusion as C
from gleaner.operators import curves as K
from registry.base import N_FOLDS, corpus, lineitem_scores, predictions, query  # noqa: F401

KEYS = ["model", "run", "added", "fold"]


def metric_sql(name: str) -> str:
    """Guarded SQL forms of the threshold metrics over columns tn, fp, fn, tp."""
    def guarded(top, bottom):
        return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom}) END"
    n = "(tn + fp + fn + tp)"
    chance = f"(((tp + fp)::DOUBLE / {n}) * ((tp + fn)::DOUBLE / {n}) + ((tn + fn)::DOUBLE / {n}) * ((tn + fp)::DOUBLE / {n}))"
    return {
        "precision": guarded("tp", "tp + fp"), "recall": guarded("tp", "tp + fn"),
        "specificity": guarded("tn", "tn + fp"), "accuracy": guarded("tp + tn", n),
        "f1": guarded("2 * tp", "2 * tp + fn + fp"), "f2": guarded("5 * tp", "5 * tp + 4 * fn + fp"),
        "mcc": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (tp * tn - fp * fn)::DOUBLE"
               " / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) END",
        "kappa": f"CASE WHEN {chance} < 1 THEN ((tp + tn)::DOUBLE / {n} - {chance}) / (1 - {chance}) END",
    }[name]


METRICS_SQL = ", ".join(f"round({metric_sql(m)}, 9) AS {m}" for m in C.METRICS)
COUNTS_SQL = """sum((label = 0 AND prediction = 0)::INT)::BIGINT AS tn, sum((label = 0 AND prediction = 1)::INT)::BIGINT AS fp,
    sum((label = 1 AND prediction = 0)::INT)::BIGINT AS fn, sum((label = 1 AND prediction = 1)::INT)::BIGINT AS tp"""


def rounded(df, keep, names, digits=9):
    return df.select(*keep, *[F.round(n, digits).alias(n) for n in names])


@query("fold_classification_metrics", f"SELECT *, {METRICS_SQL} FROM cells", "predictions cells")
def fold_classification_metrics(spark, sf):
    out = C.add_metrics(C.confusion(predictions(spark, sf), "label", "prediction", KEYS))
    return rounded(out, [*KEYS, *C.COUNTS], C.METRICS)


@query("pooled_confusion_matrix", f"""
SELECT *, round(100.0::DOUBLE * tn / total, 9) AS tn_pct, round(100.0::DOUBLE * fp / total, 9) AS fp_pct,
       round(100.0::DOUBLE * fn / total, 9) AS fn_pct, round(100.0::DOUBLE * tp / total, 9) AS tp_pct
FROM (SELECT model, count(*) AS total, {COUNTS_SQL} FROM predictions GROUP BY model)""", "predictions")
def pooled_confusion_matrix(spark, sf):
    out = C.add_shares(C.confusion(predictions(spark, sf), "label", "prediction", ["model"]))
    return rounded(out, ["model", "total", *C.COUNTS], [f"{c}_pct" for c in C.COUNTS])


def curve_sql(source: str, keys: str) -> str:
    """Per distinct score: counts, running counts and, for the gain, the plain positions."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
    points AS (SELECT {keys}, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg
               FROM {source} GROUP BY {keys}, score),
    curve AS (SELECT {keys}, score, pos, neg,
                     (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
                     (sum(pos) OVER g)::BIGINT AS positives, (sum(neg) OVER g)::BIGINT AS negatives
              FROM points WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), g AS (PARTITION BY {keys})),
    places AS (SELECT {keys}, score, label, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC) AS i FROM {source}),
    tie AS (SELECT {keys}, score, avg(label) * sum(1 / log2(i + 1)) AS gain FROM places GROUP BY {keys}, score),
    ideal AS (SELECT {keys}, sum(CASE WHEN i <= p THEN 1 / log2(i + 1) ELSE 0 END) AS best FROM
              (SELECT {keys}, i, sum(label) OVER (PARTITION BY {keys}) AS p FROM places) GROUP BY {keys}),
    summary AS (
        SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.positives, a.negatives,
               round(CASE WHEN a.positives * a.negatives > 0 THEN a.won / (a.positives::DOUBLE * a.negatives) END, 9) AS roc_auc,
               round(CASE WHEN a.positives > 0 THEN a.area / a.positives ELSE 0 END, 9) AS ap,
               round(CASE WHEN a.positives > 0 THEN a.dcg / b.best ELSE 0 END, 9) AS ndcg
        FROM (SELECT {', '.join('curve.' + k.strip() for k in keys.split(','))}, max(positives) AS positives, max(negatives) AS negatives,
                     sum(neg * (tp - pos / 2.0::DOUBLE)) AS won, sum(pos * tp / (tp + fp)::DOUBLE) AS area, sum(gain) AS dcg
              FROM curve JOIN tie USING ({keys}, score) GROUP BY ALL) a JOIN ideal b ON {on})"""


def curve_query(source, keys, select, needs):
    from registry.base import CTES
    tables = ", ".join(CTES[n] for n in needs.split())
    return f"WITH {tables}, {curve_sql(source, keys)}{'' if select.startswith(',') else ' '}{select}"


def curve_oracle(name, source, keys, select, needs):
    def add(fn):
        query(name)(fn)
        from registry.base import ORACLES
        ORACLES[name] = curve_query(source, ", ".join(keys), select, needs)
        return fn
    return add


@curve_oracle("ranking_metrics_by_fold", "predictions", KEYS, "SELECT * FROM summary", "predictions")
def ranking_metrics_by_fold(spark, sf):
    table = K.curves(predictions(spark, sf), "label", "score", KEYS)
    return rounded(K.curve_summary(table, KEYS), [*KEYS, "positives", "negatives"], ["roc_auc", "ap", "ndcg"])


@curve_oracle("ranking_metrics_lineitem", "lineitem_scores", ["model", "fold"], "SELECT * FROM summary",
              "lineitem_scores")
def ranking_metrics_lineitem(spark, sf):
    """Tens of thousands of distinct scores per group, and long ties at larger scales."""
    keys = ["model", "fold"]
    table = K.curves(lineitem_scores(spark, sf), "label", "score", keys)
    return rounded(K.curve_summary(table, keys), [*keys, "positives", "negatives"], ["roc_auc", "ap", "ndcg"])


@curve_oracle("hard_score_metrics", "hard", ["model", "fold"], "SELECT * FROM summary",
              "predictions hard")
def hard_score_metrics(spark, sf):
    """Baselines whose score is the decision itself: two long ties per group."""
    hard = predictions(spark, sf).select("model", "fold", "label", F.col("prediction").cast("double").alias("score"))
    table = K.curves(hard, "label", "score", ["model", "fold"])
    return rounded(K.curve_summary(table, ["model", "fold"]), ["model", "fold", "positives", "negatives"],
                   ["roc_auc", "ap", "ndcg"])


CORNERS = """corners AS (
    SELECT * FROM (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM curve
                   WINDOW w AS (PARTITION BY model ORDER BY score DESC))
    WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg)"""
# One point above every score: nothing is called positive there.
SWEPT = """swept AS (
    SELECT model, score AS threshold, tp, fp, positives - tp AS fn, negatives - fp AS tn FROM corners UNION ALL
    SELECT DISTINCT model, 'infinity'::DOUBLE, 0, 0, positives, negatives FROM corners)"""


@curve_oracle("roc_curve_points", "predictions", ["model"], f""", {CORNERS}, {SWEPT}
SELECT model, CASE WHEN threshold < 2 THEN threshold END AS threshold, round(fp / (fp + tn)::DOUBLE, 9) AS fpr,
       round(tp / (tp + fn)::DOUBLE, 9) AS tpr FROM swept""", "predictions")
def roc_curve_points(spark, sf):
    points = K.roc_points(K.curves(predictions(spark, sf), "label", "score", ["model"]), ["model"])
    finite = F.when(F.col("threshold") < 2, F.col("threshold"))
    return points.select("model", finite.alias("threshold"), F.round("fpr", 9).alias("fpr"),
                         F.round("tpr", 9).alias("tpr"))


@curve_oracle("precision_recall_points", "lineitem_scores", ["model", "fold"], """
SELECT model, fold, score AS threshold, round(tp / (tp + fp)::DOUBLE, 9) AS precision,
       round(tp / positives::DOUBLE, 9) AS recall FROM curve
UNION ALL SELECT DISTINCT model, fold, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM curve""", "lineitem_scores")
def precision_recall_points(spark, sf):
    keys = ["model", "fold"]
    points = K.pr_points(K.curves(lineitem_scores(spark, sf), "label", "score", keys), keys)
    return rounded(points, [*keys, "threshold"], ["precision", "recall"])


def _threshold_oracle(metric):
    value = metric_sql(metric)
    return f""", {CORNERS}, {SWEPT}
SELECT model, '{metric}' AS metric, CASE WHEN threshold < 2 THEN threshold END AS threshold, round(value, 9) AS value FROM (
  SELECT model, threshold, coalesce({value}, 0) AS value,
         row_number() OVER (PARTITION BY model ORDER BY coalesce({value}, 0) DESC, threshold DESC) AS rn FROM swept)
WHERE rn = 1"""


for _metric in K.SWEEP:
    @curve_oracle(f"best_threshold_{_metric}", "predictions", ["model"], _threshold_oracle(_metric), "predictions")
    def best_threshold(spark, sf, metric=_metric):
        best = K.best_threshold(K.curves(predictions(spark, sf), "label", "score", ["model"]), metric, ["model"])
        return best.select("model", F.lit(metric).alias("metric"),
                           F.when(F.col("threshold") < 2, F.col("threshold")).alias("threshold"),
                           F.round(metric, 9).alias("value"))


@curve_oracle("detailed_metrics", "predictions", KEYS, f"""
SELECT * EXCLUDE (prediction_rows) FROM (
  SELECT *, {METRICS_SQL} FROM (SELECT model, run, added, fold, count(*) AS prediction_rows, {COUNTS_SQL}
                                FROM predictions GROUP BY ALL)) JOIN summary USING (model, run, added, fold)""",
              "predictions")
def detailed_metrics(spark, sf):
    out = K.detailed_metrics(predictions(spark, sf), "label", "prediction", "score", KEYS)
    return rounded(out, [*KEYS, *C.COUNTS, "positives", "negatives"], [*C.METRICS, "roc_auc", "ap", "ndcg"])


@query("naive_baselines", f"""
SELECT approach, run, fold, tn, fp, fn, tp, {METRICS_SQL}, 0.5::DOUBLE AS roc_auc,
       round((tp + fn) / (tn + fp + fn + tp)::DOUBLE, 9) AS ap,
       round((tp + fn) * (SELECT sum(1 / log2(i + 1)) FROM range(1, tn + fp + fn + tp + 1) r(i)) / (tn + fp + fn + tp)
             / (SELECT sum(1 / log2(i + 1)) FROM range(1, tp + fn + 1) r(i)), 9) AS ndcg
FROM (SELECT 'always pos' AS approach, run, fold, 0::BIGINT AS tn, n AS fp, 0::BIGINT AS fn, p AS tp FROM held UNION ALL
      SELECT 'always neg', run, fold, n, 0::BIGINT, p, 0::BIGINT FROM held)""", "predictions held")
def naive_baselines(spark, sf):
    rows = predictions(spark, sf).where((F.col("model") == "bert-base") & (F.col("added") == 0))
    out = K.naive_baselines(rows, "label", ["run", "fold"])
    return rounded(out, ["approach", "run", "fold", *C.COUNTS], [*C.METRICS, "roc_auc", "ap", "ndcg"])
