"""Comparison of models over their fold metrics, rank tests, rater agreement, search trials."""

from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.operators import agreement as A
from gleaner.operators import compare as M
from gleaner.operators import ranktests as R
from registry.base import CTES, MODELS, fold_metrics, query, table

METRICS = ["f1", "recall", "precision", "accuracy", "mcc"]
FM = "predictions cells fold_metrics"
LONG = "long AS (UNPIVOT fold_metrics ON f1, recall, precision, accuracy, mcc INTO NAME metric VALUE value)"


def with_metrics(select, *more):
    return f"WITH {', '.join([CTES[n] for n in FM.split()] + list(more))} {select}"


def r6(df, keep, names):
    return df.select(*keep, *[F.round(n, 6).alias(n) for n in names])


def long_metrics(spark, sf):
    return M.melt(fold_metrics(spark, sf), ["model", "added", "run", "fold"], METRICS)


@query("mean_metrics_by_model", f"""
SELECT model, added, {', '.join(f'round(avg({m}), 4) AS {m}' for m in METRICS)} FROM fold_metrics GROUP BY model, added""", FM)
def mean_metrics_by_model(spark, sf):
    return M.mean_metrics(fold_metrics(spark, sf), ["model", "added"], METRICS)


@query("metric_description", """
SELECT model, count(f1) AS count, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, min(f1) AS min, max(f1) AS max
FROM fold_metrics GROUP BY model""", FM)
def metric_description(spark, sf):
    return r6(M.describe(fold_metrics(spark, sf), ["model"], "f1"), ["model", "count", "min", "max"], ["mean", "std"])


@query("metric_interval", """
SELECT model, round(avg(accuracy), 6) AS mean, round(avg(accuracy) - h, 6) AS ci_low, round(avg(accuracy) + h, 6) AS ci_high
FROM (SELECT *, 1.959963984540054 * stddev_samp(accuracy) OVER (PARTITION BY model) / sqrt(count(accuracy) OVER (PARTITION BY model)) AS h
      FROM fold_metrics) GROUP BY model, h""", FM)
def metric_interval(spark, sf):
    return r6(M.mean_interval(fold_metrics(spark, sf), ["model"], "accuracy"), ["model"], ["mean", "ci_low", "ci_high"])


@query("best_model_per_configuration", """
SELECT added, model, round(m, 6) AS mean_score, round(s, 6) AS std_score FROM (
  SELECT *, row_number() OVER (PARTITION BY added ORDER BY m DESC, model) AS rn FROM (
    SELECT added, model, round(avg(accuracy), 9) AS m, stddev_samp(accuracy) AS s FROM fold_metrics GROUP BY added, model)) WHERE rn = 1""", FM)
def best_model_per_configuration(spark, sf):
    out = M.best_by_mean(fold_metrics(spark, sf), ["added"], ["model"], "accuracy")
    return r6(out, ["added", "model"], ["mean_score", "std_score"])


@query("best_per_family", """
SELECT family, model, round(m, 6) AS mean_score FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY m DESC, model) AS rn FROM (
    SELECT model, CASE WHEN contains(lower(model), 'roberta') THEN 'RoBERTa' WHEN contains(lower(model), 'biomedbert') THEN 'BiomedBERT-A'
             WHEN contains(lower(model), 'biobert') THEN 'BioBERT' ELSE 'Other' END AS family, round(avg(f1), 9) AS m
    FROM fold_metrics GROUP BY ALL)) WHERE rn = 1""", FM)
def best_per_family(spark, sf):
    named = fold_metrics(spark, sf).withColumn("family", L.model_family(F.col("model")))
    return r6(M.best_by_mean(named, ["family"], ["model"], "f1"), ["family", "model"], ["mean_score"])


@query("best_row_per_fold", """
SELECT fold, model, added, run, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY accuracy DESC, model, added, run) AS rn FROM fold_metrics) WHERE rn = 1""", FM)
def best_row_per_fold(spark, sf):
    out = M.best_row(fold_metrics(spark, sf), ["fold"], "accuracy", ["model", "added", "run"])
    return out.select("fold", "model", "added", "run", "accuracy")


@query("leaderboard", """
SELECT model, added, config, f1 FROM (SELECT model, added, 'BCE_with_title_' || added AS config, round(avg(f1), 4) AS f1
FROM fold_metrics GROUP BY model, added) ORDER BY f1 DESC, model, added LIMIT 8""", FM)
def leaderboard(spark, sf):
    means = M.mean_metrics(fold_metrics(spark, sf), ["model", "added"], ["f1"])
    named = means.withColumn("config", L.config_label(F.lit("BCE"), F.lit(True), F.col("added")))
    return M.leaderboard(named, "f1", ["model", "added"], 8)


@query("condition_difference", with_metrics("""
SELECT model, metric, round(b, 6) AS mean_base, round(o, 6) AS mean_other, round(sb, 6) AS std_base, round(so, 6) AS std_other,
       round(o - b, 6) AS difference, round(CASE WHEN b <> 0 THEN 100 * (o - b) / b END, 6) AS change_pct FROM (
  SELECT model, metric, avg(value) FILTER (added = 500) AS b, avg(value) FILTER (added = 0) AS o,
         stddev_samp(value) FILTER (added = 500) AS sb, stddev_samp(value) FILTER (added = 0) AS so FROM long GROUP BY ALL)""", LONG))
def condition_difference(spark, sf):
    out = M.condition_difference(long_metrics(spark, sf), ["model", "metric"], "added", 500, 0)
    names = ["mean_base", "mean_other", "std_base", "std_other", "difference", "change_pct"]
    return out.select("model", "metric", *[F.round(n, 6).alias(n) for n in names])


@query("improvement_matrix", with_metrics(
    "SELECT model, " + ", ".join(
        f"round(100 * (avg({m}) FILTER (added = 0) - avg({m}) FILTER (added = 500)) / avg({m}) FILTER (added = 500), 6) AS {m}"
        for m in METRICS) + " FROM fold_metrics GROUP BY model"))
def improvement_matrix(spark, sf):
    differences = M.condition_difference(long_metrics(spark, sf), ["model", "metric"], "added", 500, 0)
    out = M.improvement_matrix(differences, "model", METRICS)
    return out.select("model", *[F.round(m, 6).alias(m) for m in METRICS])


@query("fold_by_model_matrix", "SELECT fold, " + ", ".join(
    f"""round(avg(f1) FILTER (model = '{m}'), 6) AS "{m}" """ for m in MODELS) + " FROM fold_metrics GROUP BY fold", FM)
def fold_by_model_matrix(spark, sf):
    out = M.fold_matrix(fold_metrics(spark, sf), "f1", MODELS)
    return out.select("fold", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in MODELS])


def box_sql(source, keys):
    return f"""
SELECT {keys}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       round(avg(value), 6) AS mean, count(*) AS n,
       count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM {source} JOIN (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                           quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY {keys}) USING ({keys})
GROUP BY {keys}, q1, median, q3"""


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high", "mean"]


@query("metric_boxes", with_metrics(box_sql("long", "model, metric"), LONG))
def metric_boxes(spark, sf):
    out = M.box_summary(long_metrics(spark, sf), ["model", "metric"])
    return out.select("model", "metric", "n", "outliers", *[F.round(c, 6).alias(c) for c in BOX])


@query("price_boxes", "WITH prices AS (SELECT o_orderpriority, o_totalprice AS value FROM orders) "
       + box_sql("prices", "o_orderpriority"))
def price_boxes(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("value"))
    out = M.box_summary(rows, ["o_orderpriority"])
    return out.select("o_orderpriority", "n", "outliers", *[F.round(c, 6).alias(c) for c in BOX])


def phi_sql(x):
    """The normal distribution function, by Simpson's rule from 0."""
    return (f"(0.5 + ({x}) / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda i: "
            f"(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(({x}) * i / 400, 2) / 2))))")


RANKS = """ranks AS (
    SELECT added, run, fold, model, value, rank() OVER w + (count(*) OVER t - 1) / 2.0::DOUBLE AS rank_up, count(*) OVER t AS ties,
           rank() OVER d + (count(*) OVER t - 1) / 2.0::DOUBLE AS rank_down
    FROM (SELECT added, run, fold, model, accuracy AS value FROM fold_metrics)
    WINDOW w AS (PARTITION BY added, run, fold ORDER BY value), d AS (PARTITION BY added, run, fold ORDER BY value DESC),
           t AS (PARTITION BY added, run, fold, value))"""


@query("model_ranks_in_folds", with_metrics(
    "SELECT added, run, fold, model, rank_down AS rank FROM ranks", RANKS))
def model_ranks_in_folds(spark, sf):
    out = R.block_ranks(fold_metrics(spark, sf), ["added", "run", "fold"], "model", "accuracy")
    return out.select("added", "run", "fold", "model", "rank")


@query("friedman_test", with_metrics("""
SELECT added, k, n, round(stat, 6) AS statistic, round(p, 9) AS p_value,
       CASE WHEN p < 0.001 THEN 'highly significant' WHEN p < 0.01 THEN 'very significant' WHEN p < 0.05 THEN 'significant'
            ELSE 'not significant' END AS verdict FROM (SELECT *, exp(-stat / 2) * (1 + stat / 2) AS p FROM (
  SELECT added, k, n, (12.0::DOUBLE / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / (1 - tied / (n * k * (k * k - 1))::DOUBLE) AS stat
  FROM (SELECT added, count(*) AS k, max(blocks) AS n, sum(s * s) AS squares, sum(tied) AS tied FROM (
    SELECT added, model, sum(rank_up) AS s, count(*) AS blocks, sum(ties * ties - 1) AS tied FROM ranks GROUP BY added, model)
  GROUP BY added)))""", RANKS))
def friedman_test(spark, sf):
    out = R.friedman(fold_metrics(spark, sf), ["run", "fold"], "model", "accuracy", ["added"])
    return out.select("added", "k", "n", F.round("statistic", 6).alias("statistic"), F.round("p_value", 9).alias("p_value"),
                      L.significance(F.col("p_value")).alias("verdict"))


CONDITIONS = """conditions AS (
  SELECT model, fold, run * 2 + (added > 0)::INT AS condition, accuracy AS value FROM fold_metrics),
placed AS (
  SELECT condition, value, rank() OVER w + (count(*) OVER t - 1) / 2.0::DOUBLE AS up, count(*) OVER t AS ties FROM conditions
  WINDOW w AS (PARTITION BY model, fold ORDER BY value), t AS (PARTITION BY model, fold, value)),
tested AS (
  SELECT k, n, (12.0::DOUBLE / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / (1 - tied / (n * k * (k * k - 1))::DOUBLE) AS stat FROM (
    SELECT count(*) AS k, max(blocks) AS n, sum(s * s) AS squares, sum(tied) AS tied FROM (
      SELECT condition, sum(up) AS s, count(*) AS blocks, sum(ties * ties - 1) AS tied FROM placed GROUP BY condition)))"""


@query("friedman_conditions", with_metrics(f"""
SELECT k, n, round(stat, 6) AS statistic, round(2 * (1 - {phi_sql('sqrt(stat)')}) + sqrt(2 * stat / pi()) * exp(-stat / 2), 8) AS p_value FROM tested""", CONDITIONS))
def friedman_conditions(spark, sf):
    """Four conditions over all models and folds: an odd number of degrees of freedom."""
    rows = fold_metrics(spark, sf).withColumn("condition", F.col("run") * 2 + (F.col("added") > 0).cast("int"))
    out = R.friedman(rows, ["model", "fold"], "condition", "accuracy")
    return out.select("k", "n", F.round("statistic", 6).alias("statistic"), F.round("p_value", 8).alias("p_value"))


@query("average_ranks", with_metrics("""
SELECT model, round(avg(rank_down), 6) AS avg_rank, round(avg(value), 6) AS mean_value, count(*) AS blocks FROM ranks GROUP BY model""", RANKS))
def average_ranks(spark, sf):
    out = R.average_ranks(fold_metrics(spark, sf), ["added", "run", "fold"], "model", "accuracy")
    return r6(out, ["model", "blocks"], ["avg_rank", "mean_value"])


# Fixed value: studentized range at .05 for 5 groups over the root of 2, as published (2.728).
PAIRS_SQL = """pairs AS (
SELECT a.model AS model_a, b.model AS model_b, abs(a.r - b.r) AS d, abs(a.r - b.r) / sqrt(30 / (6.0 * a.n)) AS q, 2.728 * sqrt(30 / (6.0 * a.n)) AS cd
FROM (SELECT model, avg(rank_down) AS r, count(*) AS n FROM ranks GROUP BY model) a
JOIN (SELECT model, avg(rank_down) AS r FROM ranks GROUP BY model) b ON a.model < b.model)"""
TAILS_SQL = f"""nodes AS (SELECT j, -9 + j * 0.045::DOUBLE AS z, CASE WHEN j IN (0, 400) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 401) t(j)),
tails AS (
SELECT model_a, model_b, 1 - 5 * 0.045::DOUBLE / 3 * sum(w * exp(-z * z / 2) / sqrt(2 * pi()) * power({phi_sql('z')} - {phi_sql('z - q * sqrt(2)')}, 4)) AS p
FROM pairs, nodes GROUP BY ALL)"""


@query("nemenyi_pairs", with_metrics("""
SELECT model_a, model_b, round(d, 6) AS rank_difference, round(q, 6) AS q, round(cd, 3) AS critical_difference, d >= cd AS significant,
       abs(round(p, 6)) AS p_value FROM pairs JOIN tails USING (model_a, model_b)""", RANKS, PAIRS_SQL, TAILS_SQL))
def nemenyi_pairs(spark, sf):
    out = R.nemenyi(fold_metrics(spark, sf), ["added", "run", "fold"], "model", "accuracy")
    return out.select("model_a", "model_b", F.round("rank_difference", 6).alias("rank_difference"), F.round("q", 6).alias("q"),
                      F.round("critical_difference", 3).alias("critical_difference"), "significant", F.round("p_value", 6).alias("p_value"))


@query("undistinguished_models", with_metrics("""
SELECT round(best_rank, 6) AS best_rank, round(worst_rank, 6) AS worst_rank, members, treatments FROM (
  SELECT a.r AS best_rank, max(b.r) AS worst_rank, count(*) AS members, string_agg(b.model, ', ' ORDER BY b.r, b.model) AS treatments
  FROM means a JOIN means b ON b.r >= a.r AND b.r - a.r < 2.728 * sqrt(30 / (6.0 * a.n)) GROUP BY a.model, a.r)
WHERE members > 1 QUALIFY row_number() OVER (PARTITION BY worst_rank ORDER BY best_rank) = 1""", RANKS, """means AS (
SELECT model, avg(rank_down) AS r, count(*) AS n FROM ranks GROUP BY model)"""))
def undistinguished_models(spark, sf):
    """Models whose average ranks lie within one critical difference."""
    out = R.undistinguished(fold_metrics(spark, sf), ["added", "run", "fold"], "model", "accuracy")
    return out.select(F.round("best_rank", 6).alias("best_rank"), F.round("worst_rank", 6).alias("worst_rank"), "members",
                      F.concat_ws(", ", "treatments").alias("treatments"))


Z_SQL = """(greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * ((n + 1) - ties / (n * (n - 1))::DOUBLE))"""


@query("mann_whitney_domains", with_metrics(f"""
SELECT metric, n1, n2, u, round(z, 6) AS z, round(least(1.0::DOUBLE, 2 * (1 - {phi_sql('greatest(z, 0)')})), 8) AS p_value FROM (SELECT *, {Z_SQL} AS z FROM (
  SELECT metric, sum(a)::BIGINT AS n1, sum(1 - a)::BIGINT AS n2, count(*) AS n,
         sum(a * r) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u, sum(t * t - 1) AS ties FROM (
    SELECT metric, contains(lower(model), 'bio')::INT AS a, rank() OVER (PARTITION BY metric ORDER BY value)
           + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS r,
           count(*) OVER (PARTITION BY metric, value) AS t FROM long) GROUP BY metric))""", LONG))
def mann_whitney_domains(spark, sf):
    named = long_metrics(spark, sf).withColumn("domain", L.model_domain(F.col("model")))
    out = R.mann_whitney(named, "domain", "In-Domain", "Out-of-Domain", "value", ["metric"])
    return out.select("metric", "n1", "n2", "u", F.round("z", 6).alias("z"), F.round("p_value", 8).alias("p_value"))


@query("mann_whitney_customers", f"""
WITH RECURSIVE sided AS (SELECT o_custkey, (o_orderstatus = 'O')::INT AS a, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('O', 'F')),
tests AS (
  SELECT o_custkey, sum(a)::BIGINT AS n1, sum(1 - a)::BIGINT AS n2, count(*) AS n, sum(a * r) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u,
         sum(t * t - 1) AS ties FROM (
    SELECT o_custkey, a, rank() OVER (PARTITION BY o_custkey ORDER BY v) + (count(*) OVER (PARTITION BY o_custkey, v) - 1) / 2.0::DOUBLE AS r,
           count(*) OVER (PARTITION BY o_custkey, v) AS t FROM sided) GROUP BY o_custkey),
ways AS (
  SELECT 0 AS n, 0 AS a, 0 AS s, 1::DOUBLE AS ways
  UNION ALL
  SELECT n, a, s, sum(ways) FROM (
    SELECT n + 1 AS n, a + x AS a, s + x * (n + 1) AS s, ways FROM ways, (VALUES (0), (1)) t(x)
    WHERE n < (SELECT max(n) FROM tests) AND a + x <= 8) GROUP BY n, a, s),
shares AS (SELECT n, a, s - a * (a + 1) / 2 AS u, ways / sum(ways) OVER (PARTITION BY n, a) AS share FROM ways),
exact AS (
  SELECT o_custkey, least(1.0::DOUBLE, 2 * sum(share)) AS p FROM tests t JOIN shares w ON w.n = t.n AND w.a = least(n1, n2) AND w.u >= greatest(t.u, n1 * n2 - t.u)
  WHERE ties = 0 AND least(n1, n2) BETWEEN 1 AND 8 AND n1 * n2 <= 2000 GROUP BY o_custkey)
SELECT t.o_custkey, n1, n2, u, round(coalesce(p, least(1.0::DOUBLE, 2 * (1 - {phi_sql(f'greatest({Z_SQL}, 0)')}))), 8) AS p_value,
       CASE WHEN p IS NULL THEN 'asymptotic' ELSE 'exact' END AS method FROM tests t LEFT JOIN exact USING (o_custkey) WHERE least(n1, n2) > 0""")
def mann_whitney_customers(spark, sf):
    """Open against filled orders of every customer: small samples with an exact p-value, larger ones with the normal one."""
    out = R.mann_whitney(table(spark, sf, "orders"), "o_orderstatus", "O", "F", "o_totalprice", ["o_custkey"])
    return out.where("least(n1, n2) > 0").select("o_custkey", "n1", "n2", "u", F.round("p_value", 8).alias("p_value"), "method")


@query("mann_whitney_prices", """
SELECT l_linestatus, n1, n2, u FROM (
  SELECT l_linestatus, sum(a)::BIGINT AS n1, sum(1 - a)::BIGINT AS n2, sum(a * r) - sum(a) * (sum(a) + 1) / 2.0::DOUBLE AS u FROM (
    SELECT l_linestatus, (l_returnflag = 'R')::INT AS a, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice)
           + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0::DOUBLE AS r
    FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY l_linestatus)""")
def mann_whitney_prices(spark, sf):
    out = R.mann_whitney(table(spark, sf, "lineitem"), "l_returnflag", "R", "A", "l_extendedprice", ["l_linestatus"])
    return out.select("l_linestatus", "n1", "n2", "u")


@query("domain_effect_size", with_metrics("""
SELECT metric, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS d,
       CASE WHEN abs(d) < 0.2 THEN 'small' WHEN abs(d) < 0.5 THEN 'small to medium' WHEN abs(d) < 0.8 THEN 'medium to large' ELSE 'large' END AS size
FROM (SELECT *, (ma - mb) / sqrt((va + vb) / 2) AS d FROM (
  SELECT metric, avg(value) FILTER (bio) AS ma, avg(value) FILTER (NOT bio) AS mb, var_pop(value) FILTER (bio) AS va,
         var_pop(value) FILTER (NOT bio) AS vb FROM (SELECT *, contains(lower(model), 'bio') AS bio FROM long) GROUP BY metric))""", LONG))
def domain_effect_size(spark, sf):
    named = long_metrics(spark, sf).withColumn("domain", L.model_domain(F.col("model")))
    out = R.cohens_d(named, "domain", "In-Domain", "Out-of-Domain", "value", ["metric"])
    return out.select("metric", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                      F.round("d", 6).alias("d"), L.effect_size(F.col("d")).alias("size"))


def ratings(spark, sf):
    """Two raters per document and language: its quality, and whether it is not toxic."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("criterion"))
    both = table(spark, sf, "labels").join(docs, "doc_id")
    cells = F.explode(F.array(
        F.struct(F.lit("first").alias("rater"), F.when(F.col("doc_id") % 9 != 0, F.col("quality").cast("string")).alias("rating")),
        F.struct(F.lit("second").alias("rater"), (1 - F.col("toxic")).cast("string").alias("rating"))))
    return both.select("doc_id", "criterion", cells.alias("c")).select("doc_id", "criterion", "c.rater", "c.rating")


KAPPA = """pairs AS (
    SELECT d.lang AS criterion, quality AS a, 1 - toxic AS b FROM labels l JOIN documents d USING (doc_id) WHERE doc_id % 9 <> 0),
kappas AS (SELECT criterion, agreements, total, 100.0::DOUBLE * agreements / total AS agreement_pct,
       CASE WHEN pe < 1 THEN (agreements / total::DOUBLE - pe) / (1 - pe) ELSE 1.0 END AS kappa FROM (
  SELECT criterion, sum((a = b)::INT)::BIGINT AS agreements, count(*) AS total,
         (sum(a) * sum(b) + sum(1 - a) * sum(1 - b)) / (count(*) * count(*))::DOUBLE AS pe FROM pairs GROUP BY criterion))"""


def kappas(spark, sf):
    return A.rater_kappa(A.rating_pairs(ratings(spark, sf), ["doc_id", "criterion"], ("first", "second")), ["criterion"])


@query("rater_kappa", f"""WITH {KAPPA}
SELECT criterion, agreements, total, round(agreement_pct, 6) AS agreement_pct, round(kappa, 6) AS kappa,
       CASE WHEN kappa >= 0.81 THEN 'Almost Perfect' WHEN kappa >= 0.61 THEN 'Substantial' WHEN kappa >= 0.41 THEN 'Moderate'
            WHEN kappa >= 0.21 THEN 'Fair' ELSE 'Slight/Poor' END AS interpretation FROM kappas""")
def rater_kappa(spark, sf):
    return r6(kappas(spark, sf), ["criterion", "agreements", "total", "interpretation"], ["agreement_pct", "kappa"])


@query("mean_rater_kappa", f"""WITH {KAPPA}
SELECT round(avg(kappa) FILTER (kappa < 1), 6) AS mean_kappa, count(*) FILTER (kappa < 1) AS criteria FROM kappas""")
def mean_rater_kappa(spark, sf):
    return r6(A.mean_kappa(kappas(spark, sf)), ["criteria"], ["mean_kappa"])


# Users run trials, their events report the metric in order, and the JSON scalar picks the parameters.
TRIALS = """trials AS (
    SELECT user_id AS trial_id, event_id AS training_iteration, ((props::JSON->>'k')::BIGINT % 5) / 4.0::DOUBLE AS alpha,
           ((props::JSON->>'k')::BIGINT % 3)::DOUBLE AS gamma, value AS metric FROM events)"""


def trials(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trial_id"), F.col("event_id").alias("training_iteration"),
        ((k % 5) / F.lit(4.0)).alias("alpha"), (k % 3).cast("double").alias("gamma"), F.col("value").alias("metric"))


@query("final_metric_per_trial", f"""WITH {TRIALS}
SELECT trial_id, arg_max(metric, training_iteration) AS metric, max(training_iteration) AS training_iteration FROM trials GROUP BY trial_id""")
def final_metric_per_trial(spark, sf):
    return M.final_per_trial(trials(spark, sf), "metric")


@query("best_trial", f"""WITH {TRIALS}
SELECT trial_id, metric, training_iteration FROM (SELECT trial_id, arg_max(metric, training_iteration) AS metric,
  max(training_iteration) AS training_iteration FROM trials GROUP BY trial_id) ORDER BY metric DESC, trial_id LIMIT 1""")
def best_trial(spark, sf):
    return M.best_trial(trials(spark, sf), "metric")


@query("metric_by_parameter_cell", f"""WITH {TRIALS}
SELECT alpha, gamma, round(avg(metric), 6) AS metric, count(*) AS n FROM trials GROUP BY alpha, gamma""")
def metric_by_parameter_cell(spark, sf):
    out = M.metric_by_cell(trials(spark, sf), ["alpha", "gamma"], "metric")
    return out.withColumn("metric", F.round("metric", 6))


@query("normalized_trial_metric", f"""WITH {TRIALS}
SELECT trial_id, training_iteration, alpha, gamma, round((metric - min(metric) OVER ()) / (max(metric) OVER () - min(metric) OVER ()), 9) AS metric
FROM trials""")
def normalized_trial_metric(spark, sf):
    out = M.normalized_metric(trials(spark, sf), "metric", ["alpha", "gamma"])
    return out.withColumn("metric", F.round("metric", 9))


@query("loss_by_epoch", """
SELECT floor(event_id / 1000)::BIGINT AS epoch, round(avg(value) FILTER (event_type <> 'error'), 6) AS loss,
       round(avg(value) FILTER (event_type = 'error'), 6) AS eval_loss FROM events GROUP BY 1""")
def loss_by_epoch(spark, sf):
    is_eval = F.col("event_type") == "error"
    log = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 1000).alias("epoch"), F.when(~is_eval, F.col("value")).alias("loss"),
        F.when(is_eval, F.col("value")).alias("eval_loss"))
    out = M.loss_by_epoch(log)
    return out.select("epoch", F.round("loss", 6).alias("loss"), F.round("eval_loss", 6).alias("eval_loss"))


@query("title_keyword_labels", with_metrics("""
SELECT config, round(avg(f1), 6) AS f1 FROM (
  SELECT f1, CASE WHEN added = 0 THEN 'True' ELSE 'False' END || ' / ' || CASE WHEN run = 0 THEN 'True' ELSE 'False' END AS config
  FROM fold_metrics) GROUP BY config"""))
def title_keyword_labels(spark, sf):
    label = L.title_keyword_label(F.col("added") == 0, F.col("run") == 0)
    out = M.mean_metrics(fold_metrics(spark, sf).withColumn("config", label), ["config"], ["f1"], 6)
    return out
