"""Scoring results: ensemble statistics, ranks, levels, filters, displays, summaries."""

from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.functions.ensemble import ensemble_result
from gleaner.functions.losses import bce_with_logits, sigmoid, sigmoid_focal
from gleaner.operators import scores as S
from gleaner.operators.ordering import ranked
from gleaner.session import materialize
from registry.base import fold_scores, predictions, query, table

LEVEL_SQL = """CASE WHEN score IS NULL THEN NULL WHEN score >= 0.8 THEN 'High Relevance'
    WHEN score >= 0.6 THEN 'Medium-High Relevance' WHEN score >= 0.4 THEN 'Medium Relevance'
    WHEN score >= 0.2 THEN 'Low Relevance' ELSE 'Very Low Relevance' END"""


def scored_records(spark, sf):
    """All documents with their ensemble columns, unscored ones with NULLs."""
    base = fold_scores(spark, sf)
    result = F.when(F.col("valid"), ensemble_result(F.col("scores")))
    out = base.select("id", "title", "abstract", "valid", result.alias("r"))
    return out.select("id", "title", "abstract", "valid", F.col("r.ensemble_score").alias("score"),
                      F.col("r.ensemble_prediction").alias("prediction"), F.col("r.fold_scores").alias("fold_scores"),
                      "r.statistics.*")


@query("scored_ranking", f"""
SELECT id, valid, round(score, 9) AS ensemble_score, (score > 0.5)::INT AS ensemble_prediction,
       round(std_score, 9) AS std_score, min_score, max_score, positive_folds,
       greatest(positive_folds, 5 - positive_folds) / 5.0::DOUBLE AS consensus_strength,
       CASE WHEN score IS NOT NULL THEN rank() OVER (ORDER BY score DESC NULLS LAST) END AS score_rank,
       CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score DESC NULLS LAST, id) END AS position,
       {LEVEL_SQL} AS level
FROM ensembled""", "scored ensembled")
def scored_ranking(spark, sf):
    out = materialize(scored_records(spark, sf).drop("title", "abstract", "fold_scores"), "scored")
    out = ranked(out, "score", "id", rank="score_rank", position="position")
    return out.select("id", "valid", F.round("score", 9).alias("ensemble_score"),
                      F.col("prediction").alias("ensemble_prediction"), F.round("std_score", 9).alias("std_score"),
                      "min_score", "max_score", "positive_folds", "consensus_strength", "score_rank", "position",
                      L.relevance_level(F.col("score")).alias("level"))


@query("ensemble_long_form", """
SELECT id, round(avg(s), 9) AS ensemble_score, round(stddev_pop(s), 9) AS std_score, min(s) AS min_score,
       max(s) AS max_score, sum((s > 0.5)::INT)::BIGINT AS positive_folds,
       greatest(sum((s > 0.5)::INT), 5 - sum((s > 0.5)::INT)) / 5.0::DOUBLE AS consensus_strength,
       (avg(s) > 0.5)::INT AS ensemble_prediction
FROM (SELECT id, unnest([s0, s1, s2, s3, s4]) AS s FROM scored) GROUP BY id""", "scored")
def ensemble_long_form(spark, sf):
    rows = fold_scores(spark, sf).select("id", F.posexplode("scores").alias("fold", "score"))
    out = S.ensemble_rows(rows, ["id"])
    return out.select("id", F.round("ensemble_score", 9).alias("ensemble_score"),
                      F.round("std_score", 9).alias("std_score"), "min_score", "max_score", "positive_folds",
                      "consensus_strength", "ensemble_prediction")


@query("rank_orders_by_price", """
SELECT o_orderkey, rank() OVER (ORDER BY score DESC) AS score_rank,
       row_number() OVER (ORDER BY score DESC, o_orderkey) AS position,
       rank() OVER (PARTITION BY o_orderstatus ORDER BY score DESC) AS status_rank
FROM (SELECT *, floor(o_totalprice / 1000) AS score FROM orders)""")
def rank_orders_by_price(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus",
                                               F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"))
    out = materialize(ranked(orders, "score", "o_orderkey", rank="score_rank", position="position"), "ranked")
    out = ranked(out, "score", "o_orderkey", ["o_orderstatus"], rank="status_rank")
    return out.select("o_orderkey", "score_rank", "position", "status_rank")


@query("typed_ranks", """
WITH wide AS (
  SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderkey % 11 <> 0 THEN 9007199254740992 + o_custkey % 7 END AS code,
         CAST(floor(o_totalprice)::BIGINT || '0000000000000000' || (o_orderkey % 3) AS DECIMAL(38, 0)) AS amount, o_orderdate, o_orderpriority FROM orders)
SELECT o_orderkey, CASE WHEN code IS NOT NULL THEN rank() OVER (ORDER BY code DESC NULLS LAST) END AS code_rank,
       CASE WHEN code IS NOT NULL THEN row_number() OVER (ORDER BY code DESC NULLS LAST, o_orderkey) END AS code_position,
       rank() OVER (PARTITION BY status ORDER BY amount) AS amount_rank,
       row_number() OVER (PARTITION BY status ORDER BY o_orderdate DESC, o_orderkey) AS date_position,
       rank() OVER (PARTITION BY status ORDER BY o_orderpriority DESC) AS priority_rank
FROM wide""")
def typed_ranks(spark, sf):
    """Whole numbers above 2^53, decimals of more than 20 digits, timestamps and strings; one group is NULL."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(key % 11 != 0, F.lit(1 << 53) + F.col("o_custkey") % 7).alias("code"),
        F.concat(F.floor(price).cast("string"), F.lit("0" * 16), (key % 3).cast("string")).cast("decimal(38,0)").alias("amount"),
        "o_orderdate", "o_orderpriority")
    out = ranked(orders, "code", "o_orderkey", rank="code_rank", position="code_position")
    out = ranked(out, "amount", "o_orderkey", ["status"], rank="amount_rank", descending=False)
    out = ranked(out, "o_orderdate", "o_orderkey", ["status"], position="date_position")
    out = ranked(out, "o_orderpriority", "o_orderkey", ["status"], rank="priority_rank")
    return out.select("o_orderkey", "code_rank", "code_position", "amount_rank", "date_position", "priority_rank")


@query("null_group_summaries", """
SELECT flag, round(avg(p), 6) AS mean, median(p) AS median, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.75) AS q75, count(*) AS count
FROM (SELECT nullif(l_returnflag, 'N') AS flag, floor(l_extendedprice) AS p FROM lineitem) GROUP BY flag""")
def null_group_summaries(spark, sf):
    """A summary in which rows without a group are a group."""
    lines = table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("flag"),
                                                F.floor("l_extendedprice").cast("double").alias("p"))
    out = S.score_summary(lines, "p", ["flag"])
    return out.select("flag", F.round("mean", 6).alias("mean"), "median", "q25", "q75", "count")


@query("null_group_ranks", """
SELECT o_orderkey, rank() OVER (PARTITION BY status ORDER BY price DESC) AS price_rank,
       row_number() OVER (PARTITION BY status ORDER BY price DESC, o_orderkey) AS position
FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, floor(o_totalprice / 1000) AS price FROM orders)""")
def null_group_ranks(spark, sf):
    """Ranks inside groups of which one is NULL."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"),
                                               F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price"))
    out = ranked(orders, "price", "o_orderkey", ["status"], rank="price_rank", position="position")
    return out.select("o_orderkey", "price_rank", "position")


@query("score_filters", """
SELECT 'between' AS rule, count(*) AS n, sum(id)::BIGINT AS id_sum FROM ensembled WHERE score BETWEEN 0.25 AND 0.75
UNION ALL
SELECT 'at_least', count(*), sum(id)::BIGINT FROM ensembled WHERE score IS NULL OR score >= 0.6""", "scored ensembled")
def score_filters(spark, sf):
    rows = scored_records(spark, sf).select("id", "score")
    parts = [(S.score_between(rows, "score", 0.25, 0.75), "between"), (S.at_least(rows, "score", 0.6), "at_least")]
    a, b = [p.agg(F.lit(name).alias("rule"), F.count("*").alias("n"), F.sum("id").alias("id_sum")) for p, name in parts]
    return a.unionByName(b)


@query("sorted_by_score", """
SELECT id, round(score, 9) AS score FROM ensembled ORDER BY score DESC NULLS LAST, id""", "scored ensembled")
def sorted_by_score(spark, sf):
    rows = scored_records(spark, sf).select("id", "score")
    return S.by_score(rows, "score", "id").select("id", F.round("score", 9).alias("score"))


@query("display_columns", """
SELECT id AS original_index, CASE WHEN score IS NULL THEN 'N/A' ELSE printf('%.4f', score) END AS ensemble_score_formatted,
       CASE WHEN score IS NULL THEN 'N/A' ELSE printf('%.3f-%.3f', min_score, max_score) END AS score_range,
       CASE WHEN score IS NULL THEN 'N/A' ELSE printf('%.1f%%', 20.0 * greatest(positive_folds, 5 - positive_folds)) END AS consensus,
       CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '...' ELSE title END AS short_title
FROM ensembled""", "scored ensembled")
def display_columns(spark, sf):
    from gleaner.functions.text import shorten
    return scored_records(spark, sf).select(
        F.col("id").alias("original_index"), L.shown_number(F.col("score"), 4).alias("ensemble_score_formatted"),
        L.shown_range(F.col("min_score"), F.col("max_score")).alias("score_range"),
        L.shown_percent(F.col("consensus_strength")).alias("consensus"),
        shorten(F.col("title")).alias("short_title"))


@query("merged_back_to_input", """
SELECT id, valid, round(score, 9) AS ensemble_score, positive_folds FROM ensembled""", "scored ensembled")
def merged_back_to_input(spark, sf):
    base = fold_scores(spark, sf)
    result = ensemble_result(F.col("scores"))
    part = base.where("valid").select("id", result.alias("r")).select(
        "id", F.round("r.ensemble_score", 9).alias("ensemble_score"), "r.statistics.positive_folds")
    return S.merge_scores(base.select("id", "valid"), part, "id")


@query("batch_kpis", """
SELECT count(*) AS total, sum((score >= 0.6)::INT)::BIGINT AS high_relevance, round(avg(score), 9) AS average_score,
       round(max(score), 9) AS highest_score FROM ensembled""", "scored ensembled")
def batch_kpis(spark, sf):
    out = S.batch_kpis(scored_records(spark, sf), "score")
    return out.select("total", "high_relevance", F.round("average_score", 9).alias("average_score"),
                      F.round("highest_score", 9).alias("highest_score"))


@query("score_summary", """
SELECT round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, round(min(score), 9) AS min,
       round(max(score), 9) AS max, count(score) AS count, sum((score >= 0.6)::INT)::BIGINT AS high_count,
       sum((score >= 0.4 AND score < 0.6)::INT)::BIGINT AS medium_count, sum((score < 0.4)::INT)::BIGINT AS low_count,
       round(quantile_cont(score, 0.25), 9) AS q25, round(quantile_cont(score, 0.5), 9) AS median,
       round(quantile_cont(score, 0.75), 9) AS q75 FROM ensembled""", "scored ensembled")
def score_summary(spark, sf):
    out = S.score_summary(scored_records(spark, sf), "score")
    rounded = [F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max", "q25", "median", "q75")]
    return out.select("count", "high_count", "medium_count", "low_count", *rounded)


@query("price_quantiles_by_flag", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75
FROM lineitem GROUP BY 1""")
def price_quantiles_by_flag(spark, sf):
    from gleaner.operators.ordering import quantiles
    out = quantiles(table(spark, sf, "lineitem"), "l_extendedprice", {"q25": 0.25, "median": 0.5, "q75": 0.75},
                    ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


@query("score_histogram", """
SELECT least(floor(score * 20) + 1, 20)::BIGINT AS bin, count(*) AS n,
       round((least(floor(score * 20) + 1, 20) - 1) / 20.0::DOUBLE, 9) AS bin_start
FROM ensembled WHERE score BETWEEN 0 AND 1 GROUP BY ALL""", "scored ensembled")
def score_histogram(spark, sf):
    out = S.histogram(scored_records(spark, sf), "score", 0, 1, 20)
    return out.select("bin", "n", F.round("bin_start", 9).alias("bin_start"))


@query("discount_histogram_by_flag", """
SELECT l_returnflag, least(floor((l_quantity - 0) / 2.5) + 1, 20)::BIGINT AS bin, count(*) AS n
FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL""")
def discount_histogram_by_flag(spark, sf):
    return S.histogram(table(spark, sf, "lineitem"), "l_quantity", 0, 50, 20, ["l_returnflag"]).drop("bin_start")


@query("score_bands", """
SELECT CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS ranking_band,
       CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS relevance_band,
       count(*) AS n FROM ensembled WHERE score IS NOT NULL GROUP BY ALL""", "scored ensembled")
def score_bands(spark, sf):
    rows = scored_records(spark, sf).where("score is not null")
    return rows.groupBy(L.ranking_band(F.col("score")).alias("ranking_band"),
                        L.relevance_band(F.col("score")).alias("relevance_band")).agg(F.count("*").alias("n"))


@query("ensemble_across_models", """
SELECT run, added, fold, id, max(label) AS label, round(avg(score), 9) AS score, (avg(score) > 0.5)::INT AS prediction
FROM predictions GROUP BY run, added, fold, id""", "predictions")
def ensemble_across_models(spark, sf):
    out = S.ensemble_models(predictions(spark, sf), ["run", "added", "fold", "id"], 5)
    return out.select("run", "added", "fold", "id", "label", F.round("score", 9).alias("score"), "prediction")


@query("loss_by_model", """
SELECT model, round(avg((CASE WHEN label = 1 THEN 5.0 * ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END)), 9) AS bce,
       round(avg(CASE WHEN label = 1 THEN 0.25 * ln(1 + exp(-x)) * pow(1 - 1 / (1 + exp(-x)), 2)
                      ELSE 0.75 * ln(1 + exp(x)) * pow(1 / (1 + exp(-x)), 2) END), 9) AS focal,
       round(avg(1 / (1 + exp(-x))), 9) AS mean_probability
FROM (SELECT *, score * 8 - 4 AS x FROM predictions) GROUP BY model""", "predictions")
def loss_by_model(spark, sf):
    logit, label = F.col("score") * 8 - 4, F.col("label")
    return predictions(spark, sf).groupBy("model").agg(
        F.round(F.avg(bce_with_logits(logit, label)), 9).alias("bce"),
        F.round(F.avg(sigmoid_focal(logit, label)), 9).alias("focal"),
        F.round(F.avg(sigmoid(logit)), 9).alias("mean_probability"))


@query("embedding_gate", """
SELECT vec_id, label, round(sim, 6) AS similarity,
       CASE WHEN sim >= 0.85 THEN 'new ' || vec_id ELSE 'original ' || vec_id END AS text
FROM (SELECT e.vec_id, e.label,
             list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
             / (greatest(sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-8)
              * greatest(sqrt(list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-8)) AS sim
      FROM embeddings e JOIN embeddings c ON c.vec_id = e.vec_id - e.vec_id % 10)""")
def embedding_gate(spark, sf):
    """Each vector against the first of its block of ten, as paraphrase and original."""
    from gleaner.functions.vectors import cosine, semantic_gate
    e = table(spark, sf, "embeddings")
    first = e.select(F.col("vec_id").alias("block"), F.col("embedding").alias("original"))
    pairs = e.withColumn("block", F.col("vec_id") - F.col("vec_id") % 10).join(first, "block")
    sim = cosine(F.col("embedding"), F.col("original"))
    new, original = (F.concat(F.lit(word), F.col("vec_id").cast("string")) for word in ("new ", "original "))
    return pairs.withColumn("sim", sim).select(
        "vec_id", "label", F.round("sim", 6).alias("similarity"),
        semantic_gate(new, original, F.col("sim")).alias("text"))
