"""Registration, and the tables that stand in for a triage corpus.

Each stand-in exists twice: as a DataFrame and as a SQL common table expression
of the same name, so that a query and its SQL twin start from equal rows. All
scores are multiples of 1/1024, which both engines add without rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Names of the compared models.
MODELS = ["biobert-v1", "BiomedBERT-abs", "BiomedBERT-abs-ft", "roberta-base", "bert-base"]
N_FOLDS = 5
SEED = 42


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; ``needs`` names the SQL tables its twin builds on."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            tables = [CTES[n] for n in needs.split()]
            ORACLES[name] = (f"WITH {', '.join(tables)} {sql}" if tables else sql).strip()
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A text table, spread over the cores where its files are few."""
    keys = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}
    return spread(table(spark, sf, name), *keys[name])


def corpus(spark, sf) -> DataFrame:
    """Documents as abstracts: first line as title, quality as label, unlabelled ones as optional negatives."""
    docs, labels = texts(spark, sf, "documents"), table(spark, sf, "labels")
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    joined = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 13 == 5, F.lit(None)).otherwise(first_line).alias("title"),
        F.col("text").alias("abstract"), F.col("lang").alias("Keywords"),
        F.when(F.col("doc_id") % 17 == 4, F.lit(None)).otherwise(
            F.concat(F.lit("10.1000/"), "source", F.lit("."), F.col("n_chars").cast("string"))).alias("doi"),
        F.coalesce("quality", F.lit(-1)).alias("labels"),
        F.when(F.col("quality").isNull(), 1).otherwise(0).alias("priority"))


def fold_scores(spark, sf) -> DataFrame:
    """Documents with five fold scores; those without a usable title are not scored."""
    from gleaner.functions.text import scorable
    docs = texts(spark, sf, "documents")
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    title = F.when(F.col("doc_id") % 13 == 5, F.lit(" ")).otherwise(first_line)
    base = docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("abstract"), "n_chars")
    scores = F.transform(F.sequence(F.lit(0), F.lit(N_FOLDS - 1)), lambda f: (
        (F.col("id") * 7919 + f.cast("bigint") * 104729 + F.col("n_chars") * 31) % 1025) / F.lit(1024.0))
    return base.select("id", "title", "abstract", scorable(F.col("abstract"), F.col("title")).alias("valid"),
                       scores.alias("scores"))


def predictions(spark, sf) -> DataFrame:
    """Scores of five models, two runs and two amounts of added negatives for every labelled document."""
    labels = table(spark, sf, "labels")
    models = F.array(*[F.lit(m) for m in MODELS])
    rows = (labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                          F.posexplode(models).alias("m", "model"))
            .withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("added", F.explode(F.array(F.lit(0), F.lit(500)))))
    noise = (F.col("id") * 7919 + F.col("m").cast("bigint") * 104729 + F.col("run").cast("bigint") * 1299709
             + F.col("added").cast("bigint") * 31) % 640
    score = (noise + 384 * F.col("label")) / F.lit(1024.0)
    return rows.select("id", "model", "run", "added", (F.col("id") % N_FOLDS).cast("int").alias("fold"),
                       "label", score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


def lineitem_scores(spark, sf) -> DataFrame:
    """The largest table as predictions: returned lines are positives, prices give a spread of scores."""
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.select(
        F.col("l_linestatus").alias("model"), (F.col("l_suppkey") % N_FOLDS).cast("int").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        ((cents * 7919 + F.col("l_partkey") * 31) % 65536 / F.lit(65536.0)).alias("score"))


def fold_metrics(spark, sf) -> DataFrame:
    """Metrics per model, added negatives, run and fold."""
    from gleaner.operators.confusion import add_metrics, confusion
    keys = ["model", "added", "run", "fold"]
    names = ["f1", "recall", "precision", "accuracy", "mcc"]
    counted = add_metrics(confusion(predictions(spark, sf), "label", "prediction", keys), names)
    return counted.select(*keys, *[F.round(n, 9).alias(n) for n in names])


CTES = {
    "corpus": """corpus AS (
        SELECT d.doc_id AS id, CASE WHEN d.doc_id % 13 = 5 THEN NULL ELSE split_part(d.text, chr(10), 1) END AS title,
               d.text AS abstract, d.lang AS "Keywords",
               CASE WHEN d.doc_id % 17 = 4 THEN NULL
                    ELSE '10.1000/' || d.source || '.' || d.n_chars END AS doi,
               COALESCE(l.quality, -1) AS labels, CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END AS priority
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "scored": """scored AS (
        SELECT doc_id AS id,
               CASE WHEN doc_id % 13 = 5 THEN ' ' ELSE split_part(text, chr(10), 1) END AS title, text AS abstract,
               doc_id % 13 <> 5 AND trim(split_part(text, chr(10), 1)) <> '' AND trim(text) <> '' AS valid,
               ((doc_id * 7919 + 0 * 104729 + n_chars * 31) % 1025) / 1024.0::DOUBLE AS s0,
               ((doc_id * 7919 + 1 * 104729 + n_chars * 31) % 1025) / 1024.0::DOUBLE AS s1,
               ((doc_id * 7919 + 2 * 104729 + n_chars * 31) % 1025) / 1024.0::DOUBLE AS s2,
               ((doc_id * 7919 + 3 * 104729 + n_chars * 31) % 1025) / 1024.0::DOUBLE AS s3,
               ((doc_id * 7919 + 4 * 104729 + n_chars * 31) % 1025) / 1024.0::DOUBLE AS s4
        FROM documents)""",
    "ensembled": """ensembled AS (
        SELECT id, title, abstract, valid, CASE WHEN valid THEN (s0 + s1 + s2 + s3 + s4) / 5 END AS score,
               CASE WHEN valid THEN sqrt(((s0 - m) * (s0 - m) + (s1 - m) * (s1 - m) + (s2 - m) * (s2 - m)
                    + (s3 - m) * (s3 - m) + (s4 - m) * (s4 - m)) / 5) END AS std_score,
               CASE WHEN valid THEN least(s0, s1, s2, s3, s4) END AS min_score,
               CASE WHEN valid THEN greatest(s0, s1, s2, s3, s4) END AS max_score,
               CASE WHEN valid THEN (s0 > 0.5)::INT + (s1 > 0.5)::INT + (s2 > 0.5)::INT + (s3 > 0.5)::INT
                    + (s4 > 0.5)::INT END AS positive_folds
        FROM (SELECT *, (s0 + s1 + s2 + s3 + s4) / 5 AS m FROM scored))""",
    "predictions": """predictions AS (
        SELECT id, model, run, added, (id % 5)::INT AS fold, label, score, (score > 0.5)::INT AS prediction FROM (
        SELECT l.doc_id AS id, m.model, r.run, a.added, l.quality AS label,
               ((l.doc_id * 7919 + m.m * 104729 + r.run * 1299709 + a.added * 31) % 640 + 384 * l.quality)
               / 1024.0::DOUBLE AS score
        FROM labels l,
             (VALUES (0, 'biobert-v1'), (1, 'BiomedBERT-abs'), (2, 'BiomedBERT-abs-ft'), (3, 'roberta-base'),
                     (4, 'bert-base')) m(m, model),
             (VALUES (0), (1)) r(run), (VALUES (0), (500)) a(added)))""",
    "hard": """hard AS (SELECT model, fold, label, prediction::DOUBLE AS score FROM predictions)""",
    "held": """held AS (
        SELECT run, fold, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM predictions
        WHERE model = 'bert-base' AND added = 0 GROUP BY run, fold)""",
    "lineitem_scores": """lineitem_scores AS (
        SELECT l_linestatus AS model, (l_suppkey % 5)::INT AS fold, (l_returnflag = 'R')::INT AS label,
               ((round(l_extendedprice * 100)::BIGINT * 7919 + l_partkey * 31) % 65536) / 65536.0::DOUBLE AS score
        FROM lineitem)""",
    "cells": """cells AS (
        SELECT model, added, run, fold,
               sum((label = 0 AND prediction = 0)::INT)::BIGINT AS tn, sum((label = 0 AND prediction = 1)::INT)::BIGINT AS fp,
               sum((label = 1 AND prediction = 0)::INT)::BIGINT AS fn, sum((label = 1 AND prediction = 1)::INT)::BIGINT AS tp
        FROM predictions GROUP BY ALL)""",
    "fold_metrics": """fold_metrics AS (
        SELECT model, added, run, fold,
               round(CASE WHEN 2 * tp + fn + fp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fn + fp)::DOUBLE END, 9) AS f1,
               round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 9) AS recall,
               round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9) AS precision,
               round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy,
               round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
                     ELSE (tp * tn - fp * fn) / sqrt(((tp + fp) * (tp + fn))::DOUBLE * ((tn + fp) * (tn + fn))) END, 9) AS mcc
        FROM cells)""",
}
