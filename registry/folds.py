"""Fold construction and its audits."""

from pyspark.sql import functions as F

from gleaner.operators import folds as O
from gleaner.session import materialize
from registry.base import CTES, N_FOLDS, SEED, query
from registry.corpus import CASCADE, clean

RUNS = 2
FOLDS_SQL = f"""placed AS (
    SELECT run, id, labels, row_number() OVER (PARTITION BY run, labels ORDER BY md5('{SEED}:' || run || ':' || id), id) - 1 AS place
    FROM t3, (VALUES (0), (1)) r(run) WHERE labels <> -1),
dealt AS (
    SELECT run, f.fold, id, labels, place % {N_FOLDS} AS test_fold,
           place - (place + {N_FOLDS - 1} - f.fold) // {N_FOLDS} AS rest
    FROM placed, (VALUES (0), (1), (2), (3), (4)) f(fold)),
folds AS (
    SELECT run, fold, CASE WHEN test_fold = fold THEN 'test'
        WHEN ('0x' || substr(md5('{SEED}:' || run || ':' || fold || ':' || labels || ':' || (rest // 4)), 1, 8))::BIGINT % 4 = rest % 4
        THEN 'dev' ELSE 'train' END AS split, id, labels, false AS is_optional FROM dealt
    UNION ALL
    SELECT run, fold, 'train', id, 0, true FROM t3, (VALUES (0), (1)) r(run), (VALUES (0), (1), (2), (3), (4)) f(fold)
    WHERE labels = -1)"""


def with_folds(select: str) -> str:
    return f"WITH {CTES['corpus']}, {CASCADE}, {FOLDS_SQL} {select}"


def built(spark, sf):
    """Folds of the cleaned corpus, whose identifiers and labels are stored once."""
    held = materialize(clean(spark, sf).select("id", "labels"), "clean")
    return O.build_folds(held, "id", "labels", N_FOLDS, RUNS, SEED)


def stored(spark, sf):
    """The split table as its sink writes it, for the audits to scan."""
    return materialize(built(spark, sf), "folds", ["run", "fold", "split"])


@query("stratified_folds", with_folds("SELECT run::INT AS run, fold::INT AS fold, split, id, labels, is_optional FROM folds"))
def stratified_folds(spark, sf):
    return built(spark, sf)


@query("fold_label_distribution", with_folds("""
SELECT run, fold, split, labels, n, round(n / (sum(n) OVER (PARTITION BY run, fold, split))::DOUBLE, 9) AS share
FROM (SELECT run, fold, split, labels, count(*) AS n FROM folds GROUP BY ALL)"""))
def fold_label_distribution(spark, sf):
    out = O.label_distribution(stored(spark, sf), "labels", ["run", "fold", "split"])
    return out.withColumn("share", F.round("share", 9))


@query("fold_sizes", with_folds("""
SELECT run, fold, sum((split = 'train')::INT)::BIGINT AS train, sum((split = 'dev')::INT)::BIGINT AS dev,
       sum((split = 'test')::INT)::BIGINT AS test FROM folds GROUP BY run, fold"""))
def fold_sizes(spark, sf):
    return O.fold_sizes(stored(spark, sf))


@query("fold_coverage", with_folds("""
SELECT run, count(*) AS records, sum(a::INT)::BIGINT AS in_train, sum(b::INT)::BIGINT AS in_dev, sum(c::INT)::BIGINT AS in_test,
       sum((NOT a)::INT)::BIGINT AS never_in_train FROM (
  SELECT run, id, bool_or(split = 'train') AS a, bool_or(split = 'dev') AS b, bool_or(split = 'test') AS c
  FROM folds GROUP BY run, id) GROUP BY run"""))
def fold_coverage(spark, sf):
    return O.coverage(stored(spark, sf), "id")


@query("fold_overlaps", with_folds("""
SELECT p.run::INT AS run, p.a::INT AS fold_a, p.b::INT AS fold_b, count(y.id) AS shared FROM
  (SELECT r.run, a.fold AS a, b.fold AS b FROM (VALUES (0), (1)) r(run), (VALUES (0), (1), (2), (3), (4)) a(fold),
   (VALUES (0), (1), (2), (3), (4)) b(fold) WHERE a.fold < b.fold) p
  LEFT JOIN (SELECT * FROM folds WHERE split = 'test') x ON x.run = p.run AND x.fold = p.a
  LEFT JOIN (SELECT * FROM folds WHERE split = 'test') y ON y.run = p.run AND y.fold = p.b AND y.id = x.id
GROUP BY ALL"""))
def fold_overlaps(spark, sf):
    return O.test_overlaps(O.require_disjoint(stored(spark, sf), "id", N_FOLDS), "id", N_FOLDS)


@query("train_leaks_of_relabelled_folds", with_folds("""
SELECT run, id FROM folds WHERE NOT is_optional GROUP BY run, id HAVING NOT bool_or(split = 'train' AND fold < 2)"""))
def train_leaks_of_relabelled_folds(spark, sf):
    """Records that the first two folds alone would never train on: the set difference of the audit."""
    folds = stored(spark, sf).where("not is_optional")
    narrowed = folds.withColumn("split", F.when((F.col("split") == "train") & (F.col("fold") >= 2), "other")
                                .otherwise(F.col("split")))
    return O.never_in_train(narrowed, "id")
