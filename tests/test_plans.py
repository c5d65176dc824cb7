"""Shapes of physical plans that decide whether a job holds at scale."""

from pyspark.sql import functions as F

from gleaner.operators import curves as K
from gleaner.operators import dedup as D
from gleaner.operators import folds as O
from gleaner.operators import profile as P
from gleaner.operators import sampling as M
from gleaner.plans import models

DOCS = "/root/testdata/sf0.001/documents.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_scoring_keeps_rows_without_text(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = [(1, "blood test cell", 1), (2, "stone river wall", 0), (3, "blood cell", 1), (4, None, 0), (5, "  ", 0)]
    frame = spark.createDataFrame(rows, "id int, text string, label int")
    hashed = HashingTF(inputCol="terms", outputCol="features", numFeatures=64)
    terms = models.add_terms(models.add_words(frame, "text"))
    fitted = LogisticRegression(maxIter=3).fit(hashed.transform(terms))
    fold = PipelineModel(stages=[hashed, fitted])
    valid = frame.withColumn("valid", F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    scored = {r.id: r for r in models.score_with_folds(valid, [fold, fold], "text", valid="valid").collect()}
    assert sorted(scored) == [1, 2, 3, 4, 5]
    assert scored[4].result is None and scored[5].result is None and scored[1].result is not None


def test_keys_are_limited_before_the_shuffle(spark):
    df = spark.read.parquet(DOCS)
    for out in (D.keep_first(df, ["text"], ["doc_id"]), P.top_ngrams(df, "text", ["lang"])):
        text = plan(out)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_cascade_moves_digests_only(spark):
    rows = spark.read.parquet(DOCS).select(
        F.col("doc_id").alias("id"), F.lit(0).alias("priority"), F.col("source").alias("title"), F.col("text").alias("abstract"),
        F.col("lang").alias("doi"))
    text = plan(D.cascade_survivors(rows, "id", ["title", "abstract", "doi"], ["priority", "id"]))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3
    assert all("_d_" in line for line in exchanges)


def test_scans_read_the_named_columns_only(spark):
    df = spark.read.parquet(DOCS)
    assert "ReadSchema: struct<doc_id:bigint>" in plan(M.sample_exact(df.select("doc_id"), 10, "doc_id", 1))
    words = P.top_words(df, "text", ["lang"], ["a"], 3)
    assert "ReadSchema: struct<text:string,lang:string>" in plan(words)


def test_splitting_folds_adds_no_shuffle(spark):
    assigned = O.assign_test_folds(spark.range(100).withColumn("label", F.col("id") % 2), "id", "label", 5, 2, 1)
    assert plan(assigned).count("Exchange") == plan(O.fold_splits(assigned, "id", "label", 5, 1)).count("Exchange")


def test_curves_count_scores_once_and_join_without_broadcast(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 50 / 50).alias("score"))
    table = K.curves(df, "label", "score")
    table.collect()
    text = plan(table).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text
    assert "BroadcastHashJoin" not in text


def test_no_python_rows_in_scoring(spark):
    df = models.add_terms(models.add_words(spark.read.parquet(DOCS), "text"))
    vectors = models.fit_tfidf(df, max_features=50)
    assert "EvalPython" not in plan(vectors.transform(df))
    assert "Exchange" not in plan(vectors.transform(df))


def test_runs_of_rare_buckets_stay_out_of_the_shuffle(spark, monkeypatch):
    from collections import Counter
    words = ["w%d" % (i * i % 23) for i in range(40)]
    rows = [(None if i % 3 == 0 else "g%d" % (i % 3), "%s same old words here %d%d" % (" ".join(words[i % 20:i % 20 + 9]), i, i * 7 % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = Counter()
    for lang, text in rows:
        w = text.split()
        want.update((lang, " ".join(w[i:i + 4])) for i in range(len(w) - 3) if all(len(x) > 1 for x in w[i:i + 4]))
    best = {(lang, g, n) for lang in (None, "g1", "g2")
            for g, n in sorted(((g, n) for (at, g), n in want.items() if at == lang), key=lambda x: (-x[1], x[0]))[:10]}
    for buckets, listed in ((1 << 20, 100_000), (7, 100_000), (1 << 20, 0)):
        monkeypatch.setattr(P, "BUCKETS", buckets)
        monkeypatch.setattr(P, "LISTED", listed)
        out = P.top_ngrams(df, "text", ["lang"])
        assert {(r["lang"], r["ngram"], r["n"]) for r in out.collect()} == best
        assert ("LeftSemi" in plan(out)) == (listed > 0)
    kept = P.frequent_buckets(df, "text", ["lang"], 4, 1).count()
    assert 3 <= kept < len(want)
