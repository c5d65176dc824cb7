import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import agreement as A
from gleaner.plans import models as P
from gleaner.session import fresh_path, materialize, shared_dir
from gleaner.sources import readers, sinks, store
from gleaner.streaming.scoring import arrivals, ingest_stream, progress_rows, score_stream, state_rows, store_stream


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_score_csv(spark, tmp_path):
    path = write(tmp_path / "in.csv", ',My Title,Abstract,n\n0,"A ""quoted"", one","two\nlines",1\n1,  ,text,2\n2,t,"",3\n')
    rows = readers.read_score_csv(spark, path).orderBy("n").collect()
    assert [r["valid_for_scoring"] for r in rows] == [True, False, False]
    assert (rows[0]["title"], rows[0]["abstract"]) == ('A "quoted", one', "two\nlines")
    assert "_c0" not in rows[0].asDict()
    with pytest.raises(ValueError):
        readers.score_input(spark.createDataFrame([(1,)], "x int"))


def test_score_json_array(spark, tmp_path):
    items = [{"Abstract": " a ", "title": "t"}, "bare", "", 5, {"paper_abstract": "b"}, {"abstract": "c", "Title": " "},
             {"abstract": 7}, None, {"abstract": None, "my abstract": "d", "title": None}]
    path = write(tmp_path / "in.json", json.dumps(items))
    # The fuzzy match takes the first key that contains the word, a NULL "abstract" included.
    rows = readers.read_score_json(spark, path).orderBy("item").collect()
    assert [r["abstract"] for r in rows] == ["a", "bare", None, None, "b", "c", None, None, None]
    assert [r["valid_for_scoring"] for r in rows] == [True, True, False, False, True, False, False, False, False]
    assert rows[0]["title"] == "t"


def test_fold_prediction_files(spark, tmp_path):
    folder = tmp_path / "test preds"
    folder.mkdir()
    names = ["fold_0_roberta-base_focal_run-0_opt_neg-500", "fold_1_biobert-v1.1_BCE_with_title_run-0_opt_neg-500",
             "fold-2_Ensemble_BCE_with_title_with_keywords_run-1_opt_neg-0", "fold-3_rf_log_loss_with_title_800_run-0_opt_neg-500",
             "svm_linear_with_title_run-0_opt_neg-500"]
    for i, name in enumerate(names):
        write(folder / f"{name}.csv", f",label,prediction,score,fold,title\n0,1,0,0.25,{i},\"<i>Mamíferos</i>, é\"\n1,0,0,{{}},{i},\n")
    rows = readers.read_fold_predictions(spark, f"{folder}/*.csv")
    assert rows.count() == 10
    parsed = {r["source_file"]: r["m"] for r in rows.where("label = 1").select("source_file", readers.run_metadata(F.col("source_file")).alias("m")).collect()}
    assert set(parsed) == set(names)
    assert (parsed[names[0]]["model"], parsed[names[0]]["loss"], parsed[names[0]]["with_title"]) == ("roberta-base", "focal", False)
    assert (parsed[names[1]]["fold"], parsed[names[1]]["model"], parsed[names[1]]["with_title"]) == (1, "biobert-v1.1", True)
    assert (parsed[names[2]]["run"], parsed[names[2]]["opt_neg"], parsed[names[2]]["with_keywords"]) == (1, 0, True)
    assert (parsed[names[3]]["model"], parsed[names[3]]["criterion"], parsed[names[3]]["num_trees"]) == ("rf", "log_loss", 800)
    assert (parsed[names[4]]["model"], parsed[names[4]]["kernel"], parsed[names[4]]["fold"]) == ("svm", "linear", None)
    assert rows.where("score is null").count() == 5
    assert rows.where("label = 1").first()["title"] == "<i>Mamíferos</i>, é"
    models = [r["model"] for r in readers.available_models(rows.where("source_file like 'fold\\\\_%'")).collect()]
    assert models == ["biobert-v1.1_BCE_with_title", "roberta-base_focal"]


def test_articles_xml(spark, tmp_path):
    path = write(tmp_path / "a.xml", """<PubmedArticleSet>
      <PubmedArticle><MedlineCitation Status="M"><PMID Version="1">11</PMID><Article><ArticleTitle>A <i>b</i> c</ArticleTitle>
        <Abstract><AbstractText Label="X">one</AbstractText><AbstractText>two</AbstractText></Abstract>
        <ELocationID EIdType="pii">p</ELocationID><ELocationID EIdType="doi">d1</ELocationID></Article>
        <MeshHeadingList><MeshHeading><DescriptorName UI="D1">Islands</DescriptorName><QualifierName>q</QualifierName></MeshHeading>
        <MeshHeading><DescriptorName>Birds</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
      <PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>
      </PubmedArticleSet>""")
    a, b = readers.read_articles_xml(spark, path).orderBy("pmid").collect()
    assert tuple(a) == ("11", "A b c", "one", "d1", ["Islands", "Birds"])
    assert tuple(b) == ("12", "T", None, None, [])
    table = readers.optional_negatives(readers.read_articles_xml(spark, path)).orderBy("PMID").collect()
    assert (table[0]["MESH_terms"], table[0]["labels"], table[0]["source"]) == ("Islands, Birds", -1, "pubmed")


def test_recorded_metrics(spark, tmp_path):
    path = write(tmp_path / "m.csv", "model_name,fold,run,with_title,f1,roc_auc,TN,loss_type\n"
                 "SVM,1,1,True,0.8,{},50.0,BCE\nRF,1.0,1,False.1,0.7,0.9,40,BCE\nX,two,1,True,0.7,,1,\n")
    assert [r["roc_auc"] for r in readers.read_metrics(spark, path).orderBy("model_name").collect()] == [0.9, None, None]
    kept, quarantined = readers.checked_metrics(readers.read_csv(spark, path))
    assert [(r["model_name"], r["fold"], r["TN"], r["roc_auc"], r["AP"]) for r in kept.collect()] == [("SVM", 1, 50, None, None)]
    assert {r["model_name"] for r in quarantined.collect()} == {"RF", "X"}


def test_rating_sheet(spark, tmp_path):
    lines = ["id,title,x,y,Island,,Monitoring,", ",,,,Ann,Bob,Ann,Bob", ",,,,r,r,r,r"]
    lines += [f"{i},t{i},,,yes,{'yes' if i % 2 else 'no'},no,{'no' if i else ''}" for i in range(6)]
    paths = [write(tmp_path / f"s{n}.csv", "\n".join(lines) + "\n") for n in range(2)]
    long = readers.rating_sheet(spark, paths[0], ["Island", "Monitoring"], ("Ann", "Bob"), "Abstract", paper="id")
    assert long.count() == 24
    out = {r["criterion"]: r for r in A.rater_kappa(
        A.rating_pairs(long, ["phase", "criterion", "paper"], ("Ann", "Bob")), ["criterion"]).collect()}
    assert (out["Island"]["agreements"], out["Island"]["total"]) == (3, 6)
    assert (out["Monitoring"]["agreements"], out["Monitoring"]["total"], out["Monitoring"]["kappa"]) == (5, 5, 1.0)
    both = readers.rating_sheet(spark, str(tmp_path / "s*.csv"), ["Island", "Monitoring"], ("Ann", "Bob"), "Abstract", paper="id")
    assert both.count() == 48


def stored_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_ingest_replaces_stored_records(spark):
    path = fresh_path(spark, "replace")
    for rows in ([(1, "a"), (2, "b")], [(1, "new"), (3, "c")]):
        store.ingest(spark.createDataFrame(rows, "id long, v string"), path, "id", overwrite=True)
    assert sorted(tuple(r) for r in store.read_store(spark, path).collect()) == [(1, "new"), (2, "b"), (3, "c")]


def test_replacing_leaves_other_buckets_as_they_are(spark):
    path = fresh_path(spark, "partly")
    schema = "id long, v string"
    store.ingest(spark.range(400).select("id", F.lit("old").alias("v")), path, "id", buckets=16)
    before = stored_files(path)
    wave = spark.createDataFrame([(7, "new"), (7, "newer"), (1000, "new"), (None, "lost")], schema)
    touched = {f"_bucket={r[0]}" for r in wave.where("id is not null").select(store.bucket_of("id", 16)).distinct().collect()}
    store.ingest(wave, path, "id", overwrite=True, order="v")
    after = stored_files(path)
    assert all(after.get(f) == t for f, t in before.items() if not any(b + os.sep in f for b in touched))
    assert not any(f in after for f in before if any(b + os.sep in f for b in touched))
    held = {r["id"]: r["v"] for r in store.read_store(spark, path).collect()}
    assert len(held) == 401 and held[7] == "newer" and held[1000] == "new" and set(held.values()) == {"old", "new", "newer"}
    with pytest.raises(ValueError, match="16 buckets"):
        store.ingest(wave, path, "id", buckets=4)


def test_ingest_reads_the_buckets_of_the_batch_only(spark):
    path = fresh_path(spark, "pruned")
    store.ingest(spark.range(400), path, "id", buckets=16)
    one = store.read_store(spark, path, ids=[5], id_="id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan or "PartitionFilters: [isnotnull(_bucket" in plan
    assert [r["id"] for r in one.collect()] == [5]


def test_repeats_of_a_batch_have_a_stated_order(spark):
    rows = [(1, 3, "c"), (1, 1, "a"), (1, None, "n"), (2, 5, "x"), (2, 5, "y"), (None, 9, "z")]
    df = spark.createDataFrame(rows, "id long, at int, v string")
    latest = {tuple(sorted((r["id"], r["v"]) for r in store.one_per_id(df.repartition(n), "id", "at").collect())) for n in (1, 2, 5)}
    first = {r["id"]: r["v"] for r in store.one_per_id(df, "id", "at", latest=False).collect()}
    assert len(latest) == 1 and dict(next(iter(latest)))[1] == "c" and first[1] == "n"


def test_incremental_ingest(spark):
    path = fresh_path(spark, "stored")
    batch = spark.createDataFrame([(1,), (1,), (2,), (None,)], "PMID long")
    store.ingest(batch, path, "PMID")
    store.ingest(spark.createDataFrame([(2,), (3,)], "PMID long"), path, "PMID")
    store.ingest(batch.where("PMID > 9"), path, "PMID")
    assert sorted(r["PMID"] for r in store.read_store(spark, path).collect()) == [1, 2, 3]


def test_sinks(spark):
    rows = spark.createDataFrame([(0, 1, "train", 5, 1), (0, 1, "test", 6, 0)], "run int, fold int, split string, id long, labels int")
    path = fresh_path(spark, "folds")
    sinks.write_folds(rows, path)
    one = sinks.read_fold(spark, path, 0, 1, "test")
    assert [r["id"] for r in one.collect()] == [6]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    ids = fresh_path(spark, "ids")
    sinks.write_id_lists(rows, ids, "id", label="labels")
    assert {(r["split"], r["label"], r["value"]) for r in spark.read.text(ids).collect()} == {("train", "pos", "5"), ("test", "neg", "6")}
    metrics = fresh_path(spark, "metrics")
    one_row = spark.createDataFrame([("m", 1, 0.5)], "model_name string, fold int, f1 double")
    for _ in range(2):
        sinks.append_metrics(one_row, metrics)
    assert sinks.read_stored_metrics(spark, metrics).count() == 2
    with pytest.raises(ValueError):
        sinks.write_scored(rows, metrics, "xlsx")


def test_shared_folder_is_the_session_s(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    assert materialize(df, "t", ["g"]).groupBy("g").count().count() == 2


def texts(spark, n=120):
    words = {1: "island bird nest survey reef", 0: "motor engine valve piston gear"}
    rows = []
    for i in range(n):
        label = i % 2
        other = words[1 - label].split()[i % 5]
        rows.append((i, label, " ".join([words[label].split()[(i + j) % 5] for j in range(4)] + [other, f"w{i % 9}"])))
    return spark.createDataFrame(rows, "id long, label int, text string")


def test_learners_beat_the_class_share(spark):
    rows = P.add_terms(P.add_words(texts(spark), "text"))
    train, test = rows.where("id < 80"), rows.where("id >= 80")
    vectors = P.fit_tfidf(train, max_features=200)
    train, test = vectors.transform(train).select("id", "label", "features"), vectors.transform(test).select("id", "label", "features")
    from gleaner.operators.curves import curve_summary, curves
    for learner in (P.linear_svm(iterations=10), P.forest(10, "log_loss", depth=5), P.weighted_logistic(iterations=10)):
        model = learner.fit(P.with_class_weight(train, 2.0))
        r = curve_summary(curves(P.scored(model, test, ["label"]), "label", "score")).first()
        assert r["roc_auc"] > 0.8
        assert r["ap"] > 0.7
    best, results = P.random_search(train, test, 3, 5, iterations=5)
    assert len(results) == 3 and best["roc_auc"] == max(r["roc_auc"] for r in results)
    assert P.sampled_params(P.search_space(0), 4, 1) == P.sampled_params(P.search_space(0), 4, 1)
    assert all(0 <= p["pos_weight"] <= 1 and 1e-6 <= p["reg"] <= 0.1 for p in P.sampled_params(P.search_space(0), 50, 2))


def test_cross_validation_covers_every_record_once(spark):
    from gleaner.operators.folds import build_folds
    rows = texts(spark, 90).withColumnRenamed("label", "labels")
    folds = build_folds(rows, "id", "labels", 3, 1, 4)

    def fit(train, dev):
        return P.weighted_logistic(iterations=5).fit(P.with_class_weight(train, 1.0))

    predictions, models = P.cross_validate(rows, folds, "id", "text", 3, fit=fit, max_features=100)
    held = predictions.collect()
    assert sorted(r["id"] for r in held) == list(range(90))
    assert all(r["prediction"] == int(r["score"] > r["threshold"]) for r in held)
    records = rows.select("id", "text", (F.col("id") != 3).alias("ok"))
    scored = {r["id"]: r["result"] for r in P.score_with_folds(records, models, "text", valid="ok").collect()}
    assert len(scored) == 90 and scored[3] is None
    one = next(r for r in held if r["fold"] == 1 and r["id"] != 3)
    assert scored[one["id"]]["fold_scores"][1] == pytest.approx(one["score"])


def test_baselines_and_tuning_share_the_loop(spark):
    from gleaner.operators.folds import build_folds
    rows = texts(spark, 60).withColumnRenamed("label", "labels")
    folds = build_folds(rows, "id", "labels", 2, 1, 4)
    learners = {**P.forest_grid([3], ["gini"], depth=3), "svm": P.linear_svm(iterations=3)}
    held = P.baseline_predictions(rows, folds, "id", "text", 2, learners, max_features=50).collect()
    assert sorted((r["model"], r["id"]) for r in held) == sorted((m, i) for m in learners for i in range(60))
    assert {r["prediction"] for r in held} <= {0, 1}
    tuned, _ = P.cross_validate(rows, folds, "id", "text", 2, fit=P.tuned_fit(2, 3, iterations=3), max_features=50)
    assert sorted(r["id"] for r in tuned.collect()) == list(range(60))
    assert len(P.forest_grid()) == 30


def test_vocabulary_is_the_exact_top(spark):
    from collections import Counter
    rows = spark.createDataFrame([("b a b a c d",), ("a b a b e f",), ("g b a h b a",), ("",)], "text string")
    rows = rows.withColumn("words", F.filter(F.split("text", " "), lambda w: w != ""))
    counted = Counter()
    for r in rows.collect():
        counted.update(r["words"])
        counted.update(" ".join(p) for p in zip(r["words"], r["words"][1:]))
    for n in (1, 2, 3, 4, 5, 8, 50):
        want = sorted(counted, key=lambda t: (-counted[t], t))[:n]
        assert P.vocabulary(rows, n) == want


def test_length_batches_keep_every_row(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "t" * (i % 3), "a\n" * (i % 17)) for i in range(200)], "id long, title string, abstract string")
    weights = [[0.1, 0.2, -0.03, 0.5], [-1.0, 0.0, 0.01, 0.0]]
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = {}
    for r in df.collect():
        x = [1, len(r["title"] or ""), len(r["abstract"]), r["abstract"].count("\n")]
        want[r["id"]] = float(np.mean([sig(np.dot(w, x)) for w in weights]))
    for batch in (1, 7, 1000):  # the same scores in any batching
        out = P.length_batched(df, P.linear_ensemble(weights), "title", "abstract", "id", batch)
        assert {r["id"]: r["score"] for r in out.collect()} == pytest.approx(want, abs=1e-12)


def test_stream_equals_batch(spark):
    inbox, sink, state, stored, state2 = (fresh_path(spark, n) for n in ("in", "out", "st", "stored", "st2"))
    df = spark.range(40).select("id", (F.col("id") % 10).alias("user"))
    df.repartition(4).write.parquet(inbox)

    def scorer(rows):
        return rows.withColumn("score", F.col("id") / 40)

    query = score_stream(arrivals(spark, inbox, df.schema, 2), scorer, sink, state)
    query.awaitTermination()
    assert sum(n for _, n in progress_rows(query)) == 40
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(map(tuple, scorer(df).collect()))


def test_stream_state_passes_each_identifier_once(spark):
    inbox, stored, state = (fresh_path(spark, n) for n in ("in", "stored", "st"))
    df = spark.range(40).select("id", F.when(F.col("id") != 3, F.col("id") % 10).alias("user"))
    df.repartition(4, "id").write.parquet(inbox)
    query = ingest_stream(arrivals(spark, inbox, df.schema, 1), stored, "user", state)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert len(progress_rows(query)) >= 4 and state_rows(query)[-1][1] == 10
    # One source and the state; the stored table is not read.
    assert plan.count("FileScan") == 1 and stored not in plan and "StreamingDeduplicate" in plan
    assert sorted(r["user"] for r in spark.read.parquet(stored).collect()) == list(range(10))
    # More files, the same checkpoint: known users stay out, a new one gets in.
    spark.createDataFrame([(50, 4), (51, 77), (52, 77)], df.schema).write.mode("append").parquet(inbox)
    ingest_stream(arrivals(spark, inbox, df.schema, 1), stored, "user", state).awaitTermination()
    assert sorted(r["user"] for r in spark.read.parquet(stored).collect()) == [*range(10), 77]
    # Nothing new: nothing is added.
    ingest_stream(arrivals(spark, inbox, df.schema, 1), stored, "user", state).awaitTermination()
    assert spark.read.parquet(stored).count() == 11
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_stream_state_is_bounded_by_a_watermark(spark):
    inbox, stored, state = (fresh_path(spark, n) for n in ("in", "stored", "st"))
    schema = "user long, at timestamp"
    chunk = lambda rows: spark.sql("SELECT * FROM VALUES " + ", ".join(f"(CAST({u} AS BIGINT), TIMESTAMP '{t}')" for u, t in rows) + " AS t(user, at)")
    kept = []
    for rows in ([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00")], [(2, "2024-01-03 00:00:00")], [(3, "2024-01-03 00:00:01")],
                 [(1, "2024-01-03 12:00:00"), (2, "2024-01-03 00:05:00")]):
        chunk(rows).coalesce(1).write.mode("append").parquet(inbox)
        query = ingest_stream(arrivals(spark, inbox, spark.createDataFrame([], schema).schema, 1), stored, "user", state, "at", "1 hour")
        query.awaitTermination()
        kept.append(sorted(r["user"] for r in spark.read.parquet(stored).collect()))
    # User 1 was forgotten after an hour and counts as new; user 2 is still known.
    assert kept[0] == [1] and kept[-1] == [1, 1, 2, 3] and max(n for _, n in state_rows(query)) <= 3


def test_stream_into_a_store_that_others_write(spark):
    inbox, stored = fresh_path(spark, "in"), fresh_path(spark, "stored")
    df = spark.range(40).select("id", (F.col("id") % 10).alias("user"))
    df.repartition(4, "id").write.parquet(inbox)
    store.ingest(spark.createDataFrame([(100, 4)], df.schema), stored, "user", buckets=4)
    for n in range(2):  # the second time without the first's checkpoint
        store_stream(arrivals(spark, inbox, df.schema, 1), stored, "user", fresh_path(spark, f"st{n}"), order="id").awaitTermination()
    held = {r["user"]: r["id"] for r in store.read_store(spark, stored).collect()}
    assert sorted(held) == list(range(10)) and held[4] == 100


def tricky_rows():
    cells = ["plain", 'a "quoted" one', "two\nlines", "cr\rlf\r\n", "100 % %0A %25", "comma, semi;", " padded ", "naïve 東京", "\\back\\slash"]
    return [(i, cells[i % len(cells)] + str(i), None if i % 7 == 0 else cells[(i * 5) % len(cells)]) for i in range(300)]


def test_escaped_csv_is_split_and_comes_back(spark, tmp_path):
    rows = tricky_rows()
    df = spark.createDataFrame(rows, "id int, text string, more string")
    path = str(tmp_path / "csv")
    sinks.write_csv(df.coalesce(1), path, "escaped")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        back = readers.read_csv(spark, path, line_breaks="escaped")
        assert back.rdd.getNumPartitions() > 4
        assert sorted((int(r["id"]), r["text"], r["more"]) for r in back.collect()) == rows
        typed = readers.read_csv(spark, path, "id int, text string, more string", "escaped")
        assert sorted(map(tuple, typed.collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        sinks.write_csv(df, path, "none")


def test_header_rows_are_dropped_from_a_split_file(spark, tmp_path):
    lines = ["id,a1,a2", "names,Ann,Bob", "more names,x,y"] + [f"{i},{i % 2},{i % 3}" for i in range(2000)]
    for n in range(2):
        write(tmp_path / f"sheet {n}.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        raw = spark.read.option("header", True).csv(str(tmp_path / "*.csv"))
        assert raw.rdd.getNumPartitions() > 6
        long = readers.rating_sheet(spark, str(tmp_path / "*.csv"), ["c"], ("Ann", "Bob"), "p", start_column=1, paper="id", line_breaks="escaped")
        got = sorted((int(r["paper"]), r["rater"], int(r["rating"])) for r in long.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((i, rater, i % k) for i in range(2000) for rater, k in (("Ann", 2), ("Bob", 3)) for _ in range(2))


def test_files_called_after_their_rows(spark, tmp_path):
    path = str(tmp_path / "test preds")
    df = spark.createDataFrame([("fold_0_x y_BCE", 1, "a\nb"), ("fold_0_x y_BCE", 2, "c"), ("fold_1_z%_focal", 3, None)], "stem string, n int, t string")
    sinks.write_named_csv(df, path, "stem")
    assert sorted(n for n in os.listdir(path) if not n.startswith(".")) == ["fold_0_x y_BCE.csv", "fold_1_z%_focal.csv"]
    back = readers.read_fold_predictions(spark, f"{path}/fold_*.csv", "n int, t string")
    assert sorted((r["source_file"], r["n"], r["t"]) for r in back.collect()) == sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    with pytest.raises(OSError):
        sinks.write_named_csv(df, path, "stem")
