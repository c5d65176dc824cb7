import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.operators import columns as N
from gleaner.operators import dedup as D
from gleaner.operators import folds as O
from gleaner.operators import sampling as M

SCHEMA = "id long, priority int, title string, abstract string, Keywords string, doi string, labels int"


def corpus_rows(n=200, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, rng.randint(0, 1), rng.choice([None, "hot", f"t{rng.randint(0, 40)}"]), f"a{rng.randint(0, 60)}",
                     rng.choice(["k", "", None]), rng.choice([None, f"d{rng.randint(0, 30)}"]), rng.choice([-1, 0, 1])))
    return rows


def cascade(rows):
    """Keep-first on title, abstract and doi, in that order."""
    held = sorted([r for r in rows if None not in (r[2], r[3], r[4], r[6])], key=lambda r: (r[1], r[0]))
    for column in (2, 3, 5):
        seen, left = set(), []
        for r in held:
            if r[column] is not None and r[column] not in seen:
                seen.add(r[column])
                left.append(r)
        held = left
    return {r[0] for r in held}


def test_cascade_follows_its_order(spark):
    rows = corpus_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    out = D.clean_corpus(df)
    assert {r["id"] for r in out.collect()} == cascade(rows)
    assert out.columns == df.columns
    assert D.clean_corpus(out).count() == out.count()


def test_passes_do_not_commute(spark):
    rows = [(1, 0, "x", "p", "k", None, 1), (2, 0, "x", "q", "k", "d", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert D.clean_corpus(df).count() == 0
    assert [r["id"] for r in D.clean_corpus(df, columns=["doi", "title", "abstract"]).collect()] == [2]


def test_audit_counts(spark):
    rows = [(1, 0, "x", "p", "k", "d1", 1), (2, 0, "x", "q", "k", "d2", 0), (3, 1, "y", "p", "k", "d3", -1)]
    audit = {r["key"]: r for r in D.cascade_audit(spark.createDataFrame(rows, SCHEMA), "id", "labels").collect()}
    assert (audit["title"]["duplicate_rows"], audit["title"]["conflicts"], audit["title"]["rows_out"]) == (2, 1, 2)
    assert (audit["abstract"]["rows_in"], audit["abstract"]["conflicts"], audit["abstract"]["rows_out"]) == (2, 1, 1)
    assert audit["doi"]["rows_out"] == 1


def test_exact_samples(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    for n in (0, 1, 137, 1000, 5000):
        held = [r["id"] for r in M.sample_exact(df, n, "id", 42).collect()]
        assert len(held) == len(set(held)) == min(n, 1000)
    again = {r["id"] for r in M.sample_exact(df.repartition(7), 137, "id", 42).collect()}
    assert again == {r["id"] for r in M.sample_exact(df, 137, "id", 42).collect()}
    assert again != {r["id"] for r in M.sample_exact(df, 137, "id", 43).collect()}


def test_undersample(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    counts = {r["label"]: r["count"] for r in M.undersample(df, "label", "id", 5, 1).groupBy("label").count().collect()}
    assert counts == {1: 100, 0: 500}
    counts = {r["label"]: r["count"] for r in M.undersample(df, "label", "id", 50, 1).groupBy("label").count().collect()}
    assert counts == {1: 100, 0: 900}
    flipped = df.withColumn("label", 1 - F.col("label"))
    assert M.undersample(flipped, "label", "id", 5, 1).count() == 1000


def test_seeded_position_is_a_permutation(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    out = M.seeded_position(df, "id", 7, ["g"]).collect()
    places = defaultdict(list)
    for r in out:
        places[r["g"]].append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    shuffled = [r["id"] for r in M.seeded_shuffle(spark.range(50), "id", 1).collect()]
    assert sorted(shuffled) == list(range(50)) != shuffled


@pytest.mark.parametrize("k,dev_one_in", [(5, 4), (4, 3), (3, 5)])
def test_folds_are_stratified_and_disjoint(spark, k, dev_one_in):
    rows = [(i, -1 if i % 5 == 0 else int(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, labels int")
    folds = O.build_folds(df, "id", "labels", k, 2, 9, dev_one_in)
    O.require_disjoint(folds, "id", k)
    held = defaultdict(lambda: defaultdict(list))
    for r in folds.collect():
        held[r["run"], r["fold"]][r["split"]].append((r["id"], r["labels"], r["is_optional"]))
    curated = {i: y for i, y in rows if y >= 0}
    optional = {i for i, y in rows if y < 0}
    assert len(held) == 2 * k
    for cell in held.values():
        everyone = [i for part in cell.values() for i, _, _ in part]
        assert sorted(everyone) == sorted(i for i, _ in rows)
        assert {i for i, _, opt in cell["train"] if opt} == optional
        assert not any(opt for s in ("dev", "test") for _, _, opt in cell[s])
        for label in (0, 1):
            total = sum(y == label for y in curated.values())
            in_test = sum(y == label for _, y, _ in cell["test"])
            in_dev = sum(y == label for _, y, _ in cell["dev"])
            assert total // k <= in_test <= total // k + 1
            assert abs(in_dev - (total - in_test) / dev_one_in) <= 1
    tests = [frozenset(i for i, _, _ in held[0, f]["test"]) for f in range(k)]
    assert set.union(*map(set, tests)) == set(curated)
    assert tests != [frozenset(i for i, _, _ in held[1, f]["test"]) for f in range(k)]
    # Dev is not simply another fold's test set.
    assert all(frozenset(i for i, _, _ in held[0, f]["dev"]) not in tests for f in range(k))


def test_overlap_is_reported(spark):
    rows = [(0, f, "test", i, 1) for f in range(2) for i in range(3)] + [(0, 2, "test", 9, 1), (0, 2, "train", 1, 1)]
    folds = spark.createDataFrame(rows, "run int, fold int, split string, id long, labels int")
    shared = {(r["fold_a"], r["fold_b"]): r["shared"] for r in O.test_overlaps(folds, "id", 3).collect()}
    assert shared == {(0, 1): 3, (0, 2): 0, (1, 2): 0}
    with pytest.raises(O.FoldOverlap):
        O.require_disjoint(folds, "id", 3)
    assert {r["id"] for r in O.never_in_train(folds, "id").collect()} == {0, 2, 9}
    cover = O.coverage(folds, "id").first()
    assert (cover["records"], cover["in_train"], cover["in_test"], cover["never_in_train"]) == (4, 1, 4, 3)


def test_column_detection():
    assert N.find_column(["Paper Abstract", " ABSTRACT "], "abstract") == " ABSTRACT "
    assert N.find_column(["Paper Abstract", "x"], "abstract") == "Paper Abstract"
    assert N.find_column(["x"], "abstract") is None
    assert N.find_label(["Type", "Rating"]) == "Rating"
    assert N.find_rank(["id", "Score_Rank"]) == "Score_Rank"
    assert N.find_score(["Score_Rank", "ensemble_score"]) == "ensemble_score"
    assert N.find_score(["Score_Rank"]) == "Score_Rank"


def test_stacked_and_lenient(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert [tuple(r) for r in N.stacked([a, b]).orderBy("a").collect()] == [(1, "x"), (2, None)]
    raw = spark.createDataFrame([("{}",), ("0.5",), ("1e-3",), (None,)], "f1 string")
    assert [r["f1"] for r in N.lenient_double(raw, ["f1", "absent"]).collect()] == [None, 0.5, 1e-3, None]
    assert N.drop_index_columns(spark.createDataFrame([(1, 2, 3)], "`Unnamed: 0` int, _c0 int, x int")).columns == ["x"]
