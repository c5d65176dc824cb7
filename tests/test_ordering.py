import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import ordering as O


def rows_with_hot_ties(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        score = 0.5 if i % 3 == 0 else None if i % 7 == 0 else rng.choice([rng.random(), -0.0, 0.0, 1e-9, rng.randint(0, 4) / 4])
        out.append((i * 17 % 1009, "a" if i % 3 else "b", score))
    return out


def expected(rows, descending):
    by_group = defaultdict(list)
    for i, g, s in rows:
        if s is not None:
            by_group[g].append((s + 0.0, i))
    ranks = {}
    for g, held in by_group.items():
        scores = [s for s, _ in held]
        ordered = sorted(held, key=lambda x: (-x[0] if descending else x[0], x[1]))
        for place, (s, i) in enumerate(ordered, 1):
            better = sum(t > s for t in scores) if descending else sum(t < s for t in scores)
            ranks[i] = (better + 1, place)
    return ranks


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_ranked_equals_brute_force(spark, ranges, descending):
    rows = rows_with_hot_ties()
    df = spark.createDataFrame(rows, "id long, g string, score double")
    out = O.ranked(df, "score", "id", ["g"], rank="r", position="p", descending=descending, ranges=ranges)
    got = {r["id"]: (r["r"], r["p"]) for r in out.collect()}
    want = expected(rows, descending)
    assert len(got) == len(rows)
    assert got == {i: want.get(i, (None, None)) for i, _, _ in rows}


def test_a_hot_score_is_cut_by_the_tie_column(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("score"))
    splits = O.find_splits(df, "score", "id", 30)
    hot = max(splits.shares)
    assert hot >= 8
    assert splits.values[splits.shares.index(hot) - 1] == 0.5


@pytest.mark.parametrize("hot_ids", ["F.col('id') % 3 == 0", "F.col('id') < 20000"])
def test_no_cell_holds_much_of_a_skewed_table(spark, hot_ids):
    """A third of the rows share one score and many have none, spread or in one stretch of identifiers."""
    n, ranges = 60000, 60
    score = F.when(eval(hot_ids), 0.5).when(F.col("id") % 5 != 0, F.xxhash64("id") / F.lit(2.0 ** 64))
    df = spark.range(n).withColumn("score", score)
    cells = O.with_cells(df, "score", "id", O.find_splits(df, "score", "id", ranges)).groupBy("_vr", "_tr").count()
    assert cells.agg(F.max("count")).first()[0] <= 4 * n / ranges
    out = O.ranked(df, "score", "id", rank="r", position="p", ranges=ranges)
    check = out.where("score = 0.5").agg(F.min("r"), F.max("r"), F.countDistinct("p"), F.max("p") - F.min("p")).first()
    assert check[0] == check[1] and check[2] == 20000 and check[3] == 19999


def test_empty_and_unscored_tables(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, score double")
    assert [r["r"] for r in O.ranked(df, "score", "id", rank="r").collect()] == [None, None]
    assert O.ranked(df.where("id > 5"), "score", "id", rank="r").count() == 0


@pytest.mark.parametrize("ranges", [2, 16])
def test_quantiles_equal_numpy(spark, ranges):
    rows = [r for r in rows_with_hot_ties() if r[2] is not None]
    df = spark.createDataFrame(rows, "id long, g string, score double")
    probabilities = {"lowest": 0.0, "q25": 0.25, "median": 0.5, "q90": 0.9, "highest": 1.0}
    splits = O.find_splits(df, "score", ranges=ranges)
    out = {r["g"]: r for r in O.quantiles(df, "score", probabilities, ["g"], splits=splits).collect()}
    for g in "ab":
        values = [s for _, h, s in rows if h == g]
        for name, p in probabilities.items():
            assert out[g][name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)


def test_running_sums_cross_ranges(spark):
    df = spark.createDataFrame([(float(v), 1 + v % 3, v % 2) for v in range(50)], "v double, a long, b long")
    splits = O.find_splits(df, "v", ranges=8)
    out = O.running_sums(df, "v", ["a"], splits=splits, ahead=["b"]).orderBy(F.desc("v")).collect()
    total = 0
    for place, r in enumerate(out):
        total += r["a"]
        assert (r["cum_a"], r["all_a"]) == (total, sum(1 + v % 3 for v in range(50)))
        assert r["next_b"] == (out[place + 1]["b"] if place < 49 else None)


def typed_rows(kind, n=500, seed=9):
    rng = random.Random(seed)
    import datetime
    from decimal import Decimal
    make = {"long": lambda: 2 ** 53 + rng.randrange(6), "decimal(38,10)": lambda: Decimal(10) ** 25 + Decimal(rng.randrange(5)) / 10 ** 10,
            "string": lambda: "https://example.org/" + rng.choice(["", "a", "é", "z", "Z"]), "date": lambda: datetime.date(2020, 1, rng.randrange(1, 9)),
            "double": lambda: rng.choice([0.5, float("nan"), rng.random()])}[kind]
    values = [None if i % 9 == 0 else make() for i in range(n)]
    return [(f"k{i * 17 % 1009:04d}", rng.choice(["a", "a", "a", None, "b"]), v) for i, v in enumerate(values)]


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("kind", ["long", "decimal(38,10)", "string", "date"])
@pytest.mark.parametrize("descending", [True, False])
def test_typed_ranks_equal_brute_force(spark, kind, ranges, descending):
    """Values that doubles cannot tell apart, a string as tie column, a NULL group, and more ranges than some groups have rows."""
    rows = typed_rows(kind)
    df = spark.createDataFrame(rows, f"id string, g string, v {kind}")
    out = O.ranked(df, "v", "id", ["g"], rank="r", position="p", descending=descending, ranges=ranges)
    assert out.columns == ["id", "g", "v", "r", "p"]
    want = {}
    for group in ("a", "b", None):
        held = sorted(((v, i) for i, g, v in rows if g == group and v is not None), key=lambda x: x[1])
        held.sort(key=lambda x: x[0], reverse=descending)
        first = {}
        for place, (v, i) in enumerate(held, 1):
            want[i] = (first.setdefault(v, place), place)
    assert {r["id"]: (r["r"], r["p"]) for r in out.collect()} == {i: want.get(i, (None, None)) for i, _, _ in rows}


def test_typed_ranks_without_groups_or_rows(spark):
    df = spark.createDataFrame([(1, 2 ** 53 + 1), (2, 2 ** 53), (3, 2 ** 53 + 1), (4, None)], "id long, v long")
    assert sorted((r["id"], r["r"], r["p"]) for r in O.ranked(df, "v", "id", rank="r", position="p").collect()) == [
        (1, 1, 1), (2, 3, 3), (3, 1, 2), (4, None, None)]
    assert O.ranked(df.where("id > 9"), "v", "id", rank="r").collect() == []


def test_null_groups_are_groups(spark):
    from gleaner.operators.compare import box_summary
    from gleaner.operators.curves import curves, detailed_metrics
    from gleaner.operators.scores import score_summary
    rows = [(i, "a" if i % 3 else None, (i * 7 % 23) / 23, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, s double, label int")
    alone = df.where("g is null").withColumn("g", F.lit("b"))
    for run in (lambda d: O.quantiles(d, "s", {"m": 0.5}, ["g"]), lambda d: score_summary(d, "s", ["g"]), lambda d: box_summary(d, ["g"], "s"),
                lambda d: O.ranked(d, "s", "id", ["g"], rank="r", position="p"), lambda d: curves(d, "label", "s", ["g"]),
                lambda d: detailed_metrics(d.withColumn("p", F.lit(1)), "label", "p", "s", ["g"])):
        key = lambda r: [x for x in r if x not in ("b", None)]
        got = sorted((key(r) for r in run(df).where("g is null").collect()))
        assert got == sorted(key(r) for r in run(alone).collect()) and got
