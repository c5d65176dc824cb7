"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from gleaner.llm import sorted_projections
from gleaner.llm.common import ship


def _brute(rows, threshold=0.95):
    sound = [i for i, (d, v) in enumerate(rows) if d is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in sound:
        for j in sound:
            a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
            if i != j and len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = None if d is None else min(rows[j][0] for j in seen)
        out.append((d, len(links[i]), low, None if d is None else low == d))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    near = lambda base, n, noise: [(base + noise * rng.standard_normal(len(base))).tolist() for _ in range(n)]
    vectors = rng.standard_normal((60, 16)).tolist()
    vectors += near(rng.standard_normal(16), 150, 0.12) + near(rng.standard_normal(16), 20, 0.2) + [rng.standard_normal(16).tolist()] * 70
    vectors += near(rng.standard_normal(5), 6, 0.05)
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    big = rng.standard_normal(16)
    rows += [(900, None), (901, [0.0] * 16), (902, [1.0] * 15 + [None]), (903, [1.0] * 15 + [math.nan]), (904, [math.inf] * 16), (905, []),
             (906, (big * 1e300).tolist()), (907, (big * 1e-300).tolist()), (None, vectors[0]), (908, [-0.0, 1.0]), (909, [0.0, 1.0])]
    return rows


def _key(row):
    return tuple(-1 if x is None else x for x in row)


@pytest.mark.parametrize("block", [1024, 32])
def test_matches_all_pairs(spark, rows, block, monkeypatch):
    ship(spark)
    monkeypatch.setattr(sorted_projections, "BLOCK", block)
    frame = spark.createDataFrame([(d, v, 1, "k", 2) for d, v in rows], "vec_id long, embedding array<double>, n int, key string, `a.b` int")
    got = [tuple(r) for r in sorted_projections.near_vectors(frame.repartition(5)).collect()]
    assert sorted(got, key=_key) == sorted(_brute(rows), key=_key)
    assert max(r[1] for r in got) > 100


def test_rows_that_share_an_identifier(spark):
    ship(spark)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in sorted_projections.near_vectors(frame).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False)]


def test_empty_table(spark):
    ship(spark)
    assert sorted_projections.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_passes_follow_the_number_of_vectors():
    counts = [sorted_projections.passes(n, 0.95) for n in (1, 24, 1000, 50_000, 10 ** 9)]
    assert counts[:2] == [1, 1] and counts == sorted(counts) and counts[-1] < 100


def test_recall_of_the_passes_alone(spark):
    """Pairs at the threshold meet in some pass, far more often than the asked nine in ten."""
    ship(spark)
    rng = np.random.default_rng(8)
    left = rng.standard_normal((1500, 32))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 32))
    side -= np.einsum("ij,ij->i", side, left)[:, None] * left
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    right = 0.955 * left + math.sqrt(1 - 0.955 ** 2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([left, right]))]
    got = sorted_projections.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    linked = got.where("vec_id >= 1500 and component_id = vec_id - 1500").count()
    assert linked >= 0.97 * 1500
