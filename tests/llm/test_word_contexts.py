"""The language model's contexts are whole words, and its chain seats a cell by the joint distribution of its customers."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import pitman_yor as Y
from gleaner.llm.common import ship


def _ids(held):
    return (i for i in itertools.count() if (zlib.crc32(str(i).encode()) % 5 == 1) == held)


def _scores(spark, training, asked, **how):
    """log10 probabilities of ``asked`` texts by the model of ``training`` texts, in four partitions."""
    ship(spark)
    train, held = _ids(False), _ids(True)
    rows = [(next(train), t) for t in training] + [(next(held), t) for t in asked]
    name = {i: t for i, t in rows[len(training):]}
    found = Y.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **how).collect()
    assert len(found) == len(rows)
    return {name[r.doc_id]: r.score for r in found if r.held_out}


def test_contexts_of_equal_last_bytes_are_apart(spark):
    got = _scores(spark, ["Banana left", "casa right"] * 30 + ["banana\tstraight"], ["banana left", "banana right", "casa right", "casa left", "rana left", "rana right"])
    assert got["banana left"] > got["banana right"] + 1 and got["casa right"] > got["casa left"] + 1
    assert abs(got["rana left"] - got["rana right"]) < 0.1  # a context that was never seen falls back on its parent


def test_scores_follow_the_model_where_the_seating_is_fixed(spark):
    """One customer a cell and a word: every table is known, so are the discounts (0.95) and each probability."""
    got = _scores(spark, ["a b c d e"], ["a b c d e", "a c zz b", ""])
    base = lambda known: (0.05 * known + (1 + 0.95 * 6) / 7) / (1 + 6)
    seen, new, unseen = (0.05 + 1.95 * base(1)) / 2, 1.95 * base(1) / 2, base(1)
    assert got["a b c d e"] == pytest.approx(6 * math.log10(seen), abs=1e-5)
    # a after the start, c after a, zz after c, b after the unknown zz, the end after b
    assert got["a c zz b"] == pytest.approx(sum(map(math.log10, (seen, new, 1.95 * base(0) / 2, unseen, new))), abs=1e-5)
    assert got[""] == pytest.approx(math.log10(new), abs=1e-5)


def _partitions(n):
    """All seatings of n customers as sizes of tables."""
    seats = [[1]]
    for _ in range(n - 1):
        seats = [[*s[:i], s[i] + 1, *s[i + 1:]] for s in seats for i in range(len(s))] + [[*s, 1] for s in seats]
    return seats


@pytest.mark.parametrize(("n", "others", "chance", "discount"), [(2, 3, 0.2, 0.7), (5, 0, 0.5, 0.3), (7, 40, 0.01, 0.9)])
def test_tables_follow_the_joint_distribution(n, others, chance, discount):
    weight = Counter()
    for sizes in _partitions(n):
        held = math.prod(i - discount for size in sizes for i in range(1, size))
        weight[len(sizes)] += held * math.prod((1.5 + discount * (others + k)) * chance for k in range(len(sizes)))
    draws = 40000
    got = np.bincount(Y.reseat(np.full(draws, n), np.full(draws, others), chance, discount, 1.5, np.random.default_rng(n)), minlength=n + 1)
    for t in range(1, n + 1):
        want = weight[t] / sum(weight.values())
        assert abs(got[t] / draws - want) < 5 * math.sqrt(want * (1 - want) / draws) + 1e-9


def test_cells_of_any_size_are_seated():
    customers = np.array([0, 1, 2, 3, 64, Y.JOINT - 1, Y.JOINT, Y.JOINT + 1, 5000, 10 ** 6, 1])
    tables = Y.reseat(customers, np.full(len(customers), 10), 0.3, 0.6, 1.0, np.random.default_rng(0))
    assert tables[0] == 0 and tables[1] == tables[-1] == 1 and (tables <= customers).all() and (tables[1:] >= 1).all()
    assert tables[9] > tables[8] > tables[4]


def test_pairs_of_common_and_rare_contexts_come_back():
    rng = np.random.default_rng(1)
    codes = rng.integers(1, 2 ** 63, 400).astype(np.uint64)
    keys = np.zeros(3000, dtype=Y.KEY)
    keys["word"], keys["context"] = rng.choice(codes, 3000), rng.choice(np.append(codes * np.uint64(2) + np.uint64(1), Y.START), 3000).view(np.int64)
    keys = np.unique(keys)
    common = np.sort(rng.choice(codes * np.uint64(2) + np.uint64(1), 90, replace=False))
    assert np.array_equal(Y.unpack_keys(Y.pack_keys(keys, common), common)[0], keys)
