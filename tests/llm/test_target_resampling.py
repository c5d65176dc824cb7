"""Importance resampling against a plain loop; the selection against a sort."""

import hashlib
import math
import random
import re
import zlib

import pytest

from gleaner.llm import target_resampling
from gleaner.llm.common import ship


def _features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def _brute(docs, target, percent=25, least=20):
    s, t = [0] * 10000, [0] * 10000
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in _features(text)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for doc, text in docs:
        n, found = _features(text)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    return rows, order[:percent * len(order) // 100]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = "The of And Éclair naïve x1 stone-cloud 東京 a river `tick` under_score 42".split() + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 40, 90])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " \n\t"), (303, "Straße " * 30000), (None, "null identifier " * 20), (7, docs[7][1]), (8, "other text of a repeated identifier " * 9)]
    return docs, [" ".join(rng.choice(words[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]


def _run(spark, docs, target, **options):
    ship(spark)
    frame = spark.createDataFrame([(d, x, 1, "r", 2.5) for d, x in docs], "doc_id long, text string, score int, rank string, `a.b` double")
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return target_resampling.resampled(frame, aim, **options)


def test_matches_a_plain_loop(spark, corpus):
    docs, target = corpus
    got = _run(spark, docs, target).collect()
    rows, drawn = _brute(docs, target)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((r[:4] for r in map(tuple, got)), key=key) == sorted(((r[0], r[2], r[3], r[4]) for r in rows), key=key)
    places = sorted((r.rank, r.score, r.doc_id) for r in got if r.rank is not None)
    assert [p[0] for p in places] == list(range(1, len(drawn) + 1))
    assert [p[1] for p in places] == [r[4] for r in drawn]
    assert [p[2] for p in places] == [r[0] for r in drawn]


def test_draws_all_or_none(spark, corpus):
    docs, target = corpus
    assert sum(r.rank is not None for r in _run(spark, docs, target, percent=0).collect()) == 0
    everything = _run(spark, docs, target, percent=100, least_words=0).collect()
    assert sorted(r.rank for r in everything) == list(range(1, len(docs) + 1))


def test_empty_tables(spark):
    assert _run(spark, [], ["some text"]).collect() == []
    got = _run(spark, [(1, "one two three"), (2, None)], []).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got) == [(1, 5, None), (2, 0, None)]


@pytest.mark.parametrize("pivots", [1, 3, 24])
def test_selection_finds_every_place_among_ties(spark, pivots):
    rng = random.Random(pivots)
    rows = [(rng.choice([1, 1, 1, 5, rng.randrange(40)]), rng.randrange(6), tag) for tag in range(120)]
    keys = spark.createDataFrame(rows, "score long, place long, tag long").repartition(3).cache()
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for k in (1, 2, 37, 60, 119, 120):
        assert target_resampling.kth_key(keys, k, pivots) == order[k - 1]
