"""Periodic runs against comparison of every position with every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import periodic_runs
from gleaner.llm.common import ship


def _runs(words):
    """(start, length, period) of all runs, the smallest period of each interval."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _stitched(fragments):
    held = {}
    for q, s, e in sorted(fragments):
        runs = held.setdefault(q, [])
        if runs and s <= runs[-1][1] - q:
            runs[-1][1] = max(e, runs[-1][1])
        else:
            runs.append([s, e])
    return sorted((s, e - s, q) for q, runs in held.items() for s, e in runs)


def _words(rng):
    n = rng.choice([0, 1, 5, 8, 20, 100, 400, 900])
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        start, period = rng.randrange(n), rng.choice([1, 2, 3, 5, 8, 17, 40, 90])
        stretch = (words[start:start + period] * 40)[:rng.choice([3, 4, 5, 9, 30]) * period]
        words[start:start + len(stretch)] = stretch[:n - start]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_solving_and_tiles_match_brute_force(seed, monkeypatch):
    rng, some = random.Random(seed), 0
    monkeypatch.setattr(periodic_runs, "REACH", 8)
    monkeypatch.setattr(periodic_runs, "CORE", 256)
    monkeypatch.setattr(periodic_runs, "SMALL_OCTAVES", 3)
    for _ in range(120):
        words = _words(rng)
        want, codes = _runs(words), np.array(words, dtype=np.int64)
        some += len(want)
        assert _stitched(periodic_runs.solve(codes, 0, periodic_runs.octaves(len(codes)))) == want
        parts = [(q, s + start, e + start) for first, last, start, low, high, raw in periodic_runs.tiles(codes)
                 for q, s, e in periodic_runs.solve(np.frombuffer(raw, "<i4").astype(np.int64), first, last, low, high)]
        assert _stitched(parts) == want
    assert some > 100


def _want(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = _runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    text = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    out = [(i, text(rng.choice([1, 6, 30, 200]), rng.choice([2, 5, 300]))) for i in range(120)]
    phrase = text(700, 500) + " "
    out += [(200, None), (201, ""), (202, " \n\t\v"), (206, " " * 70000), (None, "a a a a a a a b"), (203, "line one\n" * 40 + "end"), (5, out[5][1]), (5, "x y " * 9),
            (204, text(5000, 4000) + " " + phrase * 6 + text(9000, 7000)), (205, "Ünï ünï " * 12000)]
    return out


def test_matches_brute_force_over_spark(spark, rows):
    ship(spark)
    docs = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, n int, key string, `a.b` int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in periodic_runs.collapsed(docs).collect()), key=key)
    # The last texts are compared by their known runs: brute force over them would take minutes.
    quick = [(d, t) for d, t in rows if d not in (204, 205)]
    assert [g for g in got if g[0] not in (204, 205)] == sorted((_want(d, t) for d, t in quick), key=key)
    long = {g[0]: g for g in got if g[0] in (204, 205)}
    words = dict(rows)[204].split()
    assert zlib.crc32(b"204") % 10 and zlib.crc32(b"205") % 10
    assert long[204][1] == 1 and long[204][4] == 700 and long[204][2] <= 5000 and long[204][2] + long[204][3] >= 9200
    start, length = long[204][2], long[204][3]
    assert long[204][7] == hashlib.sha256(" ".join(words[:start + 700] + words[start + length:]).encode()).hexdigest()
    assert long[205][1:6] == (1, 0, 24000, 2, 12000000)


def test_empty_table(spark):
    ship(spark)
    assert periodic_runs.collapsed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
