"""Packed pairs, counts and places come back as they were."""

import numpy as np
import pytest

from gleaner.llm import pitman_yor as Y


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    keys = np.empty(n, dtype=Y.KEY)
    keys["word"], keys["context"] = rng.integers(0, 12, n).astype(np.uint64) * np.uint64(1 << 60), rng.integers(0, 256, n)
    keys = np.unique(keys)
    back, runs = Y.unpack_keys(Y.pack_keys(keys))
    assert np.array_equal(back, keys) and len(runs) == len(np.unique(keys["word"]))
    counts = rng.choice([0, 1, 254, 255, 256, 70000, 2 ** 32 - 1], n).astype(np.int64)
    assert np.array_equal(Y.unpack_counts(Y.pack_counts(counts)), counts)
    for most in (1 << 8, 1 << 16, 1 << 24, 1 << 32):
        places = rng.integers(0, most, n)
        assert np.array_equal(Y.unpack_places(Y.pack_places(places)), places)


def test_a_word_in_every_context():
    keys = np.empty(256, dtype=Y.KEY)
    keys["word"], keys["context"] = 5, np.arange(256)
    assert np.array_equal(Y.unpack_keys(Y.pack_keys(keys))[0], keys)
