"""Words longer than the table of powers keep their identity."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from gleaner.llm import order_minhash, pitman_yor, quality_mil, toxic_crf
from gleaner.llm.common import ship, word_codes, word_spans

LONG = ["".join(chr(97 + zlib.crc32(f"{n}:{i}".encode()) % 26) for i in range(n)) for n in (63, 64, 65, 100, 128, 129, 200, 5000)]


def swapped(word, distance=64):
    """The word with two bytes exchanged that lie ``distance`` apart."""
    i = next(i for i in range(len(word) - distance) if word[i] != word[i + distance])
    held = list(word)
    held[i], held[i + distance] = held[i + distance], held[i]
    return "".join(held)


def test_codes_tell_swapped_bytes_apart():
    words = [*LONG, *[swapped(w) for w in LONG if len(w) > 65], "short", "words"]
    buffer = np.frombuffer((" ".join(words) + " ").encode(), dtype=np.uint8)
    starts, ends, _ = word_spans(buffer, np.zeros(1, dtype=np.int64))
    codes = word_codes(buffer, starts, ends)
    assert len(codes) == len(words) == len(set(codes.tolist()))
    again = np.frombuffer(("x " + " ".join(words[::-1]) + " ").encode(), dtype=np.uint8)
    starts, ends, _ = word_spans(again, np.zeros(1, dtype=np.int64))
    assert word_codes(again, starts, ends)[1:].tolist() == codes.tolist()[::-1]


def test_language_model_counts_long_words(spark):
    ship(spark)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, f"common words {LONG[3]} {LONG[6]}") for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1] + [(held, f"common {swapped(LONG[6])}")]
    got = {r.doc_id: r for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = lambda t: [*re.findall(r"\S+", t), ""]
    seen = Counter(w for i, t in rows if i != held for w in tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    assert (got[held].n_tokens, got[held].n_known) == (3, 2)
    for i, t in rows:
        assert abs(got[i].base_score - sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t))) < 1e-6


def test_texts_of_long_words_are_not_merged(spark):
    ship(spark)
    base = " ".join(LONG[2:7] * 2)
    other = " ".join(swapped(w) for w in (LONG[3:7] + LONG[3:5]) * 2)
    rows = [(1, base), (2, base), (3, other), (4, " ".join(swapped(w) if len(w) > 65 else w for w in LONG[2:7] * 2))]
    got = order_minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    name = next(c for c in got[0].asDict() if c != "doc_id" and "class" in c)
    classes = {r["doc_id"]: r[name] for r in got}
    assert classes[1] == classes[2] and len({classes[1], classes[3], classes[4]}) == 3


def test_classifiers_take_long_words(spark):
    ship(spark)
    rows = [(i, f"{LONG[6] if i % 2 else swapped(LONG[6])} text {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    quality = {r.doc_id: r.score for r in quality_mil.with_quality(docs, quality_mil.fit(docs, labels)).collect()}
    assert min(s for i, s in quality.items() if i % 2) > max(s for i, s in quality.items() if not i % 2)
    toxic = {r.doc_id: r.score for r in toxic_crf.with_toxicity(docs, toxic_crf.fit(docs, labels)).collect()}
    assert min(s for i, s in toxic.items() if i % 2) > max(s for i, s in toxic.items() if not i % 2)
