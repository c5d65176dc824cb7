"""Operators on documents against brute force, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import mixing, order_minhash, pii_feistel, pitman_yor, suffix_dedup, toxic_crf
from gleaner.llm.common import ship

WORDS = "the of and old new river stone cloud paper light green north seven under quiet field honest window".split()


def _text(n, seed):
    return " ".join(WORDS[zlib.crc32(f"{seed}:{i}".encode()) % len(WORDS)] + str(zlib.crc32(f"{i}:{seed}".encode()) % 40) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    shared = _text(60, "shared")
    rows = [(1, _text(80, 1) + " " + shared), (2, shared + " " + _text(50, 2)), (3, _text(300, 3)), (4, _text(300, 3)), (5, None), (6, ""), (7, "  \n"),
            (8, _text(4000, 8)), (9, _text(299, 3) + " changed"), (9, "Équal ün"), (None, "short text")]
    return spark.createDataFrame([(a, b, "en", "s", 1) for a, b in rows], "doc_id long, text string, lang string, source string, score int")


def test_suffix_repeats_match_brute_force(docs):
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(docs.drop("score")).collect())
    raws = [(r.doc_id or -1, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(raw[i:i + 200] for _, raw in raws for i in range(len(raw) - 199))
    want = []
    for key, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((key, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept))
    assert found == sorted(want) and sum(w[2] for w in want) > 0


def test_language_model_counts(docs):
    found = pitman_yor.scored(docs).collect()
    tokens = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [""]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    rows = docs.collect()
    seen = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    total, distinct = sum(seen.values()), len(seen)
    want = sorted((r.doc_id or -1, len(tokens(r.text)), sum(seen[w] > 0 for w in tokens(r.text)), round(sum(
        math.log10((seen[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(r.text)), 4)) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
    assert {r.train_tokens for r in found} == {total} and all(r.score <= 0 for r in found)


def test_language_model_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    words, contexts = rng.zipf(1.3, 5000) % 300, rng.integers(97, 100, 5000)
    pairs, counts = np.unique(words * 256 + contexts, return_counts=True)
    keys = np.zeros(len(pairs), dtype=pitman_yor.KEY)
    keys["word"], keys["context"] = pairs // 256, pairs % 256
    known = np.unique(keys["word"])
    totals = pitman_yor.Totals(5000, len(known), np.bincount(keys["context"], weights=counts, minlength=256).astype(np.int64), (0.5, 0.7), 1.0, 1)
    totals_of = lambda: (np.bincount(keys["context"], weights=totals.replay(0, keys, counts)[2][-1][0], minlength=256).astype(np.int64),
                         int(totals.replay(0, keys, counts)[2][-1][2].sum()))
    for _ in range(4):
        totals.sweeps.append(totals_of())
    totals.final = totals_of()
    for context in (97, 99, 5):
        asked = np.zeros(len(known) + 1, dtype=pitman_yor.KEY)
        asked["word"], asked["context"] = np.append(known, 10 ** 9), context
        out = pitman_yor._replies({"slice": [-1, 0], "bucket": [0, 0], "keys": [keys.tobytes(), pitman_yor.pack_keys(asked)],
                                   "counts": [counts.astype("<i8").tobytes(), b""]}, totals, 2).to_pydict()
        assert abs((10.0 ** np.frombuffer(out["chance"][0], dtype="<f4").astype(float)).sum() - 1) < 1e-5


def test_empty_tables(spark, docs):
    none = docs.where("false").drop("score")
    assert pitman_yor.scored(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0
    assert order_minhash.distinct_documents(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert pii_feistel.pseudonymised(none, "k").count() == 0


def test_one_document_of_each_class_stays(docs):
    kept = [r.doc_id for r in order_minhash.distinct_documents(docs).collect()]
    assert sum(i in (3, 4) for i in kept) + kept.count(9) <= 3 and {1, 2, 5, 6, 7, 8}.issubset(kept) and None in kept


def test_near_classes_match_brute_force(spark):
    """Copies of copies, and unrelated texts around one common passage, which must not be linked by it."""
    ship(spark)
    common = _text(40, "common")
    rows = [(i, f"{common} {_text(25, i)}") for i in range(60)] + [(100 + i, _text(70, i // 4)) for i in range(40)]
    for i in range(100, 140):  # a chain of edits within each four
        words = rows[i - 40][1].split()
        for k in range(i % 4):
            words[5 + 20 * k] = f"edit{k}"
        rows[i - 40] = (i, " ".join(words))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.near_classes(frame).collect()}
    labels, _ = order_minhash.labelled_shingles([(t or "").encode() for _, t in rows])
    owner = {i: i for i, _ in rows}

    def top(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            if order_minhash.alignment_similarity(labels[x], labels[y], 0.8):
                a, b = sorted((top(i), top(j)))
                owner[b] = a
    assert found == {i: top(i) for i, _ in rows}


def test_rarest_labels_of_alike_texts_meet():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 9, 1 << order_minhash.BIN_BITS).astype(np.uint8)
    for n in (1, 2, 5, 40, 333):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        for cut in range(int(0.2 * n) + 1):
            b = np.delete(a, rng.choice(n, cut, replace=False))
            assert np.intersect1d(order_minhash.rarest(a, levels, 0.8), order_minhash.rarest(b, levels, 0.8)).size


def test_pseudonyms_keep_formats_and_links(spark):
    text = ("+1 (017) 555-7713, a.b34@mail7.example.com 4785380592391139 4785-3805-9239-1139 9807915762804490 161.17.88.162 300.1.1.1 "
            "2024-02-29 29.02.2024 2024-02-30 123-45-6789 000-45-6789 GB82 WEST 1234 5698 7654 32")
    frame = spark.createDataFrame([(1, text), (2, "4785380592391139"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii_feistel.pseudonymised(frame, "k", count="n").collect()}
    new = rows[1].text
    assert rows[1].n == 9 and (rows[3].text, rows[3].n, rows[4].text) == (None, 0, "")
    for gone in ("555-7713", "a.b34", "4785380592391139", "161.17.88.162", "2024-02-29", "123-45-6789", "WEST"):
        assert gone not in new
    for stays in ("9807915762804490", "300.1.1.1", "2024-02-30", "000-45-6789", "@mail7.example.com", "+1 ("):
        assert stays in new
    card = rows[2].text
    assert card in new and "-".join(card[i:i + 4] for i in range(0, 16, 4)) in new
    digits = [int(c) for c in card[::-1]]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    other = pii_feistel.pseudonymised(frame.where("doc_id = 2"), "another key").first().text
    assert other != card


def test_feistel_is_a_permutation(spark):
    frame = spark.range(1000).selectExpr("id AS doc_id", "concat('+1 (555) 555-', lpad(id, 4, '0'), ' and 10.0.', id div 256, '.', id % 256) AS text")
    out = pii_feistel.pseudonymised(frame, "k").selectExpr("split(text, ' and ')[0] AS a", "split(text, ' and ')[1] AS b")
    assert out.select("a").distinct().count() == 1000 and out.select("b").distinct().count() == 1000
    dates = spark.range(0, 73049, 7).selectExpr("id AS doc_id", "cast(date_add(date'1900-01-01', cast(id AS int)) AS string) AS text")
    assert pii_feistel.pseudonymised(dates, "k").select("text").distinct().count() == dates.count()


def test_toxic_field_learns_held_out_documents(spark):
    ship(spark)
    rows = [(i, _text(40, i) + (" you moron clown " if i % 4 == 0 else " ") + _text(10 + i % 90, -i), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxic_crf.with_toxicity(docs, toxic_crf.fit(docs, labels), spans="spans").collect()}
    assert len(found) == 402 and all(0 <= r.score <= 1 for r in found.values()) and found[1000].spans == []
    held = [(found[a], b, c) for a, b, c in rows if zlib.crc32(str(a).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == bool(c) for r, _, c in held) >= 0.95 * len(held)
    marked = [b[s.start:s.end] for r, b, c in held if c for s in r.spans]
    assert marked and sum("moron" in m or "clown" in m for m in marked) >= 0.9 * len(marked)
    with pytest.raises(ValueError):
        toxic_crf.with_toxicity(docs.withColumn("score", docs.doc_id), toxic_crf.Field.empty())
    nothing = toxic_crf.with_toxicity(docs, toxic_crf.fit(docs, labels.where("false")))
    assert {r.score for r in nothing.collect()} == {0.5}


def test_digest_of_kept_bytes(docs):
    row = next(r for r in suffix_dedup.without_repeats(docs).collect() if r.doc_id == 6)
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(b"").hexdigest()
