"""The source mix against a loop over its slots."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from gleaner.llm import mixing
from gleaner.llm.common import ship

SIZES = {"a": [70, 3, 0, 130, 64], "b": [500, 20, 1, 1, 33], None: [9, 40], "c": [64, 64]}


def _docs(spark):
    ship(spark)
    rows, number = [], 0
    for source, sizes in SIZES.items():
        for n in sizes:
            rows.append((number, "  ".join(f"w{number}_{i}é" + "\n" * (i % 3 == 0) for i in range(n)) if n else None, "en", source))
            number += 1
    rows += [(50, "same words twice", "en", "c"), (50, "same words twice", "en", "c"), (None, " unnamed\ttext ", "en", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _loop(docs, sources, block):
    """(source, block, words) of every slot in order, and what the slots take of each (doc_id, text)."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    streams = defaultdict(list)
    for r in sorted(docs.selectExpr("*", "xxhash64(42, doc_id, text) AS key").collect(), key=lambda r: r.key % 2 ** 64):
        streams[r.source] += [(w, r.doc_id, r.text) for w in words(r.text)]
    plan = sorted(sources, key=lambda r: r.source_no)
    blocks, need, want = {}, {}, {}
    for r in plan:
        stream, wanted = streams[r.source], int(r.target + 0.5)
        blocks[r.source] = [stream[i:i + block] for i in range(0, len(stream), block)]
        want[r.source], ranks = wanted, 0
        while wanted > 0:
            wanted -= len(blocks[r.source][ranks % len(blocks[r.source])])
            ranks += 1
        need[r.source] = ranks
    n = sum(need.values())
    out, taken, drawn = [], Counter(), Counter()

    def give(source):
        if drawn[source] >= need[source]:
            return
        no = drawn[source] % len(blocks[source])
        drawn[source] += 1
        got = blocks[source][no][:want[source]]
        want[source] -= len(got)
        out.append((source, no, [w for w, _, _ in got]))
        taken.update((i, t) for _, i, t in got)

    for slot in range(n):
        point, low = slot * 2654435769 % 2 ** 32, 0
        for r in plan:
            high = low + need[r.source]
            if int(low * (2 ** 32 / n)) <= point < int(high * (2 ** 32 / n)):
                give(r.source)
            low = high
    for r in plan:
        while drawn[r.source] < need[r.source]:
            give(r.source)
    return out, taken


def test_slots_match_a_loop(spark):
    docs = _docs(spark)
    sizes = docs.select("source", mixing.n_words(docs.text).alias("size"))
    want, taken = _loop(docs, mixing.source_targets(sizes).collect(), 16)
    rows = mixing.ordered(docs, block_words=16).orderBy("slot").collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert len({r.slot for r in rows}) == len(rows) and any(r.source is None for r in rows)
    assert [(r.source, r.block, [w for p in r.pieces for w in split(p.text)]) for r in rows] == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.words == sum(p.n_words for p in r.pieces)
        for p in r.pieces:
            assert split(texts[p.doc_id])[p.first_word:p.first_word + p.n_words] == split(p.text) and p.text in texts[p.doc_id]
    each = mixing.mix(docs, block_words=16, carry=("doc_id", "text")).selectExpr("rec.*", "taken").collect()
    got = Counter()
    for r in each:
        got[r.doc_id, r.text] += r.taken
    assert +got == taken and len(each) == docs.count()


def test_last_stage_applies_the_mix(spark):
    docs = _docs(spark)
    taken = mixing.mix(docs).selectExpr("rec.doc_id", "taken").groupBy("doc_id").sum("taken").collect()
    pieces = corpus_pipeline.mixture(spark, docs, "").selectExpr("inline(pieces)").groupBy("doc_id").sum("n_words").collect()
    assert {r[0]: r[1] for r in taken if r[1]} == {r[0]: r[1] for r in pieces} and any(r[1] == 0 for r in taken)
    assert mixing.ordered(docs.where("false")).count() == 0
