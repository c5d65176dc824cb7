"""Importance resampling of documents towards a target collection.

Words and pairs of neighbouring words fall into a fixed number of buckets. A bucket's gain is the scaled log ratio of
its smoothed share in the target to its share in the corpus, a document's weight the floored mean of its features'
gains, and a Gumbel key of the document's identifier turns the draw without replacement into "the k highest scores".

The k-th score is found by quickselect over the distributed table: each round draws random pivot keys from the range that
still holds the k-th key, one scan counts the rows below, at and above every pivot, and the range shrinks to the
gap between two pivots. Only the winners are then sorted and numbered.

Defined results: null texts and texts without words have no feature, weight 0, and are not eligible when a
least number of words is asked; a null identifier counts as empty text in the key and comes after all others in ties;
repeated rows are documents of their own, each with a place of its own in the order; an empty corpus gives an empty result,
an empty target a uniform one over the buckets. Further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import slices, text_or_empty
from gleaner.session import materialize

BUCKETS = 10_000
#: Pivot keys that one round of the selection draws.
PIVOTS = 24

#: Bytes of words stay, A-Z become a-z, all other ASCII bytes part words.
KEPT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def feature_buckets(raw: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every word and of every pair of neighbours."""
    words = raw.translate(KEPT).split(b" ")
    words = [w for w in words if w]
    single = list(map(zlib.crc32, words))
    # The sum of a pair goes on from its first word's.
    double = list(map(zlib.crc32, [b" " + w for w in words[1:]], single))
    return len(words), np.array(single + double, dtype=np.int64) % buckets


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    values = batch.column(batch.schema.get_field_index(name))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in every bucket over all rows of ``texts`` (column text): ``buckets`` numbers, whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for part in slices(batches):
            for raw in _raw(part, "text"):
                held += np.bincount(feature_buckets(raw, buckets)[1], minlength=buckets)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], ["bucket", "n"])

    parts = texts.select(text_or_empty().alias("text")).mapInArrow(count, "bucket long, n long")
    out = [0] * buckets
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Floored thousandfold log ratio of the smoothed shares, bucket by bucket."""
    of_corpus, of_target, extra = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * float(of_corpus + extra) / ((s + 1) * float(of_target + extra))))
            for s, t in zip(corpus, target, strict=True)]


def weighted(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row, from an array of gains."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.array(gain, dtype=np.int64)
        for part in slices(batches):
            rows = []
            for raw in _raw(part, "text"):
                words, found = feature_buckets(raw, len(gain))
                rows.append((words, len(found), int(array[found].sum()) // len(found) if len(found) else 0))
            words, features, weights = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(words, pa.int64()),
                 pa.array(features, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """Floored thousandfold Gumbel noise from the first 32 bits of sha256(``seed:doc_id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((bits.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def _before(key: tuple[int, int, int]) -> Column:
    """Rows that come before ``key`` in the order: score descending, identifier and tag ascending."""
    score, doc, tag = key
    return (F.col("score") > score) | ((F.col("score") == score) & (
        (F.col("place") < doc) | ((F.col("place") == doc) & (F.col("tag") < tag))))


def _at(key: tuple[int, int, int]) -> Column:
    return (F.col("score") == key[0]) & (F.col("place") == key[1]) & (F.col("tag") == key[2])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[int, int, int]:
    """The k-th composite key (score, place, tag) of the order, 1 <= k <= rows; keys are distinct.

    The driver holds some pivots and their counts. A range shrinks by a factor of about ``pivots`` a round, and a filter
    on the score prunes what the next scan reads.
    """
    low = high = None  # the key sought comes after low and before high
    ahead, turn = 0, 0
    while True:
        inside = keys
        if low:
            inside = inside.where((F.col("score") <= low[0]) & ~_before(low) & ~_at(low))
        if high:
            inside = inside.where((F.col("score") >= high[0]) & _before(high))
        drawn = inside.orderBy(F.xxhash64("tag", F.lit(turn)), "tag").limit(pivots).select("score", "place", "tag").collect()
        order = sorted({tuple(r) for r in drawn}, key=lambda x: (-x[0], x[1], x[2]))
        counts = inside.agg(*[F.count_if(_before(x)).alias(f"before{i}") for i, x in enumerate(order)]).first()
        wanted = k - ahead  # its place among the rows inside
        for i, key in enumerate(order):
            below = counts[f"before{i}"]
            if wanted == below + 1:
                return key
            if wanted <= below:
                high = key
                break
            low, passed = key, below + 1
        if low in order:
            ahead += passed
        turn += 1


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
              buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the undrawn have no rank.

    ``floor(percent * N / 100)`` of the N documents with at least ``least_words`` words are drawn, highest scores first.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + gumbel(seed))
    # Stored once: the selection reads it again and again, and its tags must stay.
    scored = materialize(scored.withColumn("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
                         .withColumn("tag", F.monotonically_increasing_id()), "resampling-scores")
    keys = scored.where(F.col("n_words") >= least_words).select("score", "place", "tag")
    k = percent * keys.count() // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*shown, undrawn)
    last = kth_key(keys, k)
    wins = (F.col("n_words") >= least_words) & (_before(last) | _at(last))
    order = [F.desc("score"), F.asc("place"), F.asc("tag")]
    # The high bits of ``at`` number the sorted ranges, the low ones the rows inside.
    winners = materialize(scored.where(wins).repartitionByRange(*order).sortWithinPartitions(*order)
                          .select(*shown, F.monotonically_increasing_id().alias("at")), "resampling-winners")
    part = F.shiftright("at", 33)
    held = sorted(winners.groupBy(part.alias("part")).count().collect())  # one row per range
    starts, passed = {}, 0
    for number, n in held:
        starts[number], passed = passed, passed + n
    offset = F.element_at(F.map_from_arrays(F.lit(np.array(list(starts), dtype=np.int64)),
                                            F.lit(np.array(list(starts.values()), dtype=np.int64))), part)
    ranked = winners.select(*shown, (offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return ranked.unionByName(scored.where(~wins).select(*shown, undrawn))
