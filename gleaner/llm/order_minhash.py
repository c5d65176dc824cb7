"""Near-duplicate classes by Order MinHash.

A text is its sequence of shingles of five words, each labelled with its occurrence
number, so that all labels of a text differ. For each hash function a sketch takes the
texts' several least labels and keeps them in text order: two texts share a sketch when
those labels agree and stand in the same order, which follows edit similarity rather
than mere overlap. Texts that share any sketch are candidates; they are verified by a
banded alignment of their labelled shingles.

Every member of a sketch is compared with its least member. Where that leaves a sketch's
members in several components, comparing all of them would grow with the square of a
common passage's documents; there, texts meet on their rarest labels instead. Texts as
alike as ``least`` share one of the rarest labels that are beyond the share they must have
in common, so no link is lost, and a passage that many texts hold brings none together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import column, columns_of, connected, free_name, raw_texts, slices, text_or_empty, word_codes, word_spans
from gleaner.session import fresh_path, materialize, scratch

SHINGLE = 5
#: (hash functions, labels kept) of the sketches: of all texts, and of texts of at most SHORT shingles besides.
LONG, BRIEF, SHORT = (32, 5), (24, 3), 80
ODD = np.random.default_rng(20).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIECE = 1 << 14
#: Bits of a label that name its bin in the table of frequencies, which is bounded by them.
BIN_BITS = 20
#: Pairs of a text that one copy of it is sent to.
PER_HEAD = 128
#: Members of a label that all its members meet before those still apart meet each other.
FIRST = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def labelled_shingles(raws: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Labels of each text's shingles in text order, and a digest of its words (lower case A-Z).

    A text of fewer than five words has one shingle of them all, a text without words none and an empty digest.
    """
    buffer = np.frombuffer(b" ".join(raws).lower() + b" ", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])[:-1]]).astype(np.int64)
    starts, ends, doc = word_spans(buffer, offsets)
    codes = word_codes(buffer, starts, ends)
    words = np.bincount(doc, minlength=len(raws))
    cuts = np.concatenate([[0], np.cumsum(words)])
    digests = [hashlib.blake2b(codes[cuts[i]:cuts[i + 1]].tobytes(), digest_size=16).digest() if words[i] else b"" for i in range(len(raws))]
    padded = np.concatenate([codes, np.zeros(SHINGLE, dtype=np.uint64)])
    shingles = np.zeros(len(codes), dtype=np.uint64)
    for j in range(SHINGLE):
        inside = np.arange(len(codes)) + j < cuts[doc + 1] if len(codes) else np.zeros(0, dtype=bool)
        shingles = _mix(shingles + np.where(inside, padded[j:j + len(codes)], np.uint64(j)))
    counts = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    at = np.arange(len(codes)) - cuts[doc] < counts[doc] if len(codes) else np.zeros(0, dtype=bool)
    shingles, doc = shingles[at], doc[at]
    # Number the occurrences of a shingle within its text: a stable sort brings them together in text order.
    key = _mix(shingles + _mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(len(ranked), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(fresh)
    number = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    again = number > 0
    if again.any():
        shingles = shingles.copy()
        shingles[order[again]] = _mix(shingles[order[again]] + number[again].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.split(shingles, np.cumsum(counts)[:-1]), digests


def _least(labels: np.ndarray, functions: int, kept: int) -> np.ndarray:
    """Positions of the ``kept`` labels least under each function, in text order: an array (kept, functions)."""
    hashed = ((labels[:, None] * ODD[None, :functions]) >> np.uint64(32)).astype(np.uint32)
    if len(labels) > kept:
        chosen = np.argpartition(hashed, kept - 1, axis=0)[:kept]
        return np.sort(chosen, axis=0)
    return np.repeat(np.arange(len(labels))[:, None], functions, axis=1)


def sketches(labels: np.ndarray) -> np.ndarray:
    """Keys of a text's sketches; texts that share a key are candidates."""
    if not len(labels):
        return np.zeros(0, dtype=np.int64)
    keys = []
    for kind, (functions, kept) in enumerate([LONG, BRIEF] if len(labels) <= SHORT else [LONG]):
        if len(labels) > PIECE:  # a very long text piece by piece: the least of all are among the least of the pieces
            parts = [np.sort(a + _least(labels[a:a + PIECE], functions, kept), axis=0) for a in range(0, len(labels), PIECE)]
            pool = np.concatenate(parts)
            hashed = ((labels[pool] * ODD[None, :functions]) >> np.uint64(32)).astype(np.uint32)
            chosen = np.argpartition(hashed, kept - 1, axis=0)[:kept]
            at = np.sort(np.take_along_axis(pool, chosen, axis=0), axis=0)
        else:
            at = _least(labels, functions, kept)
        key = np.full(functions, kind + 1, dtype=np.uint64) + ODD[:functions]
        for row in labels[at]:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Labels aligned in order over all labels of both texts; 0 where it must be below ``least``.

    Texts as alike as ``least`` have few unaligned labels, so an alignment of theirs stays in a band of
    that width. Labels are distinct within a text, so the longest alignment is the longest rising
    run of matched positions.
    """
    total = len(a) + len(b)
    if not total:
        return 0.0
    need = least / (1 + least) * total
    band = total - 2 * need + 1e-9
    if abs(len(a) - len(b)) > band:
        return 0.0
    _, left, right = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(left - right) <= band
    left, right = left[near], right[near]
    if len(left) < need - 1e-9:
        return 0.0
    right = right[np.argsort(left)]
    if np.all(np.diff(right) > 0):
        aligned = len(right)
    else:
        tails: list[int] = []
        for p in right.tolist():
            k = bisect_left(tails, p)
            if k == len(tails):
                tails.append(p)
            else:
                tails[k] = p
        aligned = len(tails)
    share = aligned / (total - aligned)
    return share if share >= least - 1e-12 else 0.0


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        labels, digests = labelled_shingles(raw_texts(batch))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "text"), pa.array(digests, type=pa.binary()),
             pa.array([len(x) for x in labels], type=pa.int64()), pa.array([sketches(x) for x in labels], type=pa.list_(pa.int64()))],
            names=["doc_id", "text", "digest", "n", "keys"])


def _verify(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose texts align to ``least`` or more.

    ``rows`` is stored in buckets of ``row``, so texts that no pair asks for stay where they are. The text of b goes along with
    its pair; the text of a goes once to every ``PER_HEAD`` of its pairs, which also spreads the pairs of a common a.
    """
    left = rows.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = rows.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HEAD).cast("int").alias("parts"))
    heads = left.join(parts, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    met = dealt.join(right, "b").join(heads, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", 2 << 20), "text_b", 2 << 20):
            # A text that meets many others is cut into shingles once a slice.
            texts = raw_texts(batch, "text_a") + raw_texts(batch, "text_b")
            distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            labels, _ = labelled_shingles(list(distinct))
            labels = [labels[distinct[t]] for t in texts]
            n = batch.num_rows
            found = [i for i in range(n) if alignment_similarity(labels[i], labels[n + i], least)]
            yield pa.RecordBatch.from_arrays([column(batch, "a").take(pa.array(found, type=pa.int64())),
                                              column(batch, "b").take(pa.array(found, type=pa.int64()))], names=["a", "b"])

    return met.mapInArrow(check, "a long, b long")


def _bucketed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` stored in buckets of ``key`` in the shared folder: a join on the key then moves the other side only."""
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def _levels(rows: DataFrame) -> np.ndarray:
    """Magnitude (log2) of the number of labels of ``rows`` in each bin; it orders labels and decides nothing else."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BIN_BITS, dtype=np.int64)
        for batch in slices(batches):
            labels, _ = labelled_shingles(raw_texts(batch))
            held += np.bincount(_bins(np.concatenate(labels)), minlength=len(held))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["bin", "n"])

    counted = rows.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.zeros(1 << BIN_BITS, dtype=np.uint8)
    out[counted["bin"].to_numpy()] = np.log2(np.maximum(counted["n"].to_numpy(), 1)).astype(np.uint8)
    return out


def _bins(labels: np.ndarray) -> np.ndarray:
    return (labels >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def rarest(labels: np.ndarray, levels: np.ndarray, least: float) -> np.ndarray:
    """The rarest labels of a text, as many as leave fewer than any text alike by ``least`` has in common with it."""
    kept = len(labels) - int(np.ceil(least * len(labels) - 1e-9)) + 1
    return labels[np.lexsort((labels, levels[_bins(labels)]))[:kept]]


def _of_mixed_labels(listed: DataFrame) -> DataFrame:
    """Rows of ``listed`` whose label occurs in several components."""
    mixed = listed.groupBy("label").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("label")
    return listed.join(mixed, "label")


def _alike(one: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of rows from different components that share a label and can be as alike as ``least``.

    After the first label that two texts share, both must have enough labels left for that; texts of
    too different lengths never have.
    """
    left, right = (df.select("label", F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"),
                             (F.col("n") - F.col("at")).alias(f"left_{x}")) for df, x in ((one, "a"), (other, "b")))
    either = F.col("a") < F.col("b") if one is other else F.col("a") != F.col("b")
    pairs = left.join(right, "label").where(either & (F.col("ca") != F.col("cb")) & (
        F.least("left_a", "left_b") >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shared_rarest(apart: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The rarest labels (row, n, component, at, label) of the rows ``apart`` that occur in several components."""
    held = rows.select("row", "text").join(apart, "row")
    levels = rows.sparkSession.sparkContext.broadcast(_levels(held))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            labels, _ = labelled_shingles(raw_texts(batch))
            found = [rarest(x, levels.value, least).view(np.int64) for x in labels]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "n"), column(batch, "component"),
                                              pa.array(found, type=pa.list_(pa.int64()))], names=["row", "n", "component", "labels"])

    listed = held.mapInArrow(prefixes, "row long, n long, component long, labels array<long>")
    listed = materialize(listed.select("row", "n", "component", F.posexplode("labels").alias("at", "label")), "omh-rarest")
    return materialize(_of_mixed_labels(listed), "omh-shared")


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id (least identifier of its class), kept (true for one row of each class).

    Classes are the components of the links between texts whose alignment reaches ``least``. Texts with
    equal words are one class from the start and only one of them is compared. Texts without words, null
    texts among them, are classes of their own. Identifiers may be null or repeat: rows count; a class of null identifiers has a
    null class_id. Other columns are ignored; an empty table gives no rows.
    """
    return _classes(docs, least).select("doc_id", "class_id", "kept")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select("doc_id", text_or_empty().alias("text"))
    sketched = materialize(source.mapInArrow(_sketched, "doc_id long, text string, digest binary, n long, keys array<long>")
                           .select(F.monotonically_increasing_id().alias("row"), "*"), "omh-rows")
    rows = sketched.drop("text")
    copies = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    copies = materialize(rows.select("row", "digest", "n").where("n > 0").join(copies, "digest").select("row", "first", "n"), "omh-copies")
    firsts = copies.where("row = first").select("row")

    # Members of every sketch that two texts share; each is first compared with the least member.
    keyed = rows.join(firsts, "row", "left_semi").select("row", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("row").alias("head"), F.max("row").alias("tail")).where("head < tail")
    members = materialize(keyed.join(shared.select("key", "head"), "key").select("key", "row", "head", "n"), "omh-members")
    # Only texts that share a sketch with another are ever compared; they are dealt into buckets once.
    texts = sketched.select("row", "text").join(members.select("row").distinct(), "row", "left_semi")
    texts = _bucketed(texts, "row", "omh-texts")
    stars = materialize(members.where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct(), "omh-stars")
    linked = materialize(_verify(stars, texts, least), "omh-links")
    component = materialize(connected(linked), "omh-components")

    # Members of a sketch left in different components meet again on their rarest labels, so that no link is lost.
    placed = members.join(component.withColumnRenamed("vertex", "row"), "row", "left").select(
        "key", "row", "n", F.coalesce("component", "row").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    apart = materialize(placed.join(mixed, "key", "left_semi").select("row", "n", "component").distinct(), "omh-apart")
    shared = _shared_rarest(apart, texts, least)
    # First with a few members of each label, others from label to label; what they link need not meet again.
    heads = shared.groupBy("label").agg(F.array_distinct(F.array(*[F.min_by(
        F.struct("row", "n", "component", "at"), F.xxhash64(F.lit(seed), "label", "row")) for seed in range(FIRST)])).alias("heads"))
    heads = materialize(_alike(shared, heads.select("label", F.inline("heads")), least).join(stars, ["a", "b"], "left_anti"), "omh-heads")
    linked = materialize(linked.unionByName(_verify(heads, texts, least)), "omh-links")
    component = materialize(connected(linked), "omh-components")
    shared = shared.drop("component").join(component.withColumnRenamed("vertex", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    shared = materialize(_of_mixed_labels(shared), "omh-shared")
    pairs = materialize(_alike(shared, shared, least).join(stars.unionByName(heads), ["a", "b"], "left_anti"), "omh-pairs")
    more = materialize(_verify(pairs, texts, least), "omh-more")
    final = component if more.isEmpty() else materialize(connected(linked.unionByName(more)), "omh-final")
    # Component of each row, then its least identifier.
    told = rows.select("row", "doc_id").join(copies.select("row", "first"), "row", "left")
    told = told.withColumn("first", F.coalesce("first", "row")).join(final.withColumnRenamed("vertex", "first"), "first", "left")
    told = told.select("row", "doc_id", F.coalesce("component", "first").alias("component"))
    least_id = told.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min(
        F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))["row"].alias("keeper"))
    return told.join(least_id, "component").select("row", "doc_id", "class_id", (F.col("row") == F.col("keeper")).alias("kept"))


def distinct_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One document of each class with all its columns: the first in the table's order.

    The numbered documents and the numbers to drop are stored; the tables that led to them are deleted.
    """
    row = free_name(docs, "__row")
    with scratch(docs.sparkSession, keep="omh-kept-"):
        numbered = materialize(docs.select(F.monotonically_increasing_id().alias(row), *columns_of(docs)), "omh-kept-input")
        dropped = _classes(numbered.select(F.col(row).alias("doc_id"), "text"), least).where("NOT kept")
        dropped = materialize(dropped.select(F.col("doc_id").alias(row)), "omh-kept-dropped")
    return numbered.join(dropped, row, "left_anti").drop(row)
