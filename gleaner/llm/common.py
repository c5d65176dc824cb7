"""Pieces the training-data operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import materialize, ship  # noqa: F401

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: it cannot take dots and backticks, so such columns go under a number."""
    odd = {c: f"__column_{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
    if not odd:
        return df.mapInArrow(run, schema)
    plain = T.StructType([T.StructField(odd.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*[odd.get(c, c) for c in df.columns]).mapInArrow(run, plain).toDF(*schema.names)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the identifier's text, modulo ``folds``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 4 << 20,
           most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``most_bytes`` of text (one longer text stands alone).

    Memory of a task then depends on the slice and the longest text, not on the partition.
    """
    for batch in batches:
        sizes = np.diff(np.frombuffer(_offsets(batch.column(batch.schema.get_field_index(text))), dtype=np.int64))
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _offsets(column: pa.Array) -> bytes:
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64).tobytes()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in column(batch, name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    values = column(batch, name)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [t or b"" for t in values.cast(kind).to_pylist()]


def cell_offsets(cells: DataFrame, group: list[str], cell: str, value: str, name: str, low_bits: int = 10) -> DataFrame:
    """Exclusive running sum of ``value`` over the integer ``cell`` within ``group``.

    Sums are taken in two levels, so no window holds more than ``2**low_bits`` cells
    or the cells' high parts; the groups must not be null.
    """
    fine = cells.groupBy(*group, cell).agg(F.sum(value).alias("__v"))
    fine = fine.withColumn("__hi", F.shiftright(F.col(cell), low_bits))
    before = lambda keys, by: W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    high = fine.groupBy(*group, "__hi").agg(F.sum("__v").alias("__v"))
    high = high.withColumn("__base", F.coalesce(F.sum("__v").over(before(group, "__hi")), F.lit(0))).drop("__v")
    fine = fine.withColumn("__in", F.coalesce(F.sum("__v").over(before([*group, "__hi"], cell)), F.lit(0)))
    return fine.join(high, [*group, "__hi"]).select(*group, cell, (F.col("__base") + F.col("__in")).alias(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, by a hash of the identifier: doc_id, text, label.

    Equal identifiers in ``labels`` count once, with the larger label; null labels and identifiers are left out.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 0))
    marked = marked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all words; texts are parted by a blank in ``buffer``."""
    solid = ~SPACE[buffer]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_codes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code per word from all its bytes; words longer than ``POWERS`` are hashed by themselves."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.arange(total) - np.repeat(first, lengths)
    at = inside + np.repeat(starts, lengths)
    mixed = (buffer[at].astype(np.uint64) + np.uint64(1)) * POWERS[inside % len(POWERS)]
    codes = np.add.reduceat(mixed, first) ^ (lengths.astype(np.uint64) << np.uint64(40))
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    for i in np.flatnonzero(lengths > len(POWERS)).tolist():
        digest = hashlib.blake2b(buffer[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        codes[i] = np.uint64(int.from_bytes(digest, "little"))
    return codes


def connected(edges: DataFrame) -> DataFrame:
    """Least vertex of each connected component: (vertex, component) for every vertex of ``edges`` (a, b).

    Large-star and small-star passes, each a grouped minimum and a join, written to the shared folder;
    neither links nor components come to the driver, only a count and a checksum per pass.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(
            joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        edges = materialize(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()) if state[0] else spark.createDataFrame(
        [], "vertex long, component long")


def slice_numbers() -> Iterator[int]:
    """Numbers for the slices of this task, which no other task gives."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def answered(requests: DataFrame, answer, schema: str) -> DataFrame:
    """Answers of every bucket to its requests: ``answer`` takes a bucket's rows, in order of slices, as a dict of lists."""
    def one(rows: pa.Table) -> pa.Table:
        return answer(rows.sort_by("slice").to_pydict())

    return requests.groupBy("bucket").applyInArrow(one, schema)
