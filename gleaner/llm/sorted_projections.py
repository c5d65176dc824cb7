"""Near-duplicate embeddings by sorted projection passes.

A pass gives each distinct vector the concatenated signs of 64 random projections, orders all vectors by that string of
bits, and compares each with a bounded window of followers; what passes the exact cosine is united with a local
union-find, and a pass sends at most one link per vector. The number of passes follows from the number of vectors: two
vectors at the threshold agree in a bit with a known probability, and enough passes are made that they meet with the
wanted recall. Links of all passes give the components.

A window is bounded, a group of near copies is not. The windows therefore only decide which vectors hang together;
links are counted afterwards inside each component, block against block, so that every pair of a component is compared and
none is sent. Copies of one vector are a single vector with a count all along, however many they are.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are components of their
own; vectors of different lengths are not compared; rows that share an identifier are separate vectors that are
reached together; a row without identifier links with nothing and has neither component nor kept; an
empty table gives an empty result. Columns other than the two named ones, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import connected
from gleaner.operators.joins import spread_join
from gleaner.session import materialize

BITS = 64
#: Followers that a vector is compared with in each pass.
WINDOW = 48
#: Chance of a pair at the threshold to meet in some pass.
RECALL = 0.99
#: Members of a component that one comparison holds on either side.
BLOCK = 1024


def passes(vectors: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which two vectors at the threshold have shared a window with probability ``recall``.

    They share one where they agree on the bits that part the table into stretches of half a window.
    """
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(0, math.ceil(math.log2(max(1, vectors) / (window / 2))))
    each = agree ** bits
    return 1 if each >= recall else math.ceil(math.log(1 - recall) / math.log(1 - each))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, in doubles; first by their largest component, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _packed(code: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keys = [], []
            for cells in batch.column(batch.schema.get_field_index("vector")).to_pylist():
                raw = None
                if cells and None not in cells:
                    array = np.array(cells, dtype=code)
                    if np.isfinite(array).all() and array.any():
                        raw = (array + 0).tobytes()
                out.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).hexdigest() if raw else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), pa.array(keys, pa.string()), pa.array(out, pa.binary())],
                ["vec_id", "key", "raw"])
    return run


def _signs(code: str, first: int, last: int, seed: int):
    """Sort keys of passes ``first`` to ``last - 1``, one row per vector and pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))
        for batch in batches:
            raws = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            sizes = np.array([len(r) for r in raws])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                rows = np.frombuffer(b"".join(raws[i] for i in at), dtype=code).reshape(len(at), -1)
                for number in range(first, last):
                    plane = planes.get((size, number))
                    if plane is None:
                        plane = np.random.default_rng([seed, size, number]).standard_normal((rows.shape[1], BITS))
                        planes[size, number] = plane
                    bits = (_unit(rows) @ plane > 0).astype(np.uint64)
                    order = ((bits * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(at), pa.int32()), pa.array([size] * len(at), pa.int32()), pa.array(order),
                         part.column(part.schema.get_field_index("vertex")), part.column(part.schema.get_field_index("raw"))],
                        ["pass", "size", "order", "vertex", "raw"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each set after uniting a[i] with b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _met(rows: np.ndarray, place: np.ndarray, window: int, threshold: float, outer: np.ndarray | None = None):
    """Pairs of rows within ``window`` places whose cosine reaches the threshold; ``outer``: of different parts only."""
    left, right = [], []
    for step in range(1, min(window, len(rows) - 1) + 1):
        near = place[step:] - place[:-step] <= window
        if outer is not None:
            near &= outer[step:] != outer[:-step]
        at = np.flatnonzero(near)
        if len(at):
            at = at[np.einsum("ij,ij->i", rows[at], rows[at + step]) >= threshold]
            left.append(at)
            right.append(at + step)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _links(vertices: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from every vertex of a set to one of the set."""
    root = _roots(len(vertices), a, b)
    at = np.flatnonzero(root != np.arange(len(vertices)))
    return vertices[at], vertices[root[at]]


COMPARED = "a long, b long, part int, place long, pass int, size int, vertex long, raw binary"


def _windows(code: str, window: int, threshold: float, chunk: int = 4096):
    """Links inside a sorted part, and its first and last rows for the comparison across parts."""
    def links(vertices, a, b):
        yes, no = _links(vertices, a, b)
        gaps = pa.nulls(len(yes))
        return pa.RecordBatch.from_arrays([pa.array(yes), pa.array(no)] + [gaps.cast(t) for t in (
            pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())], ["a", "b", "part", "place", "pass", "size", "vertex", "raw"])

    def border(part, place, numbers, sizes, vertices, raws):
        n = len(place)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n).cast(pa.int64()), pa.nulls(n).cast(pa.int64()), pa.array([part] * n, pa.int32()), pa.array(place, pa.int64()),
             pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(vertices, pa.int64()), pa.array(raws, pa.binary())],
            ["a", "b", "part", "place", "pass", "size", "vertex", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, tail = TaskContext.get().partitionId(), 0, None
        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                now = {c: batch.column(i).to_pylist() if c == "raw" else batch.column(i).to_numpy() for i, c in enumerate(batch.schema.names)}
                now["place"] = np.arange(seen, seen + batch.num_rows)
                if seen < window:
                    head = min(batch.num_rows, window - seen)
                    yield border(part, now["place"][:head], now["pass"][:head], now["size"][:head], now["vertex"][:head], now["raw"][:head])
                seen += batch.num_rows
                held = now if tail is None else {c: tail[c] + now[c] if c == "raw" else np.concatenate([tail[c], now[c]]) for c in now}
                # Stretches of one pass and one vector length are compared by themselves.
                edge = np.flatnonzero((np.diff(held["pass"]) != 0) | (np.diff(held["size"]) != 0)) + 1
                for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(held["place"])], strict=True):
                    rows = _unit(np.frombuffer(b"".join(held["raw"][low:high]), dtype=code).reshape(high - low, -1))
                    a, b = _met(rows, held["place"][low:high], window, threshold)
                    if len(a):
                        yield links(held["vertex"][low:high], a, b)
                tail = {c: held[c][-window:] for c in held}
        if tail is not None:  # rows that the head has not given yet
            late = tail["place"] >= window
            raws = [r for r, k in zip(tail["raw"], late, strict=True) if k]
            yield border(part, tail["place"][late], tail["pass"][late], tail["size"][late], tail["vertex"][late], raws)
    return run


def _across(code: str, window: int, threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        vertices, a, b = rows["vertex"].to_numpy(), [], []
        kinds = list(zip(rows["pass"].to_pylist(), rows["size"].to_pylist(), strict=True))
        for kind in sorted(set(kinds)):
            mine = np.array([i for i, k in enumerate(kinds) if k == kind])
            raws = rows["raw"].take(pa.array(mine)).to_pylist()
            units = _unit(np.frombuffer(b"".join(raws), dtype=code).reshape(len(mine), -1))
            left, right = _met(units, rows["at"].to_numpy()[mine], window, threshold, rows["part"].to_numpy()[mine])
            a.append(mine[left])
            b.append(mine[right])
        yes, no = _links(vertices, np.concatenate(a), np.concatenate(b)) if a else ([], [])
        return pa.table({"a": pa.array(yes, pa.int64()), "b": pa.array(no, pa.int64())})
    return run


def pass_links(vectors: DataFrame, code: str, first: int, last: int, threshold: float, window: int, seed: int) -> DataFrame:
    """Links (a, b) that the passes ``first`` to ``last - 1`` find among distinct vectors (vertex, raw)."""
    spark = vectors.sparkSession
    parts = max(last - first, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["pass", "size", "order", "vertex"]
    ordered = (vectors.mapInArrow(_signs(code, first, last, seed), "pass int, size int, order long, vertex long, raw binary")
               .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    met = materialize(ordered.mapInArrow(_windows(code, window, threshold), COMPARED), "projection-windows")
    # Places in the whole order: a part starts where the ones before it end. One row per part, whatever the rows.
    sizes = met.where("part is not null").groupBy("part").agg((F.max("place") + 1).alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = met.where("part is not null").join(F.broadcast(sizes.select("part", ahead.alias("ahead"))), "part")
    edges = edges.withColumn("at", F.col("ahead") + F.col("place"))
    # A row meets followers in its own stretch of places and in the next one.
    length = 8 * window
    cell = F.floor(F.col("at") / length)
    cells = F.when(F.col("at") % length < window, F.array(cell, cell - 1)).otherwise(F.array(cell))
    edges = edges.select(F.explode(cells).alias("cell"), "part", "at", "pass", "size", "vertex", "raw")
    across = edges.groupBy("cell").applyInArrow(_across(code, window, threshold), "a long, b long")
    return met.where("a is not null").select("a", "b").unionByName(across)


def _counted(code: str, threshold: float):
    """Links of every member, from the blocks of one bucket: left members against right ones of the same comparison."""
    def sums(left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([((left[i:i + BLOCK] @ right.T) >= threshold) @ weights for i in range(0, len(left), BLOCK)])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("size", "ascending"), ("t", "ascending"), ("u", "ascending"), ("own", "ascending")])
        held = {c: rows[c].to_pylist() if c in ("raw", "key") else rows[c].to_numpy(zero_copy_only=False) for c in rows.column_names}
        change = np.zeros(max(0, len(rows) - 1), dtype=bool)
        for c in ("component", "size", "t", "u"):
            change |= np.diff(held[c]) != 0
        keys, counts = [], []
        edge = (np.flatnonzero(change) + 1).tolist()
        for low, high in zip([0, *edge], [*edge, len(rows)], strict=True):
            own, n = held["own"][low:high], held["n"][low:high]
            units = _unit(np.frombuffer(b"".join(held["raw"][low:high]), dtype=code).reshape(high - low, -1))
            if held["t"][low] == held["u"][low]:
                found = sums(units, units, n)
                # A vector reaches the threshold with itself, or misses it by rounding.
                found = found - n * (np.einsum("ij,ij->i", units, units) >= threshold)
            else:
                side = own == held["t"][low]
                found = np.zeros(high - low, dtype=np.int64)
                if side.any() and not side.all():
                    found[side], found[~side] = sums(units[side], units[~side], n[~side]), sums(units[~side], units[side], n[side])
            keys += held["key"][low:high]
            counts.append(found)
        return pa.table({"key": pa.array(keys, pa.string()), "links": pa.array(np.concatenate(counts) if counts else [], pa.int64())})
    return run


def component_links(members: DataFrame, code: str, threshold: float) -> DataFrame:
    """Links (key, links) of each distinct vector to the others of its component, weighted by their counts.

    ``members`` holds component, key, n, raw. A component of m members is dealt into m / BLOCK tiles by a hash, and each
    pair of tiles is one comparison; small components share a task.
    """
    sized = members.withColumn("size", F.length("raw").cast("int"))
    tiles = sized.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("tiles"))
    dealt = spread_join(sized, tiles, "component", salt_by="key")
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("t", F.least("own", "other")).withColumn("u", F.greatest("own", "other"))
    rows = materialize(dealt.select("component", "size", "t", "u", "own", "key", "n", "raw"), "projection-tiles")
    buckets = max(1, rows.count() // (8 * BLOCK))
    bucket = F.pmod(F.xxhash64("component", "t", "u"), F.lit(buckets))
    counted = rows.groupBy(bucket.alias("bucket")).applyInArrow(_counted(code, threshold), "key string, links long")
    return counted.groupBy("key").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, vector: str = "embedding", threshold: float = 0.95, window: int = WINDOW,
                 recall: float = RECALL, seed: int = 13) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id and the column named by ``vector``)."""
    inner = vectors.schema[vector].dataType
    code = "<f4" if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.FloatType) else "<f8"
    cells = F.col(f"`{vector}`").cast("array<float>" if code == "<f4" else "array<double>")
    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), cells.alias("vector")).mapInArrow(
        _packed(code), "vec_id long, key string, raw binary"), "projection-vectors")
    sound = rows.where(F.col("key").isNotNull() & F.col("vec_id").isNotNull())
    distinct = materialize(sound.groupBy("key").agg(F.min("vec_id").alias("vertex"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")),
                           "projection-distinct")
    # Some passes at a time, so that what is on disk at once follows the vectors, not the number of passes.
    number, found, group = passes(distinct.count(), threshold, window, recall), None, 4
    for first in range(0, number, group):
        new = pass_links(distinct.select("vertex", "raw"), code, first, min(number, first + group), threshold, window, seed)
        new = materialize(new.distinct(), "projection-links")
        found = new if found is None else found.unionByName(new)
    # Different vectors under one identifier are one vertex of the graph.
    components = connected(found).withColumnRenamed("vertex", "vertex_id")
    held = distinct.join(components, distinct["vertex"] == components["vertex_id"], "left").select(
        "key", "vertex", "n", "raw", F.coalesce("component", "vertex").alias("component"))
    held = materialize(held, "projection-members")
    several = held.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("component")
    links = component_links(spread_join(held, several, "component", salt_by="key"), code, threshold)
    known = held.join(links, "key", "left").select(
        "key", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    shown = spread_join(rows.where(F.col("key").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "key"), known, "key", salt_by="vec_id")
    alone = rows.where(F.col("key").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = shown.select("vec_id", "links", "component").unionByName(alone)
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
