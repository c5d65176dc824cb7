"""Periodic runs of words: maximal stretches that repeat with a period, found by scale.

A run of period q covers some boundary of its octave (2**o <= q < 2**(o + 1); boundaries every 2**(o + 1) words) with a block of
2**o words that returns q words later. Fingerprints of blocks, doubled from octave to octave, name such boundaries and
periods; the Z-values of the words at and before the boundary then say exactly how far the period holds on either side, within a
window around the boundary. A document too long for one task's pass is cut into overlapping tiles per
octave, as rows that Spark spreads; tiles are solved independently. Fragments are shuffled by document and period and
stitched where they overlap by a period. By Fine and Wilf's theorem a stretch of four periods has a smaller period only where
its first period repeats a shorter stretch, so that a tile can tell by itself that a period is not the smallest.

Costs: a document takes O(n) vectorised steps per octave, whatever its words. Memory of a task is bounded by a slice
of texts, one tile, or the words of one document.

Defined results: null and empty texts have no word and no run; a null identifier is not periodised; repeated rows give equal
rows; an empty table gives an empty result. Columns other than the two named ones, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import raw_texts, slices, text_or_empty
from gleaner.operators.joins import spread_join
from gleaner.session import materialize

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Least reach of a window on either side of its boundary, in words.
REACH = 1024
#: Longer texts, in bytes, are cut into tiles.
LONG = 1 << 16
#: Words of a tile's core for the small octaves; larger octaves have a core of 64 boundaries' blocks each.
CORE, SMALL_OCTAVES = 1 << 15, 9

FRAGMENT = pa.struct([("q", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
TILE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("low", pa.int64()),
                  ("high", pa.int64()), ("codes", pa.binary())])


def _same(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common start: the Z-value of ``right`` against ``left``."""
    differ = left != right
    at = int(differ.argmax()) if len(differ) else 0
    return at if len(differ) and differ[at] else len(differ)


@lru_cache(maxsize=4096)
def _prime_factors(q: int) -> tuple[int, ...]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return tuple(out + [q] if q > 1 else out)


def _power(word: np.ndarray) -> bool:
    """Whether the stretch repeats a shorter one, so that its length is not the smallest period."""
    q = len(word)
    return any(np.array_equal(word[:q - q // r], word[q // r:]) for r in _prime_factors(q))


def solve(codes: np.ndarray, first: int, last: int, low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of periods 2**first <= q < 2**(last + 1) at boundaries in [low, high) of the array.

    ``low`` is a multiple of every octave's spacing. A fragment is a run of the array clipped to windows, and
    windows of one run are already joined.
    """
    n = len(codes)
    high = n if high is None else high
    prints = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    prints ^= prints >> np.uint64(31)
    found: dict[int, list[list[int]]] = {}
    for octave in range(last + 1):
        block = 1 << octave
        if LEAST_PERIODS * block > n:
            break
        if octave:
            half = block >> 1
            prints = prints[:-half] * np.uint64(0xBF58476D1CE4E5B9 + 2 * octave) + prints[half:]
            prints ^= prints >> np.uint64(29)
        if octave < first:
            continue
        # Boundaries where the block returns after q words, block <= q < 2 * block.
        step, most = 2 * block, len(prints)
        begin, rows = low // step, -(-(min(high, most) - low) // step)
        if rows <= 0:
            continue
        held = prints[begin * step:(begin + rows) * step]
        held = np.concatenate([held, np.zeros(rows * step - len(held), dtype=np.uint64)]).reshape(rows, step)
        at, shift = np.nonzero(held[:, block:] == held[:, :1])
        centres, periods = (at + begin) * step, shift + block
        inside = centres + periods < most
        centres, periods = centres[inside], periods[inside]
        if not len(centres):
            continue
        # Inside a run of a smaller octave every period is a multiple of that run's.
        if found:
            known = np.zeros(n + 1, dtype=np.int64)
            for runs in found.values():
                for start, end in runs:
                    known[start] = max(known[start], end)
            fresh = np.maximum.accumulate(known)[centres] < centres + periods + block
            centres, periods = centres[fresh], periods[fresh]
        reach, fragments = max(LEAST_PERIODS * step, REACH), {}
        for centre, q in zip(centres.tolist(), periods.tolist(), strict=True):
            runs = fragments.setdefault(q, [])
            if runs:
                start, end, clipped = runs[-1]
                if start <= centre and centre + q + block <= end and (not clipped or centre + q + block + step <= end):
                    continue
            right, left = min(n, centre + reach), max(0, centre - reach)
            ahead = _same(codes[centre:right - q], codes[centre + q:right])
            if ahead < block:  # equal fingerprints of different blocks
                continue
            behind = _same(codes[left:centre][::-1], codes[left + q:centre + q][::-1])
            start, end = centre - behind, centre + q + ahead
            if end - start < max(LEAST_WORDS, LEAST_PERIODS * q) or _power(codes[centre:centre + q]):
                continue
            if runs and start <= runs[-1][1] - q:
                runs[-1] = [runs[-1][0], max(end, runs[-1][1]), end == right < n]
            else:
                runs.append([start, end, end == right < n])
        for q, runs in fragments.items():
            if runs:
                found[q] = [[start, end] for start, end, _ in runs]
    return [(q, start, end) for q, runs in found.items() for start, end in runs]


def octaves(n: int) -> int:
    """The largest octave whose runs fit into n words, or -1."""
    return (n // LEAST_PERIODS).bit_length() - 1


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Overlapping tiles of a long document: octaves, first word, core within the tile, codes."""
    n, top = len(codes), octaves(len(codes))
    if top < 0:
        return
    groups = [(0, min(top, SMALL_OCTAVES), CORE)] + [(o, o, 64 << o) for o in range(SMALL_OCTAVES + 1, top + 1)]
    for first, last, core in groups:
        halo = max(2 * LEAST_PERIODS << last, REACH)
        for low in range(0, n, core):
            start, end = max(0, low - halo), min(n, low + core + halo + (2 << last))
            yield first, last, start, low - start, min(core, n - low) + low - start, codes[start:end].astype("<i4").tobytes()


Shape = Callable[[int | None, list[bytes]], list[bytes]]


def periodised(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of the contract: every tenth identifier's document repeats from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    code = zlib.crc32(str(doc_id).encode())
    if code % 10:
        return words
    g = code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _numbered(words: list[bytes], base: int) -> tuple[list[int], int]:
    """A number per different word of one document, from ``base`` on: documents of a slice share no number."""
    held: dict[bytes, int] = {}
    return [held.setdefault(w, base + len(held)) for w in words], base + len(held)


def _records(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column(part.schema.get_field_index("doc_id"))
            numbers, starts, base, longest, kept, cut = [], [], 0, 0, [], []
            for doc, raw in zip(ids.to_pylist(), raw_texts(part), strict=True):
                words = shape(doc, raw.split())
                starts.append(len(numbers))
                kept.append(words)
                if len(raw) > LONG:
                    own, _ = _numbered(words, 0)
                    cut.append([dict(zip(("first", "last", "start", "low", "high", "codes"), t, strict=True))
                                for t in tiles(np.array(own, dtype=np.int64))])
                else:
                    own, base = _numbered(words, base)
                    numbers += own
                    longest = max(longest, len(own))
                    cut.append(None)
            pieces: list[list[dict]] = [[] for _ in kept]
            border = np.array(starts)
            for q, s, e in solve(np.array(numbers, dtype=np.int64), 0, octaves(longest)):
                at = int(np.searchsorted(border, s, side="right")) - 1
                pieces[at].append({"q": q, "s": s - starts[at], "e": e - starts[at]})
            joined = [b" ".join(w) for w in kept]
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("key")), ids, pa.array([len(w) for w in kept], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in joined]),
                pa.array([t if p or c else None for t, p, c in zip(joined, pieces, cut, strict=True)], pa.binary()),
                pa.array(pieces, pa.list_(FRAGMENT)), pa.array(cut, pa.list_(TILE))],
                ["key", "doc_id", "n", "plain", "words", "fragments", "tiles"])
    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = solve(np.frombuffer(row["codes"], dtype="<i4").astype(np.int64), row["first"], row["last"], row["low"], row["high"])
            columns = [[q for q, _, _ in found], [s + row["start"] for _, s, _ in found], [e + row["start"] for _, _, e in found]]
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found), pa.string())] +
                                             [pa.array(c, pa.int64()) for c in columns], ["key", "q", "s", "e"])


def records(docs: DataFrame, shape: Shape = periodised) -> DataFrame:
    """One row per document: key of identifier and text, number and digest of words, fragments of short texts, tiles of long ones.

    ``words`` holds the words of documents that may have runs. Equal rows have equal keys and fragments.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))
    return named.withColumn("key", key).mapInArrow(_records(shape), (
        "key string, doc_id long, n long, plain string, words binary, fragments array<struct<q: long, s: long, e: long>>, "
        "tiles array<struct<first: int, last: int, start: long, low: long, high: long, codes: binary>>"))


def stitched(fragments: DataFrame) -> DataFrame:
    """Maximal runs (key, start, length, period) from fragments (key, q, s, e) that overlap by a period."""
    order = Window.partitionBy("key", "q").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = F.when(before.isNull() | (F.col("s") > before - F.col("q")), 1).otherwise(0)
    whole = fragments.select("key", "q", "s", "e", parted.alias("parted"))
    whole = whole.withColumn("island", F.sum("parted").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.groupBy("key", "q", "island").agg(F.min("s").alias("start"), F.max("e").alias("e"))
    return whole.select("key", "start", (F.col("e") - F.col("start")).alias("length"), F.col("q").alias("period"))


def runs_of(held: DataFrame) -> DataFrame:
    """Runs of stored records, one row per key and run."""
    short = held.where(F.size("fragments") > 0).select("key", F.inline("fragments"))
    spread = held.where(F.size("tiles") > 0).select("key", F.inline("tiles"))
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(parts, "key", "first", "start")
    return stitched(short.unionByName(spread.mapInArrow(_solved, "key string, q long, s long, e long")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, plain, raw, runs in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                           for c in ("doc_id", "plain", "words", "runs")), strict=True):
            runs = [(r["start"], r["length"], r["period"]) for r in runs or ()]
            listed = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
            best = (None,) * 4
            if runs:
                words = raw.split(b" ")
                dropped = np.zeros(len(words), dtype=bool)
                top = runs[0]
                for s, length, q in runs:
                    dropped[s + q:s + length] = True
                    # Runs come by start and period, so only a greater exponent replaces.
                    if length * top[2] > top[1] * q:
                        top = (s, length, q)
                best = (*top, 1000 * top[1] // top[2])
                plain = hashlib.sha256(b" ".join([w for w, d in zip(words, dropped.tolist(), strict=True) if not d])).hexdigest()
            rows.append((doc, len(runs), *best, listed, plain))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def collapsed(docs: DataFrame, shape: Shape = periodised) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, digests of all runs and of the words without repetitions."""
    held = materialize(records(docs, shape), "periodic-records")
    listed: Column = F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")
    runs = runs_of(held).groupBy("key").agg(listed)
    shown = ["doc_id", "plain", "words"]
    may, cannot = F.col("words").isNotNull(), F.col("words").isNull()
    # Only documents that may have runs meet their runs; the others go straight on.
    met = spread_join(held.where(may).select("key", *shown), runs, "key", "left").select(*shown, "runs")
    none = F.lit(None).cast("array<struct<start: long, period: long, length: long>>")
    rows = met.unionByName(held.where(cannot).select(*shown, none.alias("runs")))
    return rows.mapInArrow(_digests, (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string"))
