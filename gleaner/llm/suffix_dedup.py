"""Repeated byte strings by blockwise suffix sorting over a difference cover.

Only the first ``LENGTH`` bytes of suffixes matter. Suffixes at the positions of a difference cover (modulo
133) are ranked first, by their 68 bytes: any two equal strings of 200 bytes share, at some common shift,
a pair of cover positions, so a suffix can only repeat where some cover suffix within its 200 bytes has an
equal. The suffixes left are dealt into buckets and sorted one bucket at a time; equal neighbours
repeat. Fingerprints of 64 bits stand for ranks, as only equality is asked. A text that has an
equal text is covered whole, and only the first of the equal texts sends suffixes.

Slices of texts ask buckets, which answer one bit per question.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gleaner.llm.common import answered, column, raw_texts, slice_numbers, slices, text_or_empty
from gleaner.session import fresh_path, materialize

LENGTH, PERIOD = 200, 133
#: A perfect difference set: every remainder modulo 133 is a difference of two of these.
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
assert len({int(a - b) % PERIOD for a in COVER for b in COVER}) == PERIOD
WINDOW = LENGTH - PERIOD + 1
SLICE_BYTES = 4 << 20
LETTERS = np.random.default_rng(8).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Texts:
    """Texts of one slice with prefix sums, from which any window's fingerprint follows."""

    def __init__(self, raws: list[bytes]):
        self.sizes = np.array([len(r) for r in raws], dtype=np.int64)
        self.buffer = np.frombuffer(b"".join(raws), dtype=np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        n = len(self.buffer)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(LETTERS[self.buffer] * _powers(BASE, n), dtype=np.uint64)])
        self.back = _powers(INVERSE, n + 1)

    def windows(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[at + length] - self.sums[at]) * self.back[at])

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """Cover positions of the chosen texts whose window lies within the text."""
        parts = [np.zeros(0, dtype=np.int64)]
        for i in np.flatnonzero(chosen & (self.sizes >= LENGTH)):
            n = int(self.sizes[i])
            at = (np.arange(0, n, PERIOD)[:, None] + COVER).ravel()
            parts.append(at[at + WINDOW <= n] + self.first[i])
        return np.concatenate(parts)

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Mask of the positions of the chosen texts where a string of LENGTH bytes begins."""
        edge = np.zeros(len(self.buffer) + 1, dtype=np.int8)
        for i in np.flatnonzero(chosen & (self.sizes >= LENGTH)):
            edge[self.first[i]] += 1
            edge[self.first[i] + self.sizes[i] - LENGTH + 1] -= 1
        return np.cumsum(edge[:-1]) > 0


def _asked(prints: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct prints by bucket, whether each is met again here, where buckets begin, and each print's place."""
    order = np.argsort(prints)
    ranked = prints[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    distinct = ranked[new]
    again = np.diff(np.append(np.flatnonzero(new), len(ranked))) > 1
    place = np.empty(len(prints), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    # Buckets are ranges of prints, so order by print is order by bucket.
    bucket = ((distinct >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    return distinct, again, np.searchsorted(bucket, np.arange(buckets + 1)), place


def _packed(prints: np.ndarray) -> bytes:
    """Rising prints as steps, byte place by byte place, so that the empty high bytes compress."""
    return np.ascontiguousarray(np.diff(prints, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _questions(mine: int, prints: np.ndarray, buckets: int) -> list[tuple]:
    distinct, again, cuts, _ = _asked(prints, buckets)
    return [(mine, b, _packed(distinct[cuts[b]:cuts[b + 1]]), np.packbits(again[cuts[b]:cuts[b + 1]]).tobytes())
            for b in range(buckets) if cuts[b] < cuts[b + 1]]


ASK = "slice long, bucket int, prints binary, again binary"


def _repeated(rows: dict) -> pa.Table:
    """Per question: one bit whether the print is met anywhere else, one whether this slice is the first to ask."""
    held = [_unpacked(p) for p in rows["prints"]]
    whole = np.concatenate(held)
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    of = np.cumsum(new) - 1
    inside = np.concatenate([np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=len(h)) for a, h in zip(rows["again"], held, strict=True)])
    met = (np.bincount(of) + np.bincount(of, weights=inside[order]) > 1)[of]
    answer, first = np.empty(len(whole), dtype=bool), np.empty(len(whole), dtype=bool)
    answer[order], first[order] = met, new
    cuts = np.cumsum([len(h) for h in held])[:-1]
    pack = lambda x: [np.packbits(p).tobytes() for p in np.split(x, cuts)]
    return pa.table([pa.array(rows["slice"], pa.int64()), pa.array(rows["bucket"], pa.int32()), pa.array(pack(answer), pa.binary()), pa.array(pack(first), pa.binary())],
                    names=["slice", "bucket", "met", "first"])


def _heard(right: pa.Table, prints: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Answers for each print: met elsewhere, and asked by this slice first."""
    distinct, _, cuts, place = _asked(prints, buckets)
    met, first = np.zeros(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=bool)
    rows = right.to_pydict()
    for b, m, f in zip(rows["bucket"], rows["met"], rows["first"], strict=True):
        n = cuts[b + 1] - cuts[b]
        met[cuts[b]:cuts[b + 1]] = np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n)
        first[cuts[b]:cuts[b + 1]] = np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=n)
    return met[place], first[place]


def _digests(raws: list[bytes]) -> np.ndarray:
    """A print of each whole text of LENGTH bytes or more, 0 of shorter ones."""
    return np.array([int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little") if len(r) >= LENGTH else 0 for r in raws], dtype=np.uint64)


def _leading(digests: np.ndarray) -> np.ndarray:
    """True for the first text of each digest within the slice; texts too short are out."""
    out = np.zeros(len(digests), dtype=bool)
    out[np.unique(digests, return_index=True)[1]] = True
    return out & (digests != 0)


def _suffixes(texts: Texts, lead: np.ndarray, met: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of texts in ``lead`` whose string of LENGTH bytes holds a cover window (at ``at``) that is met elsewhere."""
    edge = np.zeros(len(texts.buffer) + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(at[met] + WINDOW - LENGTH, 0), 1)
    np.add.at(edge, at[met] + 1, -1)
    return np.flatnonzero(texts.starts(lead) & (np.cumsum(edge[:-1]) > 0))


def _sliced(docs: DataFrame, buckets: int):
    """Kind 0: slices of texts. Kind 1: their cover windows. Kind 2: their texts' digests."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = slice_numbers()
        for batch in slices(batches, most_bytes=SLICE_BYTES, most_rows=1 << 15):
            mine = next(number)
            raws = raw_texts(batch)
            digests = _digests(raws)
            lead = _leading(digests)
            texts = Texts(raws)
            windows = _questions(mine, texts.windows(texts.covered(lead), WINDOW), buckets)
            wholes = _questions(mine, digests[digests != 0], buckets)
            kinds = [0] + [1] * len(windows) + [2] * len(wholes)
            rows = [(mine, -1, None, None), *windows, *wholes]
            rest = len(rows) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                 pa.array([column(batch, "doc_id").to_pylist()] + [None] * rest, pa.list_(pa.int64())),
                 pa.array([zstandard.compress(b"".join(raws))] + [None] * rest, pa.binary()), pa.array([texts.sizes.tolist()] + [None] * rest, pa.list_(pa.int64()))],
                names=["kind", "slice", "bucket", "prints", "again", "ids", "texts", "sizes"])

    schema = "kind int, slice long, bucket int, prints binary, again binary, ids array<long>, texts binary, sizes array<long>"
    path = fresh_path(docs.sparkSession, "suffix-slices")
    docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (start, end of removed bytes).

    A byte goes when a string of LENGTH bytes over it also starts elsewhere, in the same text or another.
    Null and shorter texts lose nothing; identifiers may be null or repeat, equal rows are texts of their
    own; other columns are ignored; an empty table gives no rows.
    """
    buckets = max(12, 2 * docs.rdd.getNumPartitions())
    held = _sliced(docs, buckets)
    reply = "slice long, bucket int, met binary, first binary"
    # Windows and digests go through buckets of their own kind in one pass.
    first = held.where("kind > 0").selectExpr("slice", f"bucket + (kind - 1) * {buckets} AS bucket", "prints", "again")
    first = materialize(answered(first, _repeated, reply), "suffix-cover")
    texts = held.where("kind = 0").select("slice", "ids", "texts", "sizes")

    def judged(left: pa.Table, right: pa.Table):
        """Texts of the slice, which send suffixes, which are equal to another, and the suffixes to ask for."""
        body, sizes = zstandard.decompress(left.column("texts")[0].as_py()), left.column("sizes")[0].as_py()
        raws = [body[end - n:end] for n, end in zip(sizes, accumulate(sizes), strict=True)]
        digests = _digests(raws)
        lead = _leading(digests)
        whole = Texts(raws)
        at = whole.covered(lead)
        marks = right.column("bucket").to_numpy()
        met, _ = _heard(right.filter(pa.array(marks < buckets)), whole.windows(at, WINDOW), buckets)
        own = right.filter(pa.array((marks >= buckets) & (marks < 2 * buckets)))
        own = own.set_column(1, "bucket", pa.array(own.column("bucket").to_numpy() - buckets, pa.int32()))
        equal, earliest = (np.zeros(len(raws), dtype=bool) for _ in range(2))
        long = digests != 0
        equal[long], earliest[long] = _heard(own, digests[long], buckets)
        sends = lead & earliest
        inside = np.isin(np.searchsorted(whole.first, at, side="right") - 1, np.flatnonzero(sends)) if len(at) else np.zeros(0, dtype=bool)
        return raws, whole, equal, _suffixes(whole, sends, met[inside], at[inside])

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        _, whole, _, at = judged(left, right)
        rows = _questions(left.column("slice")[0].as_py(), whole.windows(at, LENGTH), buckets)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                        names=["slice", "bucket", "prints", "again"])

    second = texts.groupBy("slice").cogroup(first.groupBy("slice")).applyInArrow(ask, ASK)
    second = answered(second, _repeated, reply).selectExpr("slice", f"bucket + 2 * {buckets} AS bucket", "met", "first")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        raws, whole, equal, at = judged(left, right)
        marks = right.column("bucket").to_numpy()
        own = right.filter(pa.array(marks >= 2 * buckets))
        own = own.set_column(1, "bucket", pa.array(own.column("bucket").to_numpy() - 2 * buckets, pa.int32()))
        met, _ = _heard(own, whole.windows(at, LENGTH), buckets)
        edge = np.zeros(len(whole.buffer) + 1, dtype=np.int32)
        hits = at[met]
        edge[hits] += 1
        np.add.at(edge, hits + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, raw in enumerate(raws):
            a = int(whole.first[i])
            mask = np.ones(len(raw), dtype=bool) if equal[i] else gone[a:a + len(raw)]
            turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            kept = whole.buffer[a:a + len(raw)][~mask].tobytes()
            out.append((len(raw), int(mask.sum()), len(turns) // 2, kept, [{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table([pa.array(left.column("ids")[0].as_py(), pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]],
                        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    answers = first.unionByName(second)
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")
