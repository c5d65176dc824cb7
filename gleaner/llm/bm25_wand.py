"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Items are cut into segments of at most half a passage, so that some passage holds a whole
segment wherever the item begins. A segment is retrieved when the passage's BM25 score
reaches a share of the score that the segment's own words would give. Segments stand in
blocks; a passage's bound on a block is the sum of its rare terms' block maxima, taken for
all passages of a slice at once, and only blocks whose bound reaches what common terms
cannot make up are walked, by WAND. Retrieved items are verified on the words around the passage: enough
word trigrams of the item's question and of its answer must stand there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import columns_of, map_rows, slices, texts

TERMS = re.compile(r"\w+")
ANSWER = re.compile(r"\banswer\s*:", re.IGNORECASE)
K1, B = 1.2, 0.75
STRIDE, BLOCK = 32, 8
#: Share of a segment's need that its common terms may make up.
COMMON = 0.3
GRAM = 3

FIELDS = [T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.LongType())),
          T.StructField("best_score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()),
          T.StructField("answer_overlap", T.DoubleType()), T.StructField("n_passages", T.LongType())]


def terms_of(text: str) -> list[str]:
    return TERMS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's two parts: at an "Answer:" mark, else after the last question mark, else two halves by words."""
    mark = ANSWER.search(text)
    cut = (mark.start(), mark.end()) if mark else (text.rfind("?") + 1,) * 2
    first, second = terms_of(text[:cut[0]]), terms_of(text[cut[1]:])
    if not first or not second:
        words = first + second
        first, second = words[:len(words) // 2], words[len(words) // 2:]
    return first, second


def grams(words: list[str]) -> set[tuple[str, ...]]:
    """Word trigrams; of fewer words, all of them as one."""
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Segments of the test items with impact-ordered block maxima; built from a bounded group of items."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items, self.parts, self.lengths = [], [], []
        segments: list[list[str]] = []
        owner: list[int] = []
        for item, text in items:
            words = terms_of(text)
            if not words:
                continue
            pieces = -(-len(words) // STRIDE)
            for k in range(pieces):
                segments.append(words[k * len(words) // pieces:(k + 1) * len(words) // pieces])
                owner.append(len(self.items))
            self.items.append(item)
            self.parts.append(tuple(grams(part) for part in question_and_answer(text)))
            self.lengths.append(len(words))
        self.owner = owner
        self.vocabulary: dict[str, int] = {}
        frequency = Counter(w for s in segments for w in set(s))
        mean = sum(map(len, segments)) / max(1, len(segments))
        self.postings: list[list[int]] = []
        self.impacts: list[list[float]] = []
        own = np.zeros(len(segments))
        for number, words in enumerate(segments):
            for w, tf in Counter(words).items():
                t = self.vocabulary.setdefault(w, len(self.vocabulary))
                if t == len(self.postings):
                    self.postings.append([])
                    self.impacts.append([])
                idf = np.log1p((len(segments) - frequency[w] + 0.5) / (frequency[w] + 0.5))
                impact = float(idf * (K1 + 1) * tf / (tf + K1 * (1 - B + B * len(words) / mean)))
                self.postings[t].append(number)
                self.impacts[t].append(impact)
                own[number] += impact
        self.own = own
        self.need = own * share
        self.blocks = -(-len(segments) // BLOCK)
        self.block_need = np.array([self.need[b * BLOCK:(b + 1) * BLOCK].min() for b in range(self.blocks)])
        # The last row of both tables stands for any other word.
        self.block_max = np.zeros((len(self.vocabulary) + 1, self.blocks), dtype=np.float32)
        self.rare_max = np.zeros_like(self.block_max)
        common = self._common_mass(len(segments))
        for t, (numbers, impacts) in enumerate(zip(self.postings, self.impacts, strict=True)):
            for number, impact in zip(numbers, impacts, strict=True):
                b = number // BLOCK
                self.block_max[t, b] = max(self.block_max[t, b], impact)
                if (number, t) not in self.common:
                    self.rare_max[t, b] = max(self.rare_max[t, b], impact)
        self.rare = self.rare_max.any(axis=1)
        rest = self.need - common
        self.rare_need = np.array([rest[b * BLOCK:(b + 1) * BLOCK].min() for b in range(self.blocks)], dtype=np.float32)

    def _common_mass(self, n: int) -> np.ndarray:
        """Mark each segment's terms of least impact, up to half of what it needs, as common; their impact in all.

        A score that reaches the need has at least the rest from the segment's other, rare terms.
        """
        terms: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        for t, (numbers, impacts) in enumerate(zip(self.postings, self.impacts, strict=True)):
            for number, impact in zip(numbers, impacts, strict=True):
                terms[number].append((impact, t))
        self.common: set[tuple[int, int]] = set()
        mass = np.zeros(n)
        for number, held in enumerate(terms):
            for impact, t in sorted(held):
                if mass[number] + impact > COMMON * self.need[number]:
                    break
                mass[number] += impact
                self.common.add((number, t))
        return mass

    def bounds(self, ids: np.ndarray, run_of: np.ndarray, runs: int) -> np.ndarray:
        """For each run of words and block, the sum of the rare terms' block maxima; a term counts once a run."""
        out = np.zeros((runs, self.blocks), dtype=np.float32)
        width = len(self.rare)
        keep = self.rare[ids]
        pairs = np.unique(run_of[keep] * width + ids[keep])
        run, term = pairs // width, (pairs % width).astype(np.int32)
        step = 65536
        for a in range(0, len(pairs), step):
            part = run[a:a + step]
            firsts = np.flatnonzero(np.diff(part, prepend=-1))
            out[part[firsts]] += np.add.reduceat(self.rare_max[term[a:a + step]], firsts, axis=0)
        return out

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Segments of one block that the query's terms bring to their thresholds, by WAND."""
        first, last, least = block * BLOCK, (block + 1) * BLOCK, self.block_need[block]
        lists = []
        for t in terms:
            at = bisect_left(self.postings[t], first)
            if at < len(self.postings[t]) and self.postings[t][at] < last:
                lists.append([self.postings[t][at], float(self.block_max[t, block]), t, at])
        found = []
        while lists:
            lists.sort()
            reached, pivot = 0.0, None
            for entry in lists:
                reached += entry[1]
                if reached >= least - 1e-3:
                    pivot = entry[0]
                    break
            if pivot is None:
                break
            if lists[0][0] == pivot:
                score = sum(self.impacts[e[2]][e[3]] for e in lists if e[0] == pivot)
                if score >= self.need[pivot] - 1e-9:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for e in lists:
                if e[0] < target:
                    e[3] = bisect_left(self.postings[e[2]], target, e[3])
                    e[0] = self.postings[e[2]][e[3]] if e[3] < len(self.postings[e[2]]) else last
            lists = [e for e in lists if e[0] < last]
        return found


def search_texts(index: Index, found_texts: list[str], overlap: float) -> tuple[list[dict], list[int]]:
    """For each text the verified items with (score share, question overlap, answer overlap), and its passages."""
    words = [terms_of(t) for t in found_texts]
    hits: list[dict] = [{} for _ in words]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    halves = -(-counts // STRIDE)
    passages = np.maximum(halves - 1, np.minimum(halves, 1))
    if not index.blocks or not counts.sum():
        return hits, passages.tolist()
    get, other = index.vocabulary.get, len(index.vocabulary)
    ids = np.fromiter(map(get, chain.from_iterable(words), repeat(other)), dtype=np.int32, count=int(counts.sum()))
    begins = np.concatenate([[0], np.cumsum(counts)])
    first_half = np.concatenate([[0], np.cumsum(halves)])
    doc_of = np.repeat(np.arange(len(words)), halves)
    in_doc = np.arange(len(doc_of)) - first_half[doc_of]
    word_doc = np.repeat(np.arange(len(words)), counts)
    half_of = first_half[word_doc] + (np.arange(len(ids)) - begins[word_doc]) // STRIDE
    bound = index.bounds(ids, half_of, len(doc_of))
    paired = bound.copy()
    same = doc_of[1:] == doc_of[:-1]
    paired[:-1][same] += bound[1:][same]
    # A passage is two halves; the last half of a longer text is part of the passage before it.
    alone = (in_doc == halves[doc_of] - 1) & (in_doc > 0)
    near = (paired >= index.rare_need - 1e-3) & ~alone[:, None]
    rows = np.flatnonzero(near.any(axis=1))
    for row in rows.tolist():
        doc = int(doc_of[row])
        start = int(in_doc[row]) * STRIDE
        own = ids[begins[doc] + start:min(begins[doc] + start + 2 * STRIDE, begins[doc + 1])]
        terms = np.unique(own[own < other]).tolist()
        for block in np.flatnonzero(near[row]).tolist():
            for segment, score in index.search(terms, block):
                item = index.owner[segment]
                share = score / index.own[segment]
                known = hits[doc].get(item)
                if known and known[0] >= share and min(known[1:]) >= overlap:
                    continue
                length = index.lengths[item]
                around = grams(words[doc][max(0, start - length):start + 2 * STRIDE + length])
                if index.lengths[item] < 2 * GRAM:  # parts shorter than a trigram are matched as they are
                    around |= {tuple(words[doc][i:i + n]) for n in (1, 2) for i in range(max(0, start - length), start + 2 * STRIDE + length)}
                parts = [len(p & around) / len(p) if p else 1.0 for p in index.parts[item]]
                if known is None or (min(parts), share) > (min(known[1:]), known[0]):
                    hits[doc][item] = (share, *parts)
    verified = [{i: h for i, h in hit.items() if min(h[1:]) >= overlap} for hit in hits]
    return verified, passages.tolist()


def with_contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, overlap: float = 0.6,
                       group_bytes: int = 2 << 20, prefix: str = "") -> DataFrame:
    """``docs`` with FIELDS (under ``prefix``): verified items and how well the best one matches.

    ``share``: of a segment's own score that a passage must reach. ``overlap``: of the trigrams of the
    question and of the answer that must stand around the passage. Null and empty texts have no passage
    and no item; null or empty items match nothing; equal items are all reported; rows are neither added nor
    dropped, and a column with the name of a result gives way to it. The index goes to every task, so items are taken in groups of ``group_bytes`` of text, each group
    a further pass in the same stage; a single item is held whole.
    """
    spark = docs.sparkSession
    names = [prefix + f.name for f in FIELDS]
    made = {n.lower() for n in names}
    docs = docs.select(*[c for c, n in zip(columns_of(docs), docs.columns, strict=True) if n.lower() not in made])
    schema = T.StructType(docs.schema.fields + [T.StructField(n, f.dataType) for n, f in zip(names, FIELDS, strict=True)])
    groups: list[list[tuple[int, str]]] = [[]]
    size = 0
    out = docs
    passes = 0

    def pass_over(frame: DataFrame, group, more: bool) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(group, share))
        return map_rows(frame, lambda batches: _annotate(batches, index.value, names, overlap, more), schema)

    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if size and size + len(text) > group_bytes:
            out = pass_over(out, groups[0], passes > 0)
            passes, groups, size = passes + 1, [[]], 0
        groups[0].append((row["item_id"], text))
        size += len(text)
    return pass_over(out, groups[0], passes > 0)


def _annotate(batches: Iterator[pa.RecordBatch], index: Index, names: list[str], overlap: float, more: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        verified, passages = search_texts(index, texts(batch), overlap)
        rows = []
        for hit, n in zip(verified, passages, strict=True):
            best = max(hit.values(), default=(0.0, 0.0, 0.0))
            rows.append((bool(hit), sorted(index.items[i] for i in hit), *best, n))
        if more:
            before = list(zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True))
            rows = [(a[0] or b[0], sorted([*a[1], *b[1]]), *max(a[2:5], b[2:5]), b[5]) for a, b in zip(before, rows, strict=True)]
        kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name not in names]
        types = [pa.bool_(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        made = [(n, pa.array([r[k] for r in rows], type=kind)) for k, (n, kind) in enumerate(zip(names, types, strict=True))]
        yield pa.RecordBatch.from_arrays([c for _, c in kept + made], names=[n for n, _ in kept + made])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without a verified test item."""
    prefix = "__bm25_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    marked = with_contamination(docs, benchmark, prefix=prefix, **options)
    return marked.where(~F.col(f"{prefix}contaminated")).select(*columns_of(docs))
