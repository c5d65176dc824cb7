"""Toxic spans by a linear-chain conditional random field of two states.

Tokens of the labelled sample are marked from the documents' labels: a token of a toxic
document is toxic where its word is much more common, by documents, among toxic ones. The
field learns from these tokens, from each word, its neighbours and the transitions.
Forward and backward passes give each token's marginal; a document's score is a logistic
function of its marginals, offending offsets are runs of tokens above one half. Chains
are passages of 64 words, so that all chains of a slice are walked together.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import column, labelled_sample, map_rows, raw_texts, slices, word_codes
from gleaner.session import materialize

CHAIN = 64
WORD_BITS, NEAR_BITS = 18, 14
LETTER = np.zeros(256, dtype=bool)
LETTER[[ord("'"), *range(48, 58), *range(97, 123), *range(128, 256)]] = True
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts, ends and document numbers of all words (letters and digits, ASCII in lower case), and text offsets."""
    buffer = np.frombuffer(b" ".join(raws).lower() + b" ", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])[:-1]]).astype(np.int64)
    edge = np.diff(LETTER[buffer].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return word_codes(buffer, starts, ends), starts, ends, np.searchsorted(offsets, starts, side="right") - 1, offsets


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain and step of each token of documents with ``counts`` tokens, and the number of chains."""
    chains = -(-counts // CHAIN)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.cumsum(chains) - chains, counts) + inside // CHAIN, inside % CHAIN, int(chains.sum())


def buckets(codes: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of each token: its word, the word before and the word after (0 at a chain's end)."""
    word = (codes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    near = (codes >> np.uint64(64 - NEAR_BITS)).astype(np.int64)
    before, after = np.zeros_like(near), np.zeros_like(near)
    if len(codes) > 1:
        same = chain[1:] == chain[:-1]
        before[1:], after[:-1] = np.where(same, near[:-1], 0), np.where(same, near[1:], 0)
    return word, before, after


class Field:
    """Weights of the toxic state by feature, transition weights, and the document's logistic function."""

    NAMES = ("bias", "word", "before", "after", "move", "doc")

    def __init__(self, values: dict[str, np.ndarray]):
        self.values = values

    @classmethod
    def empty(cls) -> Field:
        return cls({"bias": np.zeros(1), "word": np.zeros(1 << WORD_BITS), "before": np.zeros(1 << NEAR_BITS),
                    "after": np.zeros(1 << NEAR_BITS), "move": np.zeros((2, 2)), "doc": np.zeros(4)})

    def marginals(self, features, chain, step, chains) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of the toxic state of each token, and expected moves between states."""
        word, before, after = features
        v = self.values
        grid = np.zeros((CHAIN, chains))
        real = np.zeros((CHAIN, chains), dtype=bool)
        emit = np.clip(v["bias"][0] + v["word"][word] + v["before"][before] + v["after"][after], -30, 30)
        grid[step, chain], real[step, chain] = np.exp(emit), True
        move = np.exp(np.clip(v["move"], -8, 8))
        ahead = np.empty((CHAIN, 2, chains))
        a0, a1 = np.ones(chains), grid[0].copy()
        for t in range(CHAIN):
            if t:
                b0 = a0 * move[0, 0] + a1 * move[1, 0]
                b1 = (a0 * move[0, 1] + a1 * move[1, 1]) * grid[t]
                a0, a1 = np.where(real[t], b0, a0), np.where(real[t], b1, a1)
            total = a0 + a1
            a0, a1 = a0 / total, a1 / total
            ahead[t, 0], ahead[t, 1] = a0, a1
        p = np.empty((CHAIN, chains))
        moves = np.zeros((2, 2))
        z0, z1 = np.ones(chains), np.ones(chains)
        for t in range(CHAIN - 1, -1, -1):
            f0, f1 = ahead[t, 0] * z0, ahead[t, 1] * z1
            p[t] = f1 / (f0 + f1)
            if t:
                y0, y1 = z0, z1 * grid[t]
                c0, c1 = ahead[t - 1, 0], ahead[t - 1, 1]
                parts = [c0 * move[0, 0] * y0, c0 * move[0, 1] * y1, c1 * move[1, 0] * y0, c1 * move[1, 1] * y1]
                on = real[t]
                whole = np.where(on, parts[0] + parts[1] + parts[2] + parts[3], np.inf)
                moves += np.array([(x / whole).sum() for x in parts]).reshape(2, 2)
                n0, n1 = move[0, 0] * y0 + move[0, 1] * y1, move[1, 0] * y0 + move[1, 1] * y1
                scale = n0 + n1
                z0, z1 = np.where(on, n0 / scale, z0), np.where(on, n1 / scale, z1)
        return p[step, chain], moves

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez_compressed(held, **self.values)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Field:
        held = np.load(io.BytesIO(data))
        return cls({n: held[n] for n in cls.NAMES})


def summary(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: one, the greatest marginal, log of the expected toxic tokens, and their share."""
    most, mass = np.zeros(n), np.bincount(doc, weights=np.where(p > 0.05, p, 0), minlength=n)
    np.maximum.at(most, doc, p)
    size = np.bincount(doc, minlength=n)
    return np.stack([np.ones(n), most, np.log1p(mass), 10 * mass / np.maximum(size, 1)], axis=1)


def token_labels(codes: np.ndarray, doc: np.ndarray, labels: np.ndarray, least_lift: float = 4.0) -> np.ndarray:
    """1 for tokens of toxic documents whose word is ``least_lift`` times as common, by documents, among toxic ones."""
    pairs = np.unique(np.stack([codes, doc.astype(np.uint64)]), axis=1)
    words, of = np.unique(pairs[0], return_inverse=True)
    bad = labels[pairs[1].astype(np.int64)] > 0
    toxic, clean = np.bincount(of, weights=bad, minlength=len(words)), np.bincount(of, weights=~bad, minlength=len(words))
    n_toxic, n_clean = max(1, int((labels > 0).sum())), max(1, int((labels <= 0).sum()))
    marked = (toxic >= max(3, 0.01 * n_toxic)) & ((toxic + 0.5) / n_toxic > least_lift * (clean + 0.5) / n_clean)
    found = np.isin(codes, words[marked])
    return (found & (labels[doc] > 0)).astype(np.float64)


def train(codes: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 1e-7) -> Field:
    """Adam on the whole sample's conditional likelihood, then the document's logistic function by Newton steps."""
    field = Field.empty()
    if not len(labels):
        return field
    doc = np.repeat(np.arange(len(counts)), counts)
    chain, step, chains = layout(counts)
    if len(codes):
        features = buckets(codes, chain)
        marks = token_labels(codes, doc, labels)
        inner = step > 0
        was = (marks[np.maximum(np.arange(len(marks)) - 1, 0)] * 2 + marks).astype(np.int64)
        seen = np.bincount(was[inner], minlength=4).reshape(2, 2)
        sizes = dict(zip(("word", "before", "after"), (1 << WORD_BITS, 1 << NEAR_BITS, 1 << NEAR_BITS), strict=True))
        first = {n: np.zeros_like(x) for n, x in field.values.items() if n != "doc"}
        second = {n: np.zeros_like(x) for n, x in first.items()}
        field.values["bias"][0] = np.log((marks.sum() + 1) / (len(marks) + 2))
        for turn in range(1, rounds + 1):
            p, moves = field.marginals(features, chain, step, chains)
            error = (p - marks) / len(marks)
            grads = {"bias": np.array([error.sum()]), "move": (moves - seen) / len(marks)}
            for name, at in zip(sizes, features, strict=True):
                grads[name] = np.bincount(at, weights=error, minlength=sizes[name]) + decay * field.values[name] * (1 if name == "word" else 30)
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                field.values[name] = field.values[name] - rate * (first[name] / (1 - 0.9 ** turn)) / (np.sqrt(second[name] / (1 - 0.99 ** turn)) + 1e-9)
        p, _ = field.marginals(features, chain, step, chains)
    else:
        p = np.zeros(0)
    x, c = summary(p, doc, len(counts)), field.values["doc"]
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        c = c - np.linalg.solve(hessian, x.T @ (q - labels) + 0.05 * c)
    field.values["doc"] = c
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 4000, most_words: int = 4000) -> Field:
    """Train on at most ``rows`` labelled documents of at most ``most_words`` words; both bounds hold for the fit alone.

    Null labels and identifiers are left out. Without labelled documents every text scores 0.5.
    """
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, _, _, doc, _ = tokens(raw_texts(batch))
            counts = np.bincount(doc, minlength=batch.num_rows)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            keep = np.flatnonzero(counts <= most_words)
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id").take(pa.array(keep)), column(batch, "label").take(pa.array(keep)),
                pa.array([codes[cuts[i]:cuts[i + 1]].tobytes() for i in keep], type=pa.binary())], names=["doc_id", "label", "x"])

    def fit_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)]
        held.sort(key=lambda r: (r[0], r[2]))
        words = [np.frombuffer(r[2], dtype=np.uint64) for r in held]
        field = train(np.concatenate([np.zeros(0, dtype=np.uint64), *words]), np.array([len(w) for w in words], dtype=np.int64),
                      np.array([r[1] for r in held], dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([field.to_bytes()], type=pa.binary())], names=["field"])

    sample = labelled_sample(docs, labels, label, rows).mapInArrow(coded, "doc_id long, label int, x binary")
    return Field.from_bytes(materialize(sample, "crf-sample").repartition(1).mapInArrow(fit_one, "field binary").first()[0])


def with_toxicity(docs: DataFrame, field: Field, name: str = "score", spans: str | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, and, where ``spans`` names a column, offending offsets.

    Offsets count code points, the end is past the last; a span is a run of words of one document whose
    marginals reach ``least`` and carries their greatest one. Null text counts as empty and has no span. Rows and columns stay; ``name``
    and ``spans`` must not be columns of ``docs`` yet.
    """
    taken = {name, spans} & set(docs.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    held = docs.sparkSession.sparkContext.broadcast(field.to_bytes())
    extra = [T.StructField(name, T.DoubleType())] + ([T.StructField(spans, SPAN)] if spans else [])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field.from_bytes(held.value)
        for batch in slices(batches, most_bytes=2 << 20):
            raws = raw_texts(batch)
            codes, starts, ends, doc, offsets = tokens(raws)
            n = batch.num_rows
            p = np.zeros(0)
            if len(codes):
                chain, step, chains = layout(np.bincount(doc, minlength=n))
                p, _ = own.marginals(buckets(codes, chain), chain, step, chains)
            score = 1 / (1 + np.exp(-np.clip(summary(p, doc, n) @ own.values["doc"], -30, 30)))
            arrays, names = [*batch.columns, pa.array(score)], [*batch.schema.names, name]
            if spans:
                arrays.append(pa.array(offending(raws, starts, ends, doc, offsets, p, least), type=pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_rows(docs, tag, T.StructType(docs.schema.fields + extra))


def offending(raws, starts, ends, doc, offsets, p, least) -> list[list[dict]]:
    """Runs of words whose marginal reaches ``least``, in code points of each text."""
    out: list[list[dict]] = [[] for _ in raws]
    last = -2
    for i in np.flatnonzero(p >= least).tolist():
        d = int(doc[i])
        raw, a, z = raws[d], int(starts[i] - offsets[d]), int(ends[i] - offsets[d])
        end = len(raw[:z].decode("utf-8", "replace"))
        if last == i - 1 and out[d]:
            out[d][-1]["end"], out[d][-1]["marginal"] = end, max(out[d][-1]["marginal"], float(p[i]))
        else:
            out[d].append({"start": len(raw[:a].decode("utf-8", "replace")), "end": end, "marginal": float(p[i])})
        last = i
    return out
