"""Quality classifier by gated attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words. Each passage is encoded from its bytes and
words, a gate weighs the encodings, and the weighted sum is scored. Only documents carry
labels; what a passage weighs is learnt from them. The fit runs in one task over a bounded
sample of labelled documents, scoring in every task over whole texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import SPACE, column, columns_of, labelled_sample, map_rows, raw_texts, slices, word_codes, word_spans
from gleaner.session import materialize

PASSAGE_WORDS, BINS = 64, 32


def _classes() -> np.ndarray:
    """Class of a byte: lower and upper case, digit, blank, line end, continuation and lead bytes, marks one by one in 16 classes."""
    out = np.zeros(256, dtype=np.int32)
    for c in range(256):
        ch = chr(c)
        if c >= 0xC0:
            out[c] = 6
        elif c >= 0x80:
            out[c] = 5
        elif ch.isalpha():
            out[c] = 0 if ch.islower() else 1
        elif ch.isdigit():
            out[c] = 2
        elif ch == "\n":
            out[c] = 4
        elif SPACE[c]:
            out[c] = 3
        else:
            out[c] = 7 + c % 17
    return out


CLASSES = _classes()
N_CLASSES = 24
WIDTH = N_CLASSES + 6 + BINS


def encode(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32, WIDTH columns) and the number of passages of each text (one at least)."""
    joined = b" ".join(raws) + b" "
    buffer = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in raws], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts, ends, doc = word_spans(buffer, offsets)
    words = np.bincount(doc, minlength=len(raws))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(passages)])
    n = int(base[-1])
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    inside = np.arange(len(starts)) - first_word[doc]
    passage = base[doc] + inside // PASSAGE_WORDS
    # A passage reaches from its first word to the next one's; the first begins with the text.
    begin = np.repeat(offsets, passages)
    opening = np.flatnonzero((inside % PASSAGE_WORDS == 0) & (inside > 0))
    begin[passage[opening]] = starts[opening]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(begin, len(buffer))))
    counts = np.bincount(of_byte * N_CLASSES + CLASSES[buffer], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    held = np.bincount(passage, minlength=n).astype(np.float32)
    per_word = np.maximum(held, 1)
    codes = word_codes(buffer, starts, ends)
    bins = np.bincount(passage * BINS + (codes >> np.uint64(59)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    again = np.zeros(len(codes), dtype=np.float64)
    if len(codes) > 1:
        again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    lengths = (ends - starts).astype(np.float64)
    features = np.empty((n, WIDTH), dtype=np.float32)
    features[:, :N_CLASSES] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    share = bins / per_word[:, None]
    features[:, N_CLASSES] = np.log1p(held)
    features[:, N_CLASSES + 1] = np.bincount(passage, weights=again, minlength=n) / per_word
    features[:, N_CLASSES + 2] = (share ** 2).sum(axis=1)
    features[:, N_CLASSES + 3] = np.bincount(passage, weights=lengths, minlength=n) / per_word
    features[:, N_CLASSES + 4] = np.sqrt(np.bincount(passage, weights=lengths ** 2, minlength=n) / per_word)
    features[:, N_CLASSES + 5] = np.repeat(np.log1p(words), passages)
    features[:, N_CLASSES + 6:] = share
    return features, passages


class Model:
    """x -> h = tanh(x W + b); weight ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum(weight h) + c0)."""

    NAMES = ("W", "b", "V", "U", "w", "c", "c0")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, values: dict[str, np.ndarray]):
        self.mean, self.scale, self.values = mean, scale, values

    @classmethod
    def fresh(cls, x: np.ndarray, hidden: int, gate: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3, {
            "W": draw(x.shape[1], hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate),
            "w": draw(gate), "c": draw(hidden), "c0": np.zeros(1)})

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        v = self.values
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ v["W"] + v["b"])
        t, s = np.tanh(h @ v["V"]), 1 / (1 + np.exp(-(h @ v["U"])))
        a = (t * s) @ v["w"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, firsts), counts))
        weight = e / np.repeat(np.add.reduceat(e, firsts), counts)
        z = np.add.reduceat(weight[:, None] * h, firsts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ v["c"] + v["c0"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "score": score, "firsts": firsts}

    def gradients(self, run: dict[str, np.ndarray], counts: np.ndarray, labels: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        v = self.values
        error = (run["score"] - labels) / len(labels)
        dz = np.repeat(error[:, None] * v["c"], counts, axis=0)
        through = (dz * run["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(through * run["weight"], run["firsts"]), counts)
        da = run["weight"] * (through - mean)
        gated = run["t"] * run["s"]
        dgate = da[:, None] * v["w"]
        dt = dgate * run["s"] * (1 - run["t"] ** 2)
        ds = dgate * gated * (1 - run["s"])
        dh = dz * run["weight"][:, None] + dt @ v["V"].T + ds @ v["U"].T
        dpre = dh * (1 - run["h"] ** 2)
        out = {"W": run["x"].T @ dpre, "b": dpre.sum(axis=0), "V": run["h"].T @ dt, "U": run["h"].T @ ds, "w": gated.T @ da,
               "c": run["z"].T @ error, "c0": np.array([error.sum()])}
        for name in ("W", "V", "U", "c"):
            out[name] = out[name] + decay * v[name]
        return out

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, mean=self.mean, scale=self.scale, **self.values)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return cls(held["mean"], held["scale"], {n: held[n] for n in cls.NAMES})


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, hidden: int = 24, gate: int = 16, rounds: int = 250,
          rate: float = 0.01, decay: float = 3e-4, seed: int = 7) -> Model:
    """Adam on the whole sample."""
    model = Model.fresh(x, hidden, gate, seed)
    first = {n: np.zeros_like(p) for n, p in model.values.items()}
    second = {n: np.zeros_like(p) for n, p in model.values.items()}
    for step in range(1, rounds + 1):
        grads = model.gradients(model.forward(x, counts), counts, labels, decay)
        for n, g in grads.items():
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            model.values[n] = model.values[n] - rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6000, most_passages: int = 400) -> Model:
    """Train on at most ``rows`` labelled documents of at most ``most_passages`` passages each.

    Both bounds hold for the fit alone. Without any labelled document the model scores all texts 0.5.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, counts = encode(raw_texts(batch))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            keep = np.flatnonzero(counts <= most_passages)
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id").take(pa.array(keep)), column(batch, "label").take(pa.array(keep)),
                pa.array([x[cuts[i]:cuts[i + 1]].tobytes() for i in keep], type=pa.binary())], names=["doc_id", "label", "x"])

    def fit_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)]
        if not held:
            model = Model(np.zeros(WIDTH), np.ones(WIDTH), {
                "W": np.zeros((WIDTH, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "c0": np.zeros(1)})
        else:
            held.sort(key=lambda r: (r[0], r[2]))
            bags = [np.frombuffer(r[2], dtype=np.float32).reshape(-1, WIDTH) for r in held]
            model = train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r[1] for r in held], dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], type=pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, label, rows).mapInArrow(features, "doc_id long, label int, x binary")
    return Model.from_bytes(materialize(sample, "mil-sample").repartition(1).mapInArrow(fit_one, "model binary").first()[0])


def with_quality(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; null text counts as empty.

    Rows stay, repeated ones too, and an empty table stays empty. Columns stay; a column called ``name`` gives way to the score.
    """
    docs = docs.select(*[c for c, n in zip(columns_of(docs), docs.columns, strict=True) if n.lower() != name.lower()])
    held = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    schema = T.StructType(docs.schema.fields + [T.StructField(name, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(held.value)
        for batch in slices(batches, most_bytes=2 << 20):
            x, counts = encode(raw_texts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.forward(x, counts)["score"])], names=[*batch.schema.names, name])

    return map_rows(docs, score, schema)
