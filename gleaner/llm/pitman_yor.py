"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

A context is the whole word before (START at a text's start). Every context has a restaurant
whose customers are the words that followed it; all share one parent, whose customers are
their tables; the parent's base is even over the known words and one unknown.

The state of the chain is the number of tables of every cell (context, word), kept from sweep
to sweep. A sweep takes all customers of a cell out and seats them again, drawn from their
joint distribution given all others; cells are dealt into buckets of words, so a bucket holds
its words' customers at the parent. The tables of a context are summed in the bucket that owns
the context as a word, and come back to the buckets that have a cell of it: both ways by
shuffles. Cells are seated side by side, given the totals after the sweep before. Cells of one
customer have one table and take no part.

Texts never travel: each slice of them sends its distinct (word, context) pairs in buckets of
words, and gets back what these pairs, and its words as words and as contexts, have in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import column, fold_of, raw_texts, slice_numbers, slices, text_or_empty, word_codes, word_spans
from gleaner.session import fresh_path

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0)
SLICE_BYTES = 8 << 20
CODED = 1 << 16
KEY = np.dtype([("word", "<u8"), ("context", "<i8")])
#: Customers of a cell that are seated by their joint distribution.
JOINT = 1024
#: Contexts that are sent as a number of two bytes, and the documents they are looked up in; others are sent whole.
COMMON, COMMON_DOCS = 65535, 4000
NONE = np.zeros(0, dtype=np.uint64)


def coded(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all tokens, one end after each text, and the number of tokens of each text."""
    buffer = np.frombuffer(b" ".join(raws).lower() + b" ", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])[:-1]]).astype(np.int64)
    starts, ends, doc = word_spans(buffer, offsets)
    counts = np.bincount(doc, minlength=len(raws)) + 1
    codes = np.full(int(counts.sum()), END)
    # By some words at a time: the codes' working arrays have eight bytes for each byte of text.
    codes[np.arange(len(starts)) + doc] = np.concatenate(
        [word_codes(buffer, starts[i:i + CODED], ends[i:i + CODED]) for i in range(0, max(1, len(starts)), CODED)])
    return codes, counts


def home(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that owns each word."""
    return ((codes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def numbered(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words by bucket, and the number of each token's word; the first word is START, which no token is."""
    words, of = np.unique(codes, return_inverse=True)
    order = np.argsort(home(words, buckets), kind="stable")
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(1, len(words) + 1)
    return np.append(START, words[order]), rank[of]


def cells(of: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs as word * ``words`` + context, from the numbers of all tokens' words; and each token's pair.

    The first pair is START after START, which no token has: the start is asked for as a context only.
    """
    pair = np.zeros(len(of) + 1, dtype=np.int64)
    pair[2:] = of[:-1]
    pair[1 + np.cumsum(counts) - counts] = 0
    pair[1:] += of * words
    pairs, token = np.unique(pair, return_inverse=True)
    return pairs, token[1:]


def pack_keys(keys: np.ndarray, common: np.ndarray = NONE) -> bytes:
    """Pairs in order as their words once, less one the pairs of each word, and the contexts: numbers in ``common``, others whole."""
    first = np.flatnonzero(np.diff(keys["word"], prepend=keys["word"][:1] + np.uint64(1))) if len(keys) else np.zeros(0, dtype=np.int64)
    runs = pack_counts(np.diff(np.append(first, len(keys))) - 1)
    contexts = keys["context"].astype("<i8").view("<u8")
    at = np.searchsorted(common, contexts)
    met = at < len(common)
    met[met] = common[at[met]] == contexts[met]
    return b"".join([np.array([len(first), len(runs), len(keys)], dtype="<u4").tobytes(), keys["word"][first].tobytes(), runs,
                     np.where(met, at, COMMON).astype("<u2").tobytes(), contexts[~met].tobytes()])


def unpack_keys(raw: bytes, common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, and less one the pairs of each word."""
    n, size, pairs = (int(x) for x in np.frombuffer(raw, dtype="<u4", count=3))
    words, runs = np.frombuffer(raw, dtype="<u8", count=n, offset=12), unpack_counts(raw[12 + 8 * n:12 + 8 * n + size])
    number = np.frombuffer(raw, dtype="<u2", count=pairs, offset=12 + 8 * n + size)
    keys = np.empty(pairs, dtype=KEY)
    whole = number == COMMON
    contexts = np.empty(pairs, dtype=np.uint64)
    contexts[~whole], contexts[whole] = common[number[~whole]], np.frombuffer(raw, dtype="<u8", offset=12 + 8 * n + size + 2 * pairs)
    keys["word"], keys["context"] = np.repeat(words, runs + 1), contexts.view(np.int64)
    return keys, runs


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow whole, in order."""
    return np.uint32(len(counts)).tobytes() + np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    counts = np.frombuffer(raw, dtype="u1", count=n, offset=4).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, dtype="<u4", offset=4 + n)
    return counts


def pack_places(places: np.ndarray) -> bytes:
    """Numbers below 2**32 as their low two bytes, then the third ones, then the fourth ones where there are any."""
    parts = places.astype("<u4").view("u1").reshape(-1, 4)
    top = b"" if not parts[:, 3].any() else parts[:, 3].tobytes()
    return np.uint32(len(places)).tobytes() + parts[:, :2].tobytes() + parts[:, 2].tobytes() + top


def unpack_places(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    parts = np.zeros((n, 4), dtype="u1")
    parts[:, :2] = np.frombuffer(raw, dtype="u1", count=2 * n, offset=4).reshape(n, 2)
    parts[:, 2] = np.frombuffer(raw, dtype="u1", count=n, offset=4 + 2 * n)
    if len(raw) > 4 + 3 * n:
        parts[:, 3] = np.frombuffer(raw, dtype="u1", offset=4 + 3 * n)
    return parts.reshape(-1).view("<u4")


def reseat(customers: np.ndarray, others: np.ndarray, chance: np.ndarray | float, discount: float, strength: float,
           rng: np.random.Generator) -> np.ndarray:
    """Tables of cells whose customers are all seated anew, given the ``others`` tables of their restaurants.

    Up to ``JOINT`` customers are drawn at once: t tables have the weight S(n, t) of generalised Stirling numbers, times
    the parent's ``chance`` and strength + discount * (tables before) for each. The rest of a larger cell follows
    in groups of a sixteenth of those seated.
    """
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    chance = np.broadcast_to(np.asarray(chance, dtype=float), customers.shape)
    most = int(customers.max(initial=0))
    n = np.minimum(customers[order], JOINT)
    ways = np.zeros(1)  # logarithms of S(size, 1), ..., S(size, size)
    for size in range(2, min(most, JOINT) + 1):
        old = np.append(np.log(size - 1 - discount * np.arange(1, size)) + ways, -np.inf)
        ways = np.logaddexp(old, np.append(-np.inf, ways))
        low, high = np.searchsorted(n, [size, size + 1])
        step = max(1, (1 << 18) // size)
        for at in range(low, high, step):
            cell = order[at:min(at + step, high)]
            opened = np.log((strength + discount * (others[cell][:, None] + np.arange(size))) * chance[cell][:, None])
            weight = np.cumsum(opened, axis=1) + ways
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            draw = rng.random(len(cell)) * weight[:, -1]
            tables[cell] = np.minimum((weight <= draw[:, None]).sum(axis=1), size - 1) + 1
    seated = JOINT
    large = order[::-1][:int((customers > JOINT).sum())]
    while len(large):
        come = np.minimum(seated // 16, customers[large] - seated)
        new = (strength + discount * (others[large] + tables[large])) * chance[large]
        tables[large] += rng.binomial(come, np.clip(new / (new + seated - discount * tables[large]), 0, 1))
        seated += seated // 16
        large = large[customers[large] > seated]
    return tables


class Totals:
    """What all buckets share: sizes, discounts and strength; and, where one bucket has all cells, the totals of each sweep."""

    def __init__(self, tokens: int, words: int, customers: np.ndarray, discounts: tuple[float, float], strength: float, seed: int):
        self.tokens, self.words, self.customers = tokens, words, customers
        self.discounts, self.strength, self.seed = discounts, strength, seed
        self.sweeps: list[tuple[np.ndarray, int]] = []

    def parent(self, guests: np.ndarray, tables: np.ndarray, sweep: tuple[np.ndarray, int]) -> np.ndarray:
        """The parent's probability of words with ``guests`` customers at ``tables`` tables."""
        held, new = np.maximum(guests - self.discounts[0] * tables, 0), self.strength + self.discounts[0] * sweep[1]
        return (held + new / (self.words + 1)) / (self.strength + sweep[0].sum())

    def predicted(self, held: np.ndarray, rooms: np.ndarray, customers: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probability of cells that hold ``held`` less their discounts, in contexts of ``rooms`` tables and ``customers``."""
        return (held + (self.strength + self.discounts[1] * rooms) * base) / (self.strength + customers)

    def step(self, of: np.ndarray, counts: np.ndarray, tables: np.ndarray, rooms: np.ndarray, lone: np.ndarray, above: np.ndarray,
             sweep: tuple[np.ndarray, int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seat the cells of a bucket again, then its words at the parent: tables of cells, customers and tables at the parent.

        ``lone`` are a word's customers at the parent from other cells, ``rooms`` the tables of each cell's context.
        """
        base = self.parent(lone + np.bincount(of, weights=tables, minlength=len(lone)), above, sweep)
        tables = reseat(counts, rooms - tables, base[of], self.discounts[1], self.strength, rng)
        guests = lone + np.bincount(of, weights=tables, minlength=len(lone)).astype(np.int64)
        return tables, guests, reseat(guests, sweep[1] - above, 1 / (self.words + 1), self.discounts[0], self.strength, rng)

    def replay(self, bucket: int, keys: np.ndarray, counts: np.ndarray):
        """The chain in one bucket of all cells after each sweep: (tables of its cells, its words' customers and tables at the parent)."""
        words, of = np.unique(keys["word"], return_inverse=True)
        tables, lone = np.minimum(counts, 1), np.zeros(len(words), dtype=np.int64)
        guests = np.bincount(of, weights=tables, minlength=len(words)).astype(np.int64)
        out = [(tables, guests, np.minimum(guests, 1))]
        for number, sweep in enumerate(self.sweeps):
            tables, _, above = out[-1]
            out.append(self.step(of, counts, tables, sweep[0][keys["context"]], lone, above, sweep, np.random.default_rng([self.seed, number, bucket])))
        return words, of, out


def _find(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked value stands, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_, asked), max(len(sorted_) - 1, 0))
    return at, sorted_[at] == asked if len(sorted_) else np.zeros(len(asked), dtype=bool)


def _replies(rows: dict, totals: Totals, keep: int) -> pa.Table:
    """log10 of the averaged predictive probability of every asked pair, from one bucket of all cells (slice -1)."""
    own = next(i for i, s in enumerate(rows["slice"]) if s < 0)
    keys, counts = np.frombuffer(rows["keys"][own], dtype=KEY), np.frombuffer(rows["counts"][own], dtype="<i8")
    words, of, states = totals.replay(rows["bucket"][0], keys, counts)
    out = []
    for number, raw in enumerate(rows["keys"]):
        if number == own:
            continue
        asked, _ = unpack_keys(raw)
        at, found = _find(words, asked["word"])
        cell, met = _find(keys, asked)
        chance = np.zeros(len(asked))
        for (tables, guests, above), sweep in list(zip(states[1:], totals.sweeps[1:] + [totals.final], strict=True))[-keep:]:
            base = totals.parent(np.where(found, guests[at], 0), np.where(found, above[at], 0), sweep)
            held = np.where(met, counts[cell] - totals.discounts[1] * tables[cell], 0)
            chance += totals.predicted(held, sweep[0][asked["context"]], totals.customers[asked["context"]], base)
        out.append((rows["slice"][number], np.log10(chance / keep).astype("<f4").tobytes()))
    return pa.table([pa.array([s for s, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], names=["slice", "chance"])


def _common(docs: DataFrame) -> np.ndarray:
    """Frequent words, to send contexts in fewer bytes: taken from some documents, they change no result."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=SLICE_BYTES >> 2):
            words, n = np.unique(coded(raw_texts(batch))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["code", "n"])

    some = docs.sample(min(1.0, COMMON_DOCS / max(1, docs.count())), seed=1).select(text_or_empty().alias("text"))
    counted = some.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "code").limit(COMMON - 1).select("code").toArrow()
    return np.sort(rows["code"].to_numpy().astype(np.int64).view(np.uint64))


def _texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Slices of texts: their distinct words, the number of each token's word, the tokens of each text, identifiers and folds."""
    # By a function of its own, so that a slice's arrays are gone before the next one's are made.
    def one(mine: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, counts = coded(raw_texts(batch))
        words, of = numbered(codes, buckets)
        return pa.RecordBatch.from_arrays([
            pa.array([mine], pa.int64()), *[pa.array([x], pa.binary()) for x in (words.tobytes(), pack_places(of), pack_places(counts))],
            pa.array([column(batch, "doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([column(batch, "held_out").to_pylist()], pa.list_(pa.bool_()))], names=["slice", "words", "tokens", "counts", "ids", "held"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = slice_numbers()
        for batch in slices(batches, most_bytes=SLICE_BYTES, most_rows=1 << 16):
            yield one(next(mine), batch)

    return docs.select("doc_id", text_or_empty().alias("text"), "held_out").mapInArrow(number, TEXTS)


def _sliced(batch: pa.RecordBatch, i: int) -> tuple:
    """A slice with its words, its pairs, the pair of each token and the tokens of each text."""
    row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
    words, of = np.frombuffer(row["words"], dtype="<u8"), unpack_places(row.pop("tokens")).astype(np.int64)
    counts = unpack_places(row["counts"]).astype(np.int64)
    return row, words, *cells(of, counts, len(words)), counts


def _requests(texts: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """A slice's pairs in each bucket with their training counts."""
    def one(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        row, words, pairs, token, counts = _sliced(batch, i)
        seen = np.bincount(token[np.repeat(~np.array(row["held"], dtype=bool), counts)], minlength=len(pairs))
        del token
        cuts = np.searchsorted(pairs, np.searchsorted(home(words, buckets), np.arange(buckets + 1)) * len(words))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = pairs[cuts[b]:cuts[b + 1]]
            keys = np.empty(len(part), dtype=KEY)
            keys["word"], keys["context"] = words[part // len(words)], words[part % len(words)].view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["slice"]], pa.int64()), pa.array([b], pa.int32()), pa.array([pack_keys(keys, common)], pa.binary()),
                pa.array([pack_counts(seen[cuts[b]:cuts[b + 1]])], pa.binary())], names=["slice", "bucket", "keys", "counts"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from one(batch, i)

    return texts.mapInArrow(ask, "slice long, bucket int, keys binary, counts binary")


#: Kinds of rows: a slice's pairs as numbers of the bucket's cells and words; a bucket's cells and words; what a bucket tells
#: the owner of contexts; the owner's list of contexts; tables of contexts, for a bucket or (peer -1) for the owner itself.
ASKED, STATE, TOLD, OWNER, ROOMS = range(5)
TEXTS = "slice long, words binary, tokens binary, counts binary, ids array<long>, held array<boolean>"
ROW = "kind int, bucket int, peer long, data array<binary>, facts array<long>"


def _rows(out: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["kind", "bucket", "peer", "data", "facts"])


def _merged(rows: dict, buckets: int, common: np.ndarray) -> pa.Table:
    """A bucket's training cells from the counts of all slices, what it tells the contexts' owners, and the slices' pairs by number."""
    mine = rows["bucket"][0]
    lists = [unpack_keys(k, common) for k in rows["keys"]]
    keys = np.concatenate([k for k, _ in lists])
    seen = np.concatenate([unpack_counts(c) for c in rows["counts"]])
    order = np.lexsort((keys["context"], keys["word"]))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    at = np.flatnonzero(new)
    group = np.empty(len(keys), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    counts, keys = np.add.reduceat(seen[order], at), keys[order[at]]
    many = counts > 1
    number = np.cumsum(many) - 1
    known = counts > 0
    words = np.unique(keys["word"][known | (keys["word"] == START)])
    of, there = _find(words, keys["word"])
    total = lambda x: np.bincount(of[there], weights=x[there], minlength=len(words)).astype(np.int64)
    cells_of, tokens_of = total(known), total(counts)
    out = []
    first = 0
    for slice_, (pairs, runs) in zip(rows["slice"], lists, strict=True):
        spot = group[first:first + len(pairs)]
        first += len(pairs)
        heads = spot[np.cumsum(runs + 1) - runs - 1]
        out.append((ASKED, mine, slice_, [np.minimum(counts[spot], 2).astype("u1").tobytes(), pack_places(number[spot[many[spot]]]),
                                          pack_places(np.where(there[heads], of[heads] + 1, 0)), pack_counts(runs)], []))
    # Contexts of the cells of two and more customers, by owner; and of all cells, with their number.
    contexts, of_context = np.unique(keys["context"][known].view(np.uint64), return_inverse=True)
    owner = home(contexts, buckets)
    order = np.argsort(owner, kind="stable")
    contexts, owner = contexts[order], owner[order]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    of_context = place[of_context]
    wanted = np.unique(of_context[many[known]])
    cuts, wants = np.searchsorted(owner, np.arange(buckets + 1)), np.searchsorted(owner[wanted], np.arange(buckets + 1))
    number_of = np.bincount(of_context, minlength=len(contexts))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        out.append((TOLD, b, mine, [contexts[cuts[b]:cuts[b + 1]].tobytes(), pack_counts(number_of[cuts[b]:cuts[b + 1]]),
                                    pack_places(wanted[wants[b]:wants[b + 1]] - cuts[b])], []))
    facts = [int(counts.sum()), int((cells_of > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum()), int((cells_of == 1).sum()),
             int((cells_of == 2).sum()), int(cells_of.sum()), int((cells_of > 0).sum())]
    cell = np.searchsorted(wanted, of_context[many[known]])
    lone = cells_of - np.bincount(of[many], minlength=len(words))
    one = np.ones(int(many.sum()), dtype=np.int64)
    out.append((STATE, mine, -1, [words.tobytes(), pack_counts(tokens_of), pack_counts(lone), pack_places(of[many]), pack_places(cell), pack_counts(counts[many]),
                                  pack_counts(one), pack_counts(np.minimum(cells_of, 1))], facts))
    return _rows(out)


def _owned(rows: dict) -> pa.Table:
    """What the owner of contexts keeps of what it was told: cells of each context, and which contexts each bucket wants."""
    own = rows["kind"].index(STATE)
    words = np.frombuffer(rows["data"][own][0], dtype="<u8")
    number, data, peers = np.zeros(len(words), dtype=np.int64), [], []
    for kind, peer, told in zip(rows["kind"], rows["peer"], rows["data"], strict=True):
        if kind == TOLD:
            at = np.searchsorted(words, np.frombuffer(told[0], dtype="<u8"))
            number[at] += unpack_counts(told[1])
            peers.append(peer)
            data.append(pack_places(at[unpack_places(told[2])]))
    return _rows([(OWNER, rows["bucket"][0], -1, [pack_counts(number), *data], peers)])


def _told(rows: dict) -> pa.Table:
    """Tables of contexts, from the tables beyond one of all buckets' cells: for each bucket those it wants, and all for their owner."""
    own = rows["kind"].index(OWNER)
    rooms, lists = unpack_counts(rows["data"][own][0]), dict(zip(rows["facts"][own], rows["data"][own][1:], strict=True))
    for kind, peer, more in zip(rows["kind"], rows["peer"], rows["data"], strict=True):
        if kind == TOLD:
            rooms[unpack_places(lists[peer])] += unpack_counts(more[0])
    mine = rows["bucket"][0]
    return _rows([(ROOMS, mine, -1, [pack_counts(rooms)], [])] + [(ROOMS, b, mine, [pack_counts(rooms[unpack_places(raw)])], []) for b, raw in lists.items()])


def _rooms(rows: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Tables of the contexts a bucket wants, of those it owns, and (owner, wanted) numbers."""
    got = sorted((p, d[0]) for k, p, d in zip(rows["kind"], rows["peer"], rows["data"], strict=True) if k == ROOMS)
    own = next(unpack_counts(d) for p, d in got if p < 0) if got and got[0][0] < 0 else np.zeros(0, dtype=np.int64)
    parts = [(p, unpack_counts(d)) for p, d in got if p >= 0]
    return np.concatenate([np.zeros(0, dtype=np.int64), *[d for _, d in parts]]), own, [(p, len(d)) for p, d in parts]


def _seated(rows: dict, totals: Totals, sweep: tuple[np.ndarray, int], number: int, keep: int) -> pa.Table:
    """A bucket's state after one more sweep, and what it tells the contexts' owners."""
    mine = rows["bucket"][0]
    data = rows["data"][rows["kind"].index(STATE)]
    rooms, own, sizes = _rooms(rows)
    lone, of, cell, counts = unpack_counts(data[2]), unpack_places(data[3]).astype(np.int64), unpack_places(data[4]), unpack_counts(data[5])
    tables, guests, above = totals.step(of, counts, unpack_counts(data[6]), rooms[cell], lone, unpack_counts(data[7]), sweep,
                                        np.random.default_rng([totals.seed, number, mine]))
    more = np.bincount(cell, weights=tables - 1, minlength=len(rooms)).astype(np.int64)
    ends = np.cumsum([n for _, n in sizes]).astype(np.int64)
    out = [(TOLD, b, mine, [pack_counts(more[end - n:end])], []) for (b, n), end in zip(sizes, ends, strict=True)]
    # Tables of cells, of words at the parent, and of contexts before this sweep: the last ones first.
    past = [*data[6:8], pack_counts(own), *data[8:]][:3 * (keep - 1)]
    return _rows([*out, (STATE, mine, -1, [*data[:6], pack_counts(tables), pack_counts(above), *past], [0] * 6 + [int(guests.sum()), int(above.sum())])])


def _answers(rows: dict, totals: Totals, sweeps: list[tuple[np.ndarray, int]]) -> pa.Table:
    """For every slice: its pairs' mean customers less discounts, and its words' training counts, probabilities at the parent and tables as contexts."""
    data = rows["data"][rows["kind"].index(STATE)]
    tokens, lone, of, counts = unpack_counts(data[1]), unpack_counts(data[2]), unpack_places(data[3]), unpack_counts(data[5])
    _, own, _ = _rooms(rows)
    held, base, rooms = np.zeros(len(counts)), [], []
    past = [*data[6:8], pack_counts(own), *data[8:]]
    for sweep, tables, above, room in zip(sweeps, past[::3], past[1::3], past[2::3], strict=True):
        tables, above = unpack_counts(tables), unpack_counts(above)
        held += (counts - totals.discounts[1] * tables) / len(sweeps)
        guests = lone + np.bincount(of, weights=tables, minlength=len(lone))
        base.append(totals.parent(np.append(0, guests), np.append(0, above), sweep))
        rooms.append(np.append(0, unpack_counts(room)))
    tokens = np.append(0, tokens)
    out = []
    for kind, peer, asked in zip(rows["kind"], rows["peer"], rows["data"], strict=True):
        if kind == ASKED:
            word = unpack_places(asked[2])
            out.append((peer, rows["bucket"][0], [asked[0], asked[3], held[unpack_places(asked[1])].astype("<f4").tobytes(), pack_counts(tokens[word])]
                        + [x for b, r in zip(base, rooms, strict=True) for x in (b[word].astype("<f4").tobytes(), pack_counts(r[word]))]))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.binary())))], names=["slice", "bucket", "data"])


def _scores(left: pa.Table, right: pa.Table, totals: Totals) -> pa.Table:
    """A slice's documents, from its tokens' pairs and the buckets' answers."""
    row, answers = left.to_pydict(), right.sort_by("bucket").to_pydict()["data"]
    runs = [unpack_counts(a[1]) for a in answers]
    token, counts = unpack_places(row["pairs"][0]), unpack_places(row["counts"][0]).astype(np.int64)
    customers = np.concatenate([np.frombuffer(a[0], dtype="u1") for a in answers])
    word = np.repeat(np.arange(sum(map(len, runs))), np.concatenate(runs) + 1)
    held = np.array([0, 1 - totals.discounts[1], 0])[customers]
    held[customers == 2] = np.concatenate([np.frombuffer(a[2], dtype="<f4") for a in answers])
    known = np.concatenate([unpack_counts(a[3]) for a in answers])
    word = word[token]
    first = np.cumsum(counts) - counts
    before = np.append(0, word[:-1])
    before[first] = 0
    # Every training token but the ends is the context of one customer, and so is every training text's start.
    follow = known.copy()
    follow[0] = known[word[-1]]
    held, chance = held[token], np.zeros(len(token))
    pairs = range(4, len(answers[0]), 2)
    for i in pairs:
        base, rooms = (np.concatenate([read(a[i + j]) for a in answers]) for j, read in ((0, lambda x: np.frombuffer(x, dtype="<f4")), (1, unpack_counts)))
        chance += totals.predicted(held, rooms[before], follow[before], base[word].astype(np.float64)) / len(pairs)
    n = len(counts)
    total = lambda x: np.add.reduceat(x, first)
    return pa.table({"doc_id": pa.array(row["ids"][0], pa.int64()), "held_out": pa.array(row["held"][0], pa.bool_()),
                     "n_tokens": counts, "n_known": total((known > 0).astype(np.int64)[word]), "train_tokens": np.full(n, totals.tokens),
                     "base_score": total(np.log10((known + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))[word]), "score": total(np.log10(chance))})


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete a query's shuffle files when the query ends: every table here is written once and then read from its files."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class _Tables:
    """Written tables of this run, which are deleted once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, frame: DataFrame, name: str, *folders: str) -> str:
        path = fresh_path(self.spark, name)
        with _shuffles_dropped(self.spark):
            (frame.write.partitionBy(*folders) if folders else frame.write).parquet(path)
        return path

    def read(self, path: str, schema: str, kind: int | None = None) -> DataFrame:
        frame = self.spark.read.schema(schema).parquet(path)
        return frame if kind is None else frame.where(F.col("kind") == kind)

    def drop(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def scored(docs: DataFrame, folds: int = 5, held_fold: int = 1, strength: float = 1.0, sweeps: int = 4, keep: int = 2, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all documents outside ``held_fold`` and scores all. ``keep`` last of ``sweeps`` seatings
    are averaged; discounts follow from the numbers of pairs and words met once and twice. Null and empty texts
    have one token, their end; identifiers may be null or repeat; other columns are ignored; an empty
    table gives no rows. Without training texts every probability is one.
    """
    keep = max(1, min(keep, sweeps))
    spark, tables = docs.sparkSession, _Tables(docs.sparkSession)
    buckets = max(12, 2 * docs.rdd.getNumPartitions())
    texts = tables.read(tables.write(_texts(docs.select("doc_id", "text", (fold_of("doc_id", folds) == held_fold).alias("held_out")), buckets), "hpy-texts"), TEXTS)
    common = _common(docs)
    grouped = lambda frame, answer, schema=ROW: frame.groupBy("bucket").applyInArrow(
        lambda rows: answer(rows.to_pydict()), schema)
    first = tables.write(grouped(_requests(texts, buckets, common), lambda rows: _merged(rows, buckets, common)), "hpy-cells", "kind")
    facts = _facts(tables.read(first, ROW, STATE))
    tokens, words, one, two, lone, twin = facts[:6]
    discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    totals = Totals(tokens, words, np.zeros(0), (discount(lone, twin), discount(one, two)), strength, seed)
    owners = tables.write(grouped(tables.read(first, ROW).where(F.col("kind").isin(STATE, TOLD)), _owned), "hpy-owners")
    owned = tables.read(owners, ROW)
    states, path = [], first
    for number in range(sweeps):
        states.append((np.array([facts[6]]), facts[7]))
        told = owned if path == first else owned.unionByName(tables.read(path, ROW, TOLD))
        both = tables.read(path, ROW, STATE).unionByName(grouped(told, _told))
        step = tables.write(grouped(both, lambda rows, n=number, s=states[-1]: _seated(rows, totals, s, n, keep)), "hpy-sweep", "kind")
        if path != first:
            tables.drop(path)
        path, facts = step, _facts(tables.read(step, ROW, STATE))
    states.append((np.array([facts[6]]), facts[7]))
    rooms = grouped(owned if path == first else owned.unionByName(tables.read(path, ROW, TOLD)), _told).where("peer < 0")
    both = tables.read(first, ROW, ASKED).unionByName(tables.read(path, ROW, STATE)).unionByName(rooms)
    answered = "slice long, bucket int, data array<binary>"
    replies = tables.write(grouped(both, lambda rows: _answers(rows, totals, states[::-1][:keep]), answered), "hpy-replies")
    for done in {first, owners, path}:
        tables.drop(done)

    def one(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        row, _, _, token, _ = _sliced(batch, i)
        return pa.RecordBatch.from_arrays([
            pa.array([row["slice"]], pa.int64()), pa.array([pack_places(token)], pa.binary()), pa.array([row["counts"]], pa.binary()),
            pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["held"]], pa.list_(pa.bool_()))], names=["slice", "pairs", "counts", "ids", "held"])

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch, i)

    texts = texts.mapInArrow(tokens_of, "slice long, pairs binary, counts binary, ids array<long>, held array<boolean>")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("slice").cogroup(tables.read(replies, answered).groupBy("slice")).applyInArrow(
        lambda left, right: _scores(left, right, totals), schema)


def _facts(state: DataFrame) -> list[int]:
    """Sums of the buckets' facts: eight numbers come to the driver."""
    row = state.agg(*[F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(8)]).first()
    return [int(x or 0) for x in row]
