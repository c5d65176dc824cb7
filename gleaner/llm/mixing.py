"""Mixing sources to target weights by a low-discrepancy schedule.

A mix is a sequence of slots. Slot t takes the golden-ratio point u(t); the cumulative
shares of the sources turn the point into a source; the slot's rank among the slots of
its source names one block of that source's shuffled words, wrapping around when the
source repeats. Blocks hold equally many words and may begin or end inside a document.
``ordered`` gives the slots with their words, ``mix`` what they take of each document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import WORD, cell_offsets, column, raw_texts, slices, word_spans
from gleaner.session import materialize

#: Fixed value: 2**32 over the golden ratio, made odd, so that a period of 2**32 slots meets every point once.
GOLDEN = 2654435769
POINTS = 1 << 32
GRID_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """Target of each source: its weight's share of all words, at most ``most_repeats`` times its size.

    ``sizes`` has ``source`` and ``size``. Sources go by code point, null last, and take
    ``weights`` in turn. What a stopped source leaves is reshared by weight; that ends at
    one level for all sources not stopped, found here by ordering sources by the level at
    which they stop. One row per source: source_no, source, source_size, weight, target.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(listed, (F.col("source_no") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * most_repeats)
    by_stop = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    upto, onward = by_stop.rowsBetween(W.unboundedPreceding, -1), by_stop.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(onward))
    per = per.withColumn("free", F.col("cap") / F.col("weight") >= F.col("level"))
    # The first free source's level holds for all; later rows would spread the same rest with rounding.
    per = per.withColumn("level", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(
        F.col("cap") / F.col("weight"), F.col("source_no")))).over(every))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    return per.select("source_no", "source", "source_size", "weight", target.alias("target"))


def golden_point(slot: Column) -> Column:
    """frac(slot / golden ratio) in units of 2**-32, by integers that cannot overflow."""
    low, high = slot.bitwiseAND(F.lit(65535)), F.shiftright(slot.bitwiseAND(F.lit(POINTS - 1)), 16)
    part = F.shiftleft((high * F.lit(GOLDEN)).bitwiseAND(F.lit(POINTS - 1)).bitwiseAND(F.lit(65535)), 16)
    return (part + low * F.lit(GOLDEN)).bitwiseAND(F.lit(POINTS - 1))


def schedule(sources: DataFrame, block_words: int = 64, chunk_bits: int = 10) -> DataFrame:
    """The slots of the mix: slot, source_no, rank, block, words (taken from the block's start).

    ``sources`` is a staged table of ``source_targets``. A source needs as many slots as
    bring its target; slots beyond those are passed over, and the few that the points'
    discrepancy leaves owing close the schedule, source by source. ``slot`` is the order of
    the mix, without repeats. ``words`` is short of the block only in the slot that reaches the target.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.select("source_no", "source_size", blocks.alias("blocks"), wanted.alias("wanted"), whole.alias("whole"))
    plan = plan.withColumn("need", F.col("whole") * F.col("blocks") + F.ceil(
        (F.col("wanted") - F.col("whole") * F.col("source_size")) / block_words).cast("long"))
    n_slots = int(plan.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0])
    upto = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)
    edge = lambda c: F.floor(c.cast("double") * (POINTS / max(n_slots, 1))).cast("long")
    plan = plan.withColumn("__below", F.coalesce(F.sum("need").over(upto), F.lit(0)))
    plan = plan.withColumn("lo", edge(F.col("__below"))).withColumn("hi", edge(F.col("__below") + F.col("need")))
    plan = plan.drop("__below")

    # Points meet sources through a grid of equal cells: an equality join on the cell, then the exact borders.
    shift = 32 - GRID_BITS
    grid = plan.where("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence(
        F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("grid"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    slots = slots.withColumn("grid", F.shiftright("point", shift)).join(grid, "grid")
    slots = slots.where("point >= lo AND point < hi").select(
        "slot", "source_no", F.shiftright("slot", chunk_bits).alias("chunk"), F.lit(1).alias("one"))
    offsets = cell_offsets(slots, ["source_no"], "chunk", "one", "before")
    in_chunk = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("in_chunk", in_chunk).join(offsets, ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("before") + F.col("in_chunk")).alias("rank"))
    drawn = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("drawn"))
    short = plan.join(drawn, "source_no", "left").fillna(0, ["drawn"]).where("drawn < need")
    short = short.withColumn("owed", F.coalesce(F.sum(F.col("need") - F.col("drawn")).over(upto), F.lit(0)))
    owing = short.select("source_no", F.col("owed") - F.col("drawn") + n_slots, F.explode(F.sequence("drawn", F.col("need") - 1)))
    owing = owing.toDF("source_no", "base", "rank").select((F.col("base") + F.col("rank")).alias("slot"), "source_no", "rank")
    slots = ranked.unionByName(owing).join(plan.drop("lo", "hi"), "source_no").where("rank < need")
    slots = slots.withColumn("block", F.expr("rank % blocks")).withColumn("pass", F.expr("rank div blocks"))
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    rest = F.col("wanted") - F.col("pass") * F.col("source_size") - F.col("block") * block_words
    # In the pass that reaches the target ranks past it do not exist, so the rest is positive.
    return slots.select("slot", "source_no", "rank", "block", F.least(length, rest).alias("words"), length.alias("length"))


def _measured(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """Documents with source, size and the seeded key that orders their source."""
    return docs.select(F.monotonically_increasing_id().alias("row"), *more, F.col("source"), n_words(F.col("text")).alias("size"),
                       F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key"))


def _celled(keyed: DataFrame, rows: int) -> DataFrame:
    """Documents with words in cells of the shuffle key, finer the more rows there are."""
    bits = min(20, max(2, (rows // 128).bit_length()))
    return keyed.where("size > 0").withColumn("cell", F.shiftrightunsigned("key", 64 - bits))


def _placed(cells: DataFrame, offsets: DataFrame) -> DataFrame:
    """``cells`` with ``lo``, the place of a document's first word among its source's shuffled words."""
    in_cell = F.coalesce(F.sum("size").over(W.partitionBy("source_no", "cell").orderBy("key", "row").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("in_cell", in_cell).join(offsets, ["source_no", "cell"]).withColumn("lo", F.col("before") + F.col("in_cell"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), block_words: int = 64, most_repeats: int = 3,
        seed: int = 42, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every document with the words that the slots of the mix take from it.

    Returns the ``carry`` columns as struct ``rec``, and size, source_size, target, taken.
    A null text has size 0 and is never taken; null is a source of its own; repeated rows
    are documents of their own; an empty table gives no rows; other columns are ignored.
    Where a document sits in its source is a seeded hash of identifier and text, so reruns agree.
    """
    staged = materialize(_measured(docs, seed, F.struct(*[F.col(c) for c in carry]).alias("rec")), "mix-sizes")
    sources = materialize(source_targets(staged, weights, most_repeats), "mix-sources")
    slots = schedule(sources, block_words).select("source_no", "block", "words")
    keyed = by_source(staged, sources)
    cells = _celled(keyed.select("row", "source_no", "size", "key"), staged.count())
    placed = _placed(cells, cell_offsets(cells, ["source_no"], "cell", "size", "before"))
    placed = placed.withColumn("hi", F.col("lo") + F.col("size")).withColumn("block", F.explode(F.sequence(
        F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
    start = F.greatest(F.col("lo") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("hi") - F.col("block") * block_words, F.lit(block_words).cast("long"))
    taken = placed.select("row", "source_no", "block", start.alias("start"), end.alias("end")).join(slots, ["source_no", "block"])
    taken = taken.groupBy("row").agg(F.sum(F.greatest(F.least("end", "words") - F.col("start"), F.lit(0))).alias("taken"))
    out = keyed.join(taken, "row", "left")
    return out.select("rec", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def ordered(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), block_words: int = 64, most_repeats: int = 3,
            seed: int = 42, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The mix itself, one row per slot: slot, source, block, words, pieces.

    Reading by ``slot`` gives the dealt order; passed-over slots leave gaps in its numbers. ``pieces`` are the documents'
    parts of the block in order: the ``carry`` columns, first_word and n_words within the document, and ``text`` from the
    first of these words to the last. Sizes, nulls, repeated rows and seed are as in ``mix``. ``docs`` is read twice, so that no copy of the texts is stored.
    """
    staged = materialize(_measured(docs, seed), "mix-sizes")
    sources = materialize(source_targets(staged, weights, most_repeats), "mix-sources")
    rows = staged.count()
    cells = _celled(by_source(staged, sources).select("row", "source_no", "size", "key"), rows)
    offsets = cell_offsets(cells, ["source_no"], "cell", "size", "before")
    # Rows of one key are equal in identifier and text, so either reading gives the same pieces.
    rec = F.struct(*[F.col(c) for c in carry]).alias("rec")
    texts = _celled(by_source(_measured(docs, seed, rec, F.col("text")), sources).select("row", "rec", "text", "source_no", "size", "key"), rows)
    texts = _placed(texts, offsets).select("rec", "text", "source_no", "lo")

    schema = T.StructType([texts.schema["rec"], T.StructField("source_no", T.LongType()), T.StructField("block", T.LongType()),
                           T.StructField("start", T.LongType()), T.StructField("first_word", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("text", T.StringType())])
    cut = texts.withColumn("source_no", F.col("source_no").cast("long")).mapInArrow(lambda batches: _pieces(batches, block_words), schema)
    whole = cut.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.struct("rec.*", "first_word", "n_words", "text").alias("piece"))), lambda a, b: (a["start"] - b["start"]).cast("int")).alias("pieces"))
    slots = schedule(sources, block_words).withColumn("source_no", F.col("source_no").cast("long"))
    held = slots.join(whole, ["source_no", "block"])

    gap = r"[\x20\x09-\x0D]+"

    def upto(x: Column) -> Column:
        """A piece that reaches past the slot's words, cut there."""
        left = F.least(x["piece"]["n_words"], F.col("words") - x["start"])
        front = F.concat(F.lit(f"^{WORD}(?:{gap}{WORD}){{"), (left - 1).cast("string"), F.lit("}"))
        return x["piece"].withField("n_words", left).withField("text", F.when(left < x["piece"]["n_words"], F.call_function(
            "regexp_extract", x["piece"]["text"], front, F.lit(0))).otherwise(x["piece"]["text"]))

    pieces = F.when(F.col("words") < F.col("length"), F.transform(F.filter("pieces", lambda x: x["start"] < F.col("words")), upto)).otherwise(
        F.transform("pieces", lambda x: x["piece"]))
    names = sources.select(F.col("source_no").cast("long").alias("source_no"), "source")
    return held.select("slot", "source_no", "block", "words", pieces.alias("pieces")).join(
        F.broadcast(names) if names.count() <= 4096 else names, "source_no").select("slot", "source", "block", "words", "pieces")


def _pieces(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Documents cut where a block of their source ends."""
    for batch in slices(batches):
        raws = raw_texts(batch)
        joined = b" ".join(raws) + b" "
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])[:-1]]).astype(np.int64)
        starts, ends, doc = word_spans(np.frombuffer(joined, dtype=np.uint8), offsets)
        if not len(starts):
            continue
        counts = np.bincount(doc, minlength=len(raws))
        inside = np.arange(len(starts)) - (np.cumsum(counts) - counts)[doc]
        place = np.array(column(batch, "lo").to_pylist(), dtype=np.int64)[doc] + inside
        first = np.flatnonzero((inside == 0) | (place % block_words == 0))
        last = np.append(first[1:], len(starts)) - 1
        owner = pa.array(doc[first])
        text = pa.array([joined[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "rec").take(owner), column(batch, "source_no").take(owner), pa.array(place[first] // block_words),
             pa.array(place[first] % block_words), pa.array(inside[first]), pa.array(last - first + 1), text.cast(pa.string())],
            names=["rec", "source_no", "block", "start", "first_word", "n_words", "text"])


def by_source(rows: DataFrame, sources: DataFrame, most_broadcast: int = 4096) -> DataFrame:
    """Rows with their source's number, size and target; null meets null. Broadcast only a table counted to be small."""
    side = sources.withColumnRenamed("source", "__source").select("__source", "source_no", "source_size", "target")
    if sources.count() <= most_broadcast:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
