"""Bounded streams: chunk-wise scoring with progress, and ingest without repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleaner.sources.store import ingest

# Keyed state on the executors' disks, with change logs in the checkpoint; the default keeps all keys in the heap.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Session settings of a stateful query while it is started; a query keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000,
             fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream, so many per chunk."""
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_trigger).load(folder))


def score_stream(records: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str,
                 checkpoint: str) -> StreamingQuery:
    """Score every chunk that is waiting and stop; the checkpoint resumes after a loss.

    The scorer must be stateless, such as a fitted model's ``transform``.
    """
    return (scorer(records).writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def first_arrivals(records: DataFrame, id_: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Records whose identifier the stream has not seen before; those without one are left out.

    The identifiers seen are the operator's state, hash-partitioned over the executors. With an event time
    and a delay, an identifier is forgotten once it is older than the delay, which bounds the state; a repeat after
    longer than that counts as new. Of repeats within one chunk any one stays.
    """
    held = records.where(F.col(id_).isNotNull())
    if event_time is None:
        return held.dropDuplicates([id_])
    return held.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_])


def ingest_stream(records: DataFrame, stored: str, id_: str, checkpoint: str, event_time: str | None = None,
                  delay: str | None = None) -> StreamingQuery:
    """Append each identifier's first record to a table that this stream alone writes.

    What is new is told by the state, so no chunk reads the table. State, offsets and the sink's log of
    committed files resume together from the checkpoint: a chunk that is run again adds no row twice.
    """
    with state_settings(records.sparkSession):
        return (first_arrivals(records, id_, event_time, delay).writeStream.format("parquet").outputMode("append")
                .option("path", stored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def store_stream(records: DataFrame, path: str, id_: str, checkpoint: str, overwrite: bool = False,
                 buckets: int | None = None, order: str | Column | None = None) -> StreamingQuery:
    """Chunks into a bucketed store that others write too; each reads the buckets it falls into.

    A chunk that is run again after a failure finds its own rows stored, or replaces them by themselves.
    """
    def store(batch: DataFrame, _: int) -> None:
        ingest(batch, path, id_, overwrite, buckets, order)

    return (records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def progress_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """(chunk, records read) of the chunks a query has reported."""
    return [(p.batchId, p.numInputRows) for p in query.recentProgress]


def state_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """(chunk, keys held) of the chunks of a stateful query."""
    return [(p.batchId, sum(s.numRowsTotal for s in p.stateOperators)) for p in query.recentProgress]
