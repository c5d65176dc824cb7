"""Bounded streams over files of the given tables."""

from pyspark.sql import functions as F

from gleaner.functions.ensemble import ensemble_result
from gleaner.session import fresh_path
from gleaner.sources.store import read_store
from gleaner.streaming.scoring import arrivals, ingest_stream, score_stream, store_stream
from registry.base import fold_scores, query, table


@query("streamed_scoring", """
SELECT id, round(score, 9) AS score, (score > 0.5)::INT AS prediction, positive_folds FROM ensembled""", "scored ensembled")
def streamed_scoring(spark, sf):
    """Documents arrive as files, are scored chunk by chunk and appended."""
    inbox, sink, state = (fresh_path(spark, n) for n in ("inbox", "scored", "state"))
    records = fold_scores(spark, sf).select("id", "valid", "scores")
    records.repartition(6, "id").write.parquet(inbox)

    def scorer(df):
        result = F.when(F.col("valid"), ensemble_result(F.col("scores")))
        return df.select("id", result.alias("r")).select(
            "id", F.col("r.ensemble_score").alias("score"), F.col("r.ensemble_prediction").alias("prediction"),
            F.col("r.statistics.positive_folds").alias("positive_folds"))

    query_ = score_stream(arrivals(spark, inbox, records.schema, files_per_trigger=3), scorer, sink, state)
    query_.awaitTermination()
    return spark.read.parquet(sink).withColumn("score", F.round("score", 9))


@query("streamed_ingest", """
SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id""")
def streamed_ingest(spark, sf):
    """Events arrive in four files that share users; the state passes one event of each, and the table is never read."""
    inbox, stored, state = (fresh_path(spark, n) for n in ("inbox", "stored", "state"))
    events = table(spark, sf, "events").select("user_id", "event_id")
    events.repartition(4, "event_id").write.parquet(inbox)
    query_ = ingest_stream(arrivals(spark, inbox, events.schema, files_per_trigger=1), stored, "user_id", state)
    query_.awaitTermination()
    return spark.read.parquet(stored).groupBy("user_id").agg(F.count("*").alias("n"))


@query("streamed_ingest_resumed", """
SELECT user_id, min(half) AS half FROM (
  SELECT user_id, (event_id % 2)::INT AS half FROM events) GROUP BY user_id""")
def streamed_ingest_resumed(spark, sf):
    """Half of the events, then the stream is started again for the other half: its checkpoint remembers the users."""
    inbox, stored, state = (fresh_path(spark, n) for n in ("inbox", "stored", "state"))
    events = table(spark, sf, "events").select("user_id", (F.col("event_id") % 2).cast("int").alias("half"))
    for half in (0, 1):
        events.where(F.col("half") == half).repartition(2, "user_id").write.mode("append").parquet(inbox)
        ingest_stream(arrivals(spark, inbox, events.schema, files_per_trigger=1), stored, "user_id", state).awaitTermination()
    return spark.read.parquet(stored)


@query("streamed_store", """
SELECT user_id, half, value FROM (
  SELECT user_id, (event_id % 2)::INT AS half, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS place
  FROM events) WHERE place = 1""")
def streamed_store(spark, sf):
    """Two chunks into a bucketed store: a later chunk replaces a user's row, and in a chunk the latest event stays."""
    inbox, stored, state = (fresh_path(spark, n) for n in ("inbox", "stored", "state"))
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", (F.col("event_id") % 2).cast("int").alias("half"))
    for half in (0, 1):
        events.where(F.col("half") == half).coalesce(1).write.mode("append").parquet(inbox)
        store_stream(arrivals(spark, inbox, events.schema), stored, "user_id", state, overwrite=True, buckets=8,
                     order=F.struct("ts", "event_id")).awaitTermination()
    return read_store(spark, stored, events.schema).select("user_id", "half", "value")
