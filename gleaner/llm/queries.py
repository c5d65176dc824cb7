"""The operators over the given tables, one registered query each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import (
    bm25_wand, merkle, mixing, order_minhash, periodic_runs, pii_feistel, pitman_yor, quality_mil, sorted_projections,
    suffix_dedup, target_resampling, tool_calls, toxic_crf, twins)
from gleaner.llm.common import fold_of, ship, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(ship(spark), sf)
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def rated(scored, cut):
    """The contract's columns of a classifier query."""
    return scored.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


@query("op1_quality_attention")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text_or_empty().alias("text"))
    model = quality_mil.fit(docs, table(spark, sf, "labels"))
    return rated(quality_mil.with_quality(docs, model), 0.3)


@query("op2_feistel_pseudonyms")
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii_feistel.pseudonymised(docs, corpus_pipeline.PII_KEY, count="n_values")


@query("op3_source_mix")
def op3(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("rec.doc_id", "size", "source_size", "target", "taken")


@query("op4_merkle_fingerprints")
def op4(spark, sf):
    return merkle.edited_fingerprints(table(spark, sf, "documents"))


@query("op5_pitman_yor")
def op5(spark, sf):
    return pitman_yor.scored(table(spark, sf, "documents"))


@query("op6_tool_calls")
def op6(spark, sf):
    return tool_calls.linked(table(spark, sf, "conversations"))


@query("op7_toxic_spans")
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text_or_empty().alias("text"))
    return rated(toxic_crf.with_toxicity(docs, toxic_crf.fit(docs, table(spark, sf, "labels"))), 0.5)


@query("op8_suffix_repeats", twins.SUFFIX_REPEATS)
def op8(spark, sf):
    cut = suffix_dedup.without_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_order_minhash")
def op9(spark, sf):
    return order_minhash.near_classes(table(spark, sf, "documents"))


@query("op10_benchmark_bm25")
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bm25_wand.with_contamination(docs, table(spark, sf, "benchmark")).drop("text")


@query("op11_target_resampling", twins.TARGET_RESAMPLING)
def op11(spark, sf):
    return target_resampling.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_periodic_runs", twins.PERIODIC_RUNS)
def op12(spark, sf):
    return periodic_runs.collapsed(table(spark, sf, "documents"))


@query("op13_sorted_projections", twins.SORTED_PROJECTIONS)
def op13(spark, sf):
    return sorted_projections.near_vectors(table(spark, sf, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
