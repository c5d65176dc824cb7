"""From raw documents to a training mix: quality, near copies, test items, personal data, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
rereads for the next one. All but the last keep the columns of ``documents``; the last gives the mix, slot by slot. Null texts count as empty in
decisions and stay null in the output; repeated rows are documents of their own; empty tables pass through; further
columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bm25_wand, mixing, order_minhash, pii_feistel, quality_mil
from gleaner.llm.common import columns_of, free_name, ship, table
from gleaner.session import materialize, scratch

#: Key of the pseudonyms. A production run sets its own secret in the session under this name.
PII_KEY_CONF, PII_KEY = "spark.gleaner.pii.key", "gleaner-demonstration-key"
#: Documents that score below are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, trained on the labelled ones among them, does not reject."""
    model = quality_mil.fit(docs, table(ship(spark), sf_dir, "labels"))
    score = free_name(docs, "__quality")
    return quality_mil.with_quality(docs, model, score).where(F.col(score) >= LEAST_QUALITY).select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; texts without words are classes of their own."""
    ship(spark)
    return order_minhash.distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found and verified."""
    return bm25_wand.decontaminate(docs, table(ship(spark), sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced; ``n_chars`` follows a changed text."""
    key = spark.conf.get(PII_KEY_CONF, PII_KEY)
    count = free_name(docs, "__values")
    out = pii_feistel.pseudonymised(docs, key, count=count)
    return out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns_of(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: one row per slot with its words; a document stands in it as often as the mix takes it, or not at all."""
    ship(spark)
    return mixing.ordered(docs, carry=("doc_id", "lang"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pseudonyms", pseudonyms), ("mixture", mixture)]

#: The classifier is fitted and candidates come from sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # A stage's own tables go once its output is written.
        with scratch(spark, keep=f"stage-{name}-"):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
