"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words.

A text is cut into sections (after a blank line), paragraphs (after a line break) and
leaves of at most six words that a word ending in punctuation closes. Each cut keeps all
characters. A leaf's digest covers its text, every other node's the digests below it, so
equal roots mean equal texts, and where two trees differ, the branches that differ lead
to the edited leaves. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import text_or_empty

SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)"
LEAF = r"\s*(?:\S*[^\s.!?,;:]\s+){0,5}\S+(?:\s+$)?|\s+"
#: Hex digits of a node kept in a fingerprint: inner nodes, leaves.
INNER, SHORT = 12, 10


def merkle_leaves(text: Column) -> Column:
    """Leaf digests by section and paragraph: array of arrays of arrays."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x.cast("binary")))
    return F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.split(s, PARAGRAPH_END), leaves))


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of ``text``: the root, then each section's and paragraph's node before its leaves.

    Nodes are parted by spaces; a section's begins with S, a paragraph's with P. An empty text has one
    empty paragraph, a null text a null fingerprint.
    """
    kept = df.columns
    df = df.withColumn("__leaves", merkle_leaves(F.col(text)))
    df = df.withColumn("__paragraphs", F.transform("__leaves", lambda s: F.transform(s, _digest)))
    df = df.withColumn("__sections", F.transform("__paragraphs", _digest))
    paragraph = lambda leaves, digest: F.array_join(F.concat(
        F.array(F.concat(F.lit("P"), F.substring(digest, 1, INNER))), F.transform(leaves, lambda x: F.substring(x, 1, SHORT))), " ")
    paragraphs = F.transform(F.arrays_zip(F.col("__leaves").alias("l"), F.col("__paragraphs").alias("p"), F.col("__sections").alias("s")),
                             lambda z: F.concat(F.lit("S"), F.substring(z["s"], 1, INNER), F.lit(" "),
                                                F.array_join(F.zip_with(z["l"], z["p"], paragraph), " ")))
    return df.select(*kept, F.concat_ws(" ", _digest(F.col("__sections")), F.array_join(paragraphs, " ")).alias(name))


def root(fingerprint: Column) -> Column:
    """Equal exactly for equal texts."""
    return F.substring_index(fingerprint, " ", 1)


def _leaves(fingerprint: Column) -> Column:
    nodes = F.split(F.regexp_replace(fingerprint, r"^[^ ]*| [SP][^ ]*", ""), " ")
    return F.array_remove(F.array_distinct(nodes), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two fingerprints have in common, from 0 to 1 (Dice); 1 for equal roots."""
    left, right = _leaves(a), _leaves(b)
    both = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right)
    return F.when(root(a) == root(b), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * both / total)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` whose node is not in ``b``."""
    nodes = lambda f: F.regexp_extract_all(f, F.lit(r"P[0-9a-f]+"), F.lit(0))
    other = nodes(b)
    return F.filter(F.transform(nodes(a), lambda p, i: F.when(~F.array_contains(other, p), i)), lambda i: i.isNotNull())


def _buckets(docs: DataFrame, rows_per_bucket: int, most: int) -> DataFrame:
    """Add ``bucket``, an ordered range of identifiers; null identifiers come last."""
    spark, rows = docs.sparkSession, docs.count()
    n = max(1, min(most, rows // rows_per_bucket))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    docs = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    docs = Bucketizer(splits=splits, inputCol="__key", outputCol="bucket", handleInvalid="keep").transform(docs).drop("__key")
    # As a double the bucket would be normalised in windows and joins, and texts shuffled once more for that.
    return docs.withColumn("bucket", F.col("bucket").cast("int"))


def edited_fingerprints(docs: DataFrame, rows_per_bucket: int = 500, most_buckets: int = 1 << 16) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text replaces the last quarter of a text's code points (rounded down) by as many from
    the start of the next document's, in the order of identifiers, null last, equal identifiers by text; the last
    document is followed by the first. Null text is empty; an empty text's edited text is empty; an
    empty table gives no rows; other columns are ignored; repeated rows give a row each.

    Texts are shuffled once, into ranges of identifiers; only the first document of each range
    goes to the range before.
    """
    docs = _buckets(docs.select("doc_id", text_or_empty().alias("text")), rows_per_bucket, most_buckets)
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    first = docs.withColumn("n", F.row_number().over(order)).where("n = 1")
    first = with_fingerprint(first.select("bucket", F.col("text").alias("first_text")), "first_text", "first_fp")
    ends = docs.select("bucket").distinct()
    every = W.orderBy("bucket")
    ends = ends.select(F.col("bucket").alias("to"), F.coalesce(
        F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("bucket"))
    first = first.withColumnRenamed("bucket", "to").join(ends, "to").drop("to")

    # Fingerprints are made behind the shuffle, so that only texts move.
    marked = with_fingerprint(docs.repartition("bucket"), "text", "fingerprint")
    marked = marked.withColumn("after", F.lead(F.struct("text", "fingerprint")).over(order)).join(first, "bucket", "left")
    following = F.coalesce("after", F.struct(F.col("first_text").alias("text"), F.col("first_fp").alias("fingerprint")))
    marked = marked.select("doc_id", "text", "fingerprint", following.alias("next"), F.length("text").cast("long").alias("n_chars"))
    moved = F.expr("n_chars div 4").cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - moved), F.col("next.text").substr(F.lit(1), moved))
    marked = with_fingerprint(marked.withColumn("edited", edited), "edited", "edited_fingerprint")
    return marked.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"))
