"""Word, n-gram and length profiles of the texts."""

from pyspark.sql import functions as F

from gleaner.operators import profile as P
from registry.base import query, texts

# A short list given as the parameter, so that both engines use the same words.
STOP = ["the", "and", "of", "in", "to", "a", "is", "that", "le", "la", "de", "et", "der", "die", "und", "el", "en", "que"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query("top_words_by_language", f"""
SELECT lang, word, n, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM (
    SELECT lang, word, count(*) AS n FROM (
      SELECT lang, unnest(regexp_split_to_array(text, '[\\s\\p{{Z}}]+')) AS word FROM documents)
    WHERE word <> '' AND word NOT IN ({STOP_SQL}) GROUP BY lang, word)) WHERE place <= 15""")
def top_words_by_language(spark, sf):
    return P.top_words(texts(spark, sf, "documents"), "text", ["lang"], STOP, 15)


@query("word_cloud_by_role", f"""
SELECT role, word, n, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS place FROM (
    SELECT role, word, count(*) AS n FROM (
      SELECT role, unnest(regexp_split_to_array(text, '[\\s\\p{{Z}}]+')) AS word FROM conversations)
    WHERE word <> '' AND word NOT IN ({STOP_SQL}) GROUP BY role, word)) WHERE place <= 150""")
def word_cloud_by_role(spark, sf):
    return P.top_words(texts(spark, sf, "conversations"), "text", ["role"], STOP, 150)


@query("top_ngrams_by_language", """
WITH t AS (SELECT lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)
SELECT lang, ngram, n, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, ngram) AS place FROM (
    SELECT lang, ngram, count(*) AS n FROM (
      SELECT lang, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS ngram FROM t)
    GROUP BY lang, ngram)) WHERE place <= 10""")
def top_ngrams_by_language(spark, sf):
    return P.top_ngrams(texts(spark, sf, "documents"), "text", ["lang"], 4, 10)


@query("word_length_histogram", """
SELECT lang, length(word)::INT AS length, count(*) AS n FROM (
  SELECT lang, unnest(regexp_split_to_array(text, '[\\s\\p{Z}]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL""")
def word_length_histogram(spark, sf):
    return P.word_length_counts(texts(spark, sf, "documents"), "text", ["lang"])


@query("longest_sequences", """
SELECT lang, max(k)::INT AS max_words, round(avg(k), 6) AS mean_words FROM (
  SELECT lang, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')) AS k FROM documents) GROUP BY lang""")
def longest_sequences(spark, sf):
    out = P.longest_sequence(texts(spark, sf, "documents"), "text", ["lang"])
    return out.withColumn("mean_words", F.round("mean_words", 6))
