"""Corpus preparation: normalisers, validity, duplicates, conflicts, samples."""

from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.functions import text as X
from gleaner.operators import columns as N
from gleaner.operators import dedup as D
from gleaner.operators import sampling as M
from gleaner.operators.ordering import ranked
from gleaner.session import materialize
from registry.base import SEED, corpus, query, table, texts

# SQL spelling of the word and blank classes used by the library.
NOT_KEPT = r"[^\p{L}\p{N}_\s\p{Z}-]"


def title_sql(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(translate(regexp_replace(lower({c}), '<[^>]+>', '', 'g'), '–—‐', '---'),"
            f" '{NOT_KEPT}', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))")


@query("normalized_titles", f"""
SELECT page_id, {title_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title_key,
       md5({title_sql('html')}) AS html_key FROM pages""")
def normalized_titles(spark, sf):
    pages = texts(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return pages.select("page_id", X.normalize_title(title).alias("title_key"),
                        F.md5(X.normalize_title(F.col("html"))).alias("html_key"))


@query("normalized_identifiers", """
SELECT page_id, trim(replace(replace(replace(lower(trim(raw)), 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', '')) AS doi,
       nullif(trim(lower(url)), '') AS id_key FROM (
  SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN ' https://doi.org/10.1/' || url WHEN 1 THEN 'HTTP://doi.org/10.1/' || url
                       WHEN 2 THEN 'doi: 10.1/' || url ELSE '10.1/' || url || '  ' END AS raw FROM pages)""")
def normalized_identifiers(spark, sf):
    pages = texts(spark, sf, "pages")
    number = F.col("page_id") % 4
    raw = (F.when(number == 0, F.concat(F.lit(" https://doi.org/10.1/"), "url"))
           .when(number == 1, F.concat(F.lit("HTTP://doi.org/10.1/"), "url"))
           .when(number == 2, F.concat(F.lit("doi: 10.1/"), "url")).otherwise(F.concat(F.lit("10.1/"), "url", F.lit("  "))))
    return pages.select("page_id", X.normalize_doi(raw).alias("doi"), X.id_key(F.col("url")).alias("id_key"))


@query("text_shapes", """
SELECT id, (abstract IS NOT NULL AND trim(abstract) <> '') AND (title IS NOT NULL AND trim(title) <> '') AS valid,
       (coalesce(length(title), 0) + coalesce(length(abstract), 0))::INT AS input_length,
       md5(coalesce('v' || title, 'n') || chr(31) || coalesce('v' || abstract, 'n')) AS signature,
       md5(replace(trim(abstract), chr(10), ' ')) AS one_line, md5(coalesce(title, '') || ' ' || abstract || ' ' || "Keywords") AS joined,
       CASE WHEN regexp_matches(trim(abstract), '[.?!…]["'')\\]]?$') THEN 'kept' ELSE 'closed' END AS ending
FROM corpus""", "corpus")
def text_shapes(spark, sf):
    c = corpus(spark, sf)
    title, abstract = F.col("title"), F.col("abstract")
    closed = X.ensure_terminated(abstract)
    return c.select(
        "id", X.scorable(abstract, title).alias("valid"), X.input_length(title, abstract).alias("input_length"),
        X.content_signature(title, abstract).alias("signature"), F.md5(X.one_line(abstract)).alias("one_line"),
        F.md5(X.joined_input(title, abstract, F.col("Keywords"), True, True)).alias("joined"),
        F.when(closed == X.strip_blank(abstract), "kept").otherwise("closed").alias("ending"))


@query("model_inputs", """
SELECT id, 'title' AS mode, md5(coalesce(title, '')) AS first, md5(abstract) AS second FROM corpus UNION ALL
SELECT id, 'title_keywords', md5(coalesce(title, '') || '[SEP]' || "Keywords"), md5(abstract) FROM corpus UNION ALL
SELECT id, 'keywords', md5(abstract), md5("Keywords") FROM corpus UNION ALL
SELECT id, 'abstract', md5(abstract), NULL FROM corpus""", "corpus")
def model_inputs(spark, sf):
    c = corpus(spark, sf)
    cells = [F.col(n) for n in ("title", "abstract", "Keywords")]
    modes = {"title": (True, False), "title_keywords": (True, True), "keywords": (False, True), "abstract": (False, False)}
    pairs = [F.struct(F.lit(name).alias("mode"), X.paired_input(*cells, *flags).alias("p")) for name, flags in modes.items()]
    rows = c.select("id", F.explode(F.array(*pairs)).alias("x"))
    return rows.select("id", "x.mode", F.md5("x.p.first").alias("first"), F.md5("x.p.second").alias("second"))


FIRST_OF = "row_number() OVER (PARTITION BY {c} ORDER BY priority, id) AS rn"
CASCADE = f"""t0 AS (SELECT * FROM corpus WHERE title IS NOT NULL AND abstract IS NOT NULL AND "Keywords" IS NOT NULL),
t1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {FIRST_OF.format(c='title')} FROM t0) WHERE rn = 1),
t2 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {FIRST_OF.format(c='abstract')} FROM t1) WHERE rn = 1),
t3 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {FIRST_OF.format(c='doi')} FROM t2 WHERE doi IS NOT NULL) WHERE rn = 1)"""


def with_cascade(select: str) -> str:
    from registry.base import CTES
    return f"WITH {CTES['corpus']}, {CASCADE} {select}"


def clean(spark, sf):
    return D.clean_corpus(corpus(spark, sf))


@query("cleaned_corpus", with_cascade("SELECT id, title, doi, labels, md5(abstract) AS abstract_digest FROM t3"))
def cleaned_corpus(spark, sf):
    return clean(spark, sf).select("id", "title", "doi", "labels", F.md5("abstract").alias("abstract_digest"))


def _audit(step, key, before, where=""):
    return f"""SELECT {step} AS step, '{key}' AS key, sum(n)::BIGINT AS rows_in,
    coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS duplicate_rows, sum((k > 1)::INT)::BIGINT AS conflicts, count(*) AS rows_out
    FROM (SELECT {key}, count(*) AS n, count(DISTINCT labels) AS k FROM {before} {where} GROUP BY 1)"""


@query("cascade_audit", with_cascade(" UNION ALL ".join([
    _audit(0, "title", "t0"), _audit(1, "abstract", "t1"), _audit(2, "doi", "t2", "WHERE doi IS NOT NULL")])))
def cascade_audit(spark, sf):
    complete = D.require(corpus(spark, sf), ["title", "abstract", "Keywords", "labels"])
    return D.cascade_audit(complete, "id", "labels")


@query("label_conflicts", """
SELECT title, count(DISTINCT labels) AS n_labels FROM corpus WHERE title IS NOT NULL GROUP BY title
HAVING count(DISTINCT labels) > 1""", "corpus")
def label_conflicts(spark, sf):
    return D.label_conflicts(corpus(spark, sf), "title", "labels")


@query("duplicate_row_counts", """
SELECT key, coalesce(sum(n), 0)::BIGINT AS rows, count(*) AS keys FROM (
  SELECT 'title' AS key, count(*) AS n FROM corpus WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1 UNION ALL
  SELECT 'abstract', count(*) FROM corpus GROUP BY abstract HAVING count(*) > 1) GROUP BY key""", "corpus")
def duplicate_row_counts(spark, sf):
    c = corpus(spark, sf)
    a, b = (D.duplicate_rows(c, k).withColumn("key", F.lit(k)) for k in ("title", "abstract"))
    return a.unionByName(b)


@query("label_encoding", """
SELECT labels, CASE WHEN labels = -1 THEN 0 ELSE labels END AS recoded, labels = -1 AS is_optional,
       dense_rank() OVER (ORDER BY lang) - 1 AS lang_index, lang, count(*) AS n
FROM (SELECT coalesce(l.quality, -1) AS labels, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY labels, lang""")
def label_encoding(spark, sf):
    from pyspark.ml.feature import StringIndexer
    c = corpus(spark, sf).select("labels", F.col("Keywords").alias("lang"))
    indexed = StringIndexer(inputCol="lang", outputCol="i", stringOrderType="alphabetAsc").fit(c).transform(c)
    return (indexed.select("labels", L.recode_optional(F.col("labels")).alias("recoded"),
                           (F.col("labels") == -1).alias("is_optional"), F.col("i").cast("bigint").alias("lang_index"), "lang")
            .groupBy("labels", "recoded", "is_optional", "lang_index", "lang").agg(F.count("*").alias("n")))


@query("stacked_sources", """
SELECT title, abstract, "Keywords", doi, labels FROM corpus WHERE labels = 1 UNION ALL
SELECT title, abstract, '', doi, labels FROM corpus WHERE labels = 0 UNION ALL
SELECT title, abstract, NULL, doi, -1 FROM corpus WHERE labels = -1""", "corpus")
def stacked_sources(spark, sf):
    """Three sources with differing columns in one table: positives, negatives without keywords, optional ones."""
    c = corpus(spark, sf)
    names = {"title": "Title", "abstract": "Abstract", "Keywords": "Keywords", "doi": "DOI", "labels": "labels"}
    raw = N.renamed(c, names)
    back = {v: k for k, v in names.items()}
    positives = N.renamed(raw.where("labels = 1"), back)
    negatives = N.renamed(raw.where("labels = 0").withColumn("Keywords", F.lit("")), back)
    optional = c.where("labels = -1").select("title", "abstract", "doi", "labels")
    return N.stacked([positives, negatives, optional])


def position_sql(group: str, where: str = "") -> str:
    return f"row_number() OVER ({group} ORDER BY md5('{SEED}:' || id), id)"


@query("seeded_sample", f"""
SELECT id, source FROM (SELECT doc_id AS id, source, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) AS rn
FROM documents) WHERE rn <= 137""")
def seeded_sample(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return M.sample_exact(docs, 137, "id", SEED)


@query("undersampled_negatives", f"""
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || id), id) AS rn,
  sum(label) OVER () AS p FROM (SELECT o_orderkey AS id, (o_orderpriority = '1-URGENT')::INT AS label FROM orders))
WHERE label = 1 OR rn <= 2 * p""")
def undersampled_negatives(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))
    return M.undersample(orders, "label", "id", 2, SEED)


@query("seeded_shuffle", f"""
SELECT id, position FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) AS position FROM documents)""")
def seeded_shuffle(spark, sf):
    """Positions that the shuffled rows have in their own order: numbers along its sorted partitions."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    shuffled = materialize(M.seeded_shuffle(docs, "id", SEED).select("id", F.monotonically_increasing_id().alias("place")), "shuffled")
    return ranked(shuffled, "place", "id", position="position", descending=False).select("id", "position")


@query("distinct_values", """
SELECT 'lang' AS name, lang AS value FROM documents GROUP BY lang UNION ALL
SELECT 'source', source FROM documents GROUP BY source""")
def distinct_values(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source")
    return docs.unpivot([], ["lang", "source"], "name", "value").distinct()


@query("event_arrivals_json", """
SELECT event_type, count(*) AS n, round(avg((props::JSON->>'k')::DOUBLE), 6) AS mean_k,
       sum((try_cast(CASE WHEN event_id % 5 = 0 THEN '{}' ELSE value::VARCHAR END AS DOUBLE) IS NULL)::INT)::BIGINT AS not_numbers
FROM events GROUP BY event_type""")
def event_arrivals_json(spark, sf):
    """JSON scalars, and cells that are no numbers read as NULL."""
    events = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("{}")).otherwise(F.col("value").cast("string"))
    read = N.lenient_double(events.withColumn("cell", raw), ["cell"])
    return read.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"),
        F.count_if(F.col("cell").isNull()).alias("not_numbers"))
