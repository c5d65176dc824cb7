"""Linkage of labelled pages with ranked documents, and error analysis."""

from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.operators import columns as N
from gleaner.operators import linkage as J
from gleaner.operators.ordering import ranked
from gleaner.operators.scores import ranking_summary
from gleaner.session import materialize
from registry.base import CTES, corpus, predictions, query, table, texts
from registry.corpus import title_sql
from registry.scoring import scored_records

# Pages carry titles of documents; their language tells the two classes apart.
LABELED = """labeled AS (
    SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
           CASE WHEN contains(url, '/en/') THEN 'positive' ELSE 'negative' END AS label FROM pages)"""
RANKED = f"""ranked AS (
    SELECT id, title, score, rank() OVER (ORDER BY score DESC) AS score_rank FROM ensembled WHERE score IS NOT NULL)"""
MATCHED = f"""best AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY score_rank, id) AS rn
    FROM (SELECT *, nullif({title_sql('title')}, '') AS match_key FROM ranked) WHERE match_key IS NOT NULL) WHERE rn = 1),
matched AS (
    SELECT l.page_id, l.label, l.title AS title_labeled, b.match_key, b.id, b.score, b.score_rank
    FROM (SELECT *, nullif({title_sql('title')}, '') AS match_key FROM labeled) l JOIN best b USING (match_key))"""


def with_matched(select):
    return f"WITH {CTES['scored']}, {CTES['ensembled']}, {LABELED}, {RANKED}, {MATCHED} {select}"


def labeled_pages(spark, sf):
    pages = texts(spark, sf, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
                        F.when(F.col("url").contains("/en/"), "positive").otherwise("negative").alias("label"))


def ranked_documents(spark, sf):
    rows = scored_records(spark, sf).where("score is not null").select("id", "title", "score")
    return ranked(materialize(rows, "scored"), "score", "id", rank="score_rank")


def matched(spark, sf):
    documents = ranked_documents(spark, sf)
    rank, score = N.find_rank(documents.columns), N.find_score(documents.columns)
    return J.match_ranked(labeled_pages(spark, sf), documents, "title", "title", rank, score, "id")


@query("labelled_to_ranked_match", with_matched(
    "SELECT page_id, label, title_labeled, match_key, id, round(score, 9) AS score, score_rank FROM matched"))
def labelled_to_ranked_match(spark, sf):
    return matched(spark, sf).select("page_id", "label", "title_labeled", "match_key", "id",
                                     F.round("score", 9).alias("score"), "score_rank")


@query("labelled_to_ranked_doi", f"""
WITH {CTES['scored']}, {CTES['ensembled']}, {RANKED},
best AS (SELECT id // 2 AS n, id, score_rank FROM ranked QUALIFY row_number() OVER (PARTITION BY id // 2 ORDER BY score_rank, id) = 1)
SELECT page_id, '10.1/a' || n AS match_key, id, score_rank FROM (SELECT page_id, page_id * 3 AS n FROM pages WHERE page_id % 4 <> 2) JOIN best USING (n)""")
def labelled_to_ranked_doi(spark, sf):
    """Pages and documents meet on identifiers in several spellings; of documents that share one the best ranked stays."""
    doi = F.concat(F.lit("10.1/A"), (F.col("page_id") * 3).cast("string"))
    kind = F.col("page_id") % 4
    spelt = (F.when(kind == 0, F.concat(F.lit("  HTTPS://DOI.ORG/"), doi)).when(kind == 1, F.concat(F.lit("doi:"), F.lower(doi)))
             .when(kind == 3, F.concat(doi, F.lit(" \n"))))
    pages = table(spark, sf, "pages").select("page_id", spelt.alias("doi"))
    documents = ranked_documents(spark, sf).withColumn("doi", F.concat(F.lit("10.1/a"), F.expr("id div 2").cast("string")))
    out = J.match_ranked(pages, documents, "doi", "doi", "score_rank", None, "id")
    return out.select("page_id", "match_key", "id", "score_rank")


@query("first_values_per_title", f"""
SELECT title, min(CASE WHEN doi IS NOT NULL THEN id END) AS doi_id, arg_min(doi, CASE WHEN doi IS NOT NULL THEN id END) AS doi,
       arg_min("Keywords", id) AS "Keywords" FROM corpus WHERE title IS NOT NULL GROUP BY title""", "corpus")
def first_values_per_title(spark, sf):
    """Parity form of the reduction: the first value of each column that is not NULL."""
    c = corpus(spark, sf).select("title", "doi", "Keywords", "id")
    c = c.withColumn("doi_id", F.when(F.col("doi").isNotNull(), F.col("id")))
    return J.first_values_per_key(c, "title", tie="id").select("title", "doi_id", "doi", "Keywords")


@query("top_rank_share", with_matched("""
SELECT m.label, t.top, sum((m.score_rank <= t.top)::INT)::BIGINT AS hits, count(*) AS n,
       round(100.0::DOUBLE * sum((m.score_rank <= t.top)::INT) / count(*), 9) AS pct
FROM matched m, (VALUES (10), (50), (100), (500), (1000), (5000)) t(top)
WHERE t.top <= (SELECT max(score_rank) FROM matched) GROUP BY m.label, t.top"""))
def top_rank_share(spark, sf):
    out = J.top_rank_share(matched(spark, sf), "label", "score_rank")
    return out.select("label", "top", "hits", "n", F.round("pct", 9).alias("pct"))


@query("best_and_worst_ranked", with_matched("""
SELECT label, side, place::INT AS place, page_id, score_rank, title FROM (
  SELECT label, 'best' AS side, page_id, score_rank,
         CASE WHEN length(title_labeled) > 60 THEN substr(title_labeled, 1, 60) || '...' ELSE title_labeled END AS title,
         row_number() OVER (PARTITION BY label ORDER BY score_rank, page_id) AS place FROM matched UNION ALL
  SELECT label, 'worst', page_id, score_rank,
         CASE WHEN length(title_labeled) > 60 THEN substr(title_labeled, 1, 60) || '...' ELSE title_labeled END,
         row_number() OVER (PARTITION BY label ORDER BY score_rank DESC, page_id) FROM matched) WHERE place <= 5"""))
def best_and_worst_ranked(spark, sf):
    from gleaner.functions.text import shorten
    rows = J.extremes(matched(spark, sf), "label", "score_rank", "page_id")
    title = N.first_available(rows, "Title", "title", "Title_labeled", "title_labeled")
    return rows.select("label", "side", "place", "page_id", "score_rank", shorten(title).alias("title"))


@query("ranking_summary_by_class", with_matched("""
SELECT label, count(score) AS count, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS std, round(min(score), 9) AS min,
       round(max(score), 9) AS max, round(median(score), 9) AS median, sum((score >= 0.9)::INT)::BIGINT AS high_count,
       sum((score >= 0.5 AND score < 0.9)::INT)::BIGINT AS medium_count, sum((score < 0.5)::INT)::BIGINT AS low_count,
       min(score_rank) AS rank_min, max(score_rank) AS rank_max, round(avg(score_rank), 6) AS rank_mean,
       round(median(score_rank), 6) AS rank_median FROM matched GROUP BY label"""))
def ranking_summary_by_class(spark, sf):
    out = ranking_summary(matched(spark, sf), "score", "score_rank", ["label"])
    return out.select("label", "count", "high_count", "medium_count", "low_count", "rank_min", "rank_max",
                      *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max", "median")],
                      *[F.round(c, 6).alias(c) for c in ("rank_mean", "rank_median")])


# Errors carry the title of their document; sources are the corpus cut by origin, DOIs partly missing.
ERRORS = """wrong AS (
    SELECT p.*, CASE WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type,
           split_part(d.text, chr(10), 1) AS title, d.source AS origin
    FROM predictions p JOIN documents d ON d.doc_id = p.id WHERE label <> prediction)"""


def titled_predictions(spark, sf):
    docs = table(spark, sf, "documents")
    titles = docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return predictions(spark, sf).join(titles, "id")


@query("error_table", f"""WITH {CTES['predictions']}, {ERRORS}
SELECT error_type, fold, model, run, added, id, label, prediction, score FROM wrong ORDER BY error_type, fold""")
def error_table(spark, sf):
    errors = J.find_errors(predictions(spark, sf))
    return errors.select("error_type", "fold", "model", "run", "added", "id", "label", "prediction", "score").orderBy(
        "error_type", "fold")


@query("error_rate", """
SELECT count(*) AS predictions, sum((label <> prediction)::INT)::BIGINT AS errors,
       round(100.0::DOUBLE * sum((label <> prediction)::INT) / count(*), 9) AS error_rate_pct FROM predictions""", "predictions")
def error_rate(spark, sf):
    out = J.error_rate(predictions(spark, sf))
    return out.withColumn("error_rate_pct", F.round("error_rate_pct", 9))


@query("errors_by_fold", """
SELECT fold, sum((label = 1 AND prediction = 0)::INT)::BIGINT AS "False Negative",
       sum((label = 0 AND prediction = 1)::INT)::BIGINT AS "False Positive" FROM predictions WHERE label <> prediction GROUP BY fold""",
       "predictions")
def errors_by_fold(spark, sf):
    return J.errors_by_fold(J.find_errors(predictions(spark, sf)))


LISTED = f"""listed AS (SELECT DISTINCT {title_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS k FROM pages)"""


@query("errors_without_listed_titles", f"""WITH {CTES['predictions']}, {ERRORS}, {LISTED}
SELECT model, run, added, id, error_type FROM wrong WHERE {title_sql('title')} NOT IN (SELECT k FROM listed)""")
def errors_without_listed_titles(spark, sf):
    errors = J.find_errors(titled_predictions(spark, sf))
    return J.without_listed_titles(errors, labeled_pages(spark, sf)).select("model", "run", "added", "id", "error_type")


SOURCES = f"""sources AS (
    SELECT CASE labels WHEN -1 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS priority, {title_sql('title')} AS k, id, doi,
           CASE WHEN id % 3 = 0 THEN NULL ELSE md5(abstract) END AS abstract FROM corpus WHERE title IS NOT NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority, k ORDER BY id) AS rn FROM sources) WHERE rn = 1),
dois AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority) AS r FROM firsts WHERE doi IS NOT NULL) WHERE r = 1),
fills AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority) AS r FROM firsts WHERE abstract IS NOT NULL) WHERE r = 1),
filled AS (
    SELECT w.model, w.run, w.added, w.fold, w.id, w.error_type, d.doi,
           CASE WHEN d.doi IS NOT NULL THEN coalesce(d.abstract, f.abstract) END AS abstract,
           CASE d.priority WHEN 0 THEN 'openalex' WHEN 1 THEN 'positives' WHEN 2 THEN 'negatives' END AS source
    FROM wrong w LEFT JOIN dois d ON d.k = {title_sql('w.title')} LEFT JOIN fills f ON f.k = {title_sql('w.title')})"""


def with_filled(select):
    return f"WITH {CTES['corpus']}, {CTES['predictions']}, {ERRORS}, {SOURCES} {select}"


def filled(spark, sf):
    c = corpus(spark, sf).withColumn("abstract", F.when(F.col("id") % 3 != 0, F.md5("abstract")))
    c = materialize(c.select("id", "title", "doi", "labels", "abstract"), "sources")
    sources = [(name, c.where(F.col("labels") == label)) for name, label in
               (("openalex", -1), ("positives", 1), ("negatives", 0))]
    return J.backfill_metadata(J.find_errors(titled_predictions(spark, sf)), sources, "id")


@query("metadata_backfill", with_filled("SELECT * FROM filled"))
def metadata_backfill(spark, sf):
    return filled(spark, sf).select("model", "run", "added", "fold", "id", "error_type", "doi", "abstract", "source")


@query("metadata_completeness", with_filled("""
SELECT error_type, count(*) AS n, count(doi) AS with_doi, round(100.0::DOUBLE * count(doi) / count(*), 9) AS doi_pct,
       count(abstract) AS with_abstract, round(100.0::DOUBLE * count(abstract) / count(*), 9) AS abstract_pct FROM filled GROUP BY 1"""))
def metadata_completeness(spark, sf):
    out = J.completeness(filled(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("doi_pct", "abstract_pct")})


@query("named_models", """
SELECT model AS name, family, domain, short, count(*) AS n FROM (
  SELECT model, CASE WHEN contains(lower(model), 'roberta') THEN 'RoBERTa' WHEN contains(lower(model), 'biomedbert') THEN 'BiomedBERT-A'
                     WHEN contains(lower(model), 'biobert') THEN 'BioBERT' ELSE 'Other' END AS family,
         CASE WHEN contains(lower(model), 'bio') THEN 'In-Domain' ELSE 'Out-of-Domain' END AS domain,
         replace(replace(model, 'BiomedBERT-abs', 'BiomedBERT'), '-ft', '-FT') AS short FROM predictions) GROUP BY ALL""",
       "predictions")
def named_models(spark, sf):
    m = F.col("model")
    return predictions(spark, sf).groupBy(
        m.alias("name"), L.model_family(m).alias("family"), L.model_domain(m).alias("domain"),
        L.compact_model_name(m).alias("short")).agg(F.count("*").alias("n"))


@query("short_names", """
SELECT name, short, count(*) AS n FROM (
  SELECT CASE model WHEN 'roberta-base' THEN 'FacebookAI/roberta-base' WHEN 'biobert-v1' THEN 'dmis-lab/biobert-v1.1'
                    WHEN 'bert-base' THEN 'google-bert/bert-base-uncased' ELSE model END AS name, model AS short FROM predictions) GROUP BY ALL""",
       "predictions")
def short_names(spark, sf):
    """Published names of models in their short form; other names stay."""
    name = (F.when(F.col("model") == "roberta-base", "FacebookAI/roberta-base").when(F.col("model") == "biobert-v1", "dmis-lab/biobert-v1.1")
            .when(F.col("model") == "bert-base", "google-bert/bert-base-uncased").otherwise(F.col("model")))
    return predictions(spark, sf).groupBy(name.alias("name")).agg(F.count("*").alias("n")).select("name", L.short_model_name(F.col("name")).alias("short"), "n")
