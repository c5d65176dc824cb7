"""Sinks and readers in round trips over the given tables."""

from pyspark.sql import functions as F

from gleaner.functions import labels as L
from gleaner.functions.fulltext import BODY_SCHEMA
from gleaner.operators import agreement as A
from gleaner.operators.scores import ensemble_models
from gleaner.session import fresh_path
from gleaner.sources import readers, sinks, store
from registry.base import corpus, fold_metrics, predictions, query, table, texts
from registry.folds import built, with_folds
from registry.scoring import scored_records


@query("csv_score_input", """
SELECT id::VARCHAR AS id, md5(nullif(abstract, '')) AS abstract, nullif(title, '') AS title,
       title IS NOT NULL AND title <> '' AND trim(abstract) <> '' AS valid_for_scoring FROM (
  SELECT doc_id AS id, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS abstract,
         CASE WHEN doc_id % 13 = 5 THEN '' ELSE regexp_replace(split_part(text, chr(10), 1), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END AS title
  FROM documents)""")
def csv_score_input(spark, sf):
    """Documents exported as CSV with an index column, read back and checked for scoring."""
    path = fresh_path(spark, "csv")
    out = corpus(spark, sf).select(F.col("id").alias("Unnamed: 0"), F.col("id").alias("id"),
                                   F.col("title").alias("Paper Title"), F.col("abstract").alias("ABSTRACT"))
    sinks.write_csv(out, path, "escaped")
    read = readers.read_score_csv(spark, path, "escaped")
    assert "Unnamed: 0" not in read.columns
    return read.select("id", F.md5("abstract").alias("abstract"), "title", "valid_for_scoring")


def json_item():
    """A document as an object, a bare string, a number, or an object with a blank title."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    kind = F.col("doc_id") % 10
    as_object = F.to_json(F.struct(F.col("doc_id").alias("n"), F.col("text").alias("Abstract_Text"), line.alias("Title")))
    blank_title = F.to_json(F.struct(F.col("text").alias("abstract"), F.lit("  ").alias("title")))
    as_string = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("s"))), r'^\{"s":|\}$', "")
    return (F.when(kind == 3, F.lit("12")).when(kind == 5, blank_title).when(kind == 7, as_string).otherwise(as_object))


@query("json_score_input", """
SELECT md5(CASE WHEN doc_id % 10 = 3 THEN NULL ELSE nullif(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), '') END) AS abstract,
       CASE WHEN doc_id % 10 IN (3, 7) OR doc_id % 10 = 5 THEN NULL
            ELSE nullif(trim(split_part(text, chr(10), 1)), '') END AS title,
       doc_id % 10 NOT IN (3, 5) AS valid_for_scoring FROM documents""")
def json_score_input(spark, sf):
    """Objects, bare strings, numbers and blank titles as JSON lines; every item keeps its row."""
    path = fresh_path(spark, "json")
    docs = texts(spark, sf, "documents")
    docs.select(json_item().alias("value")).write.text(path)
    out = readers.read_score_json(spark, path, lines=True)
    return out.select(F.md5("abstract").alias("abstract"), "title", "valid_for_scoring")


@query("json_array_input", """
SELECT md5(CASE WHEN doc_id % 10 = 3 THEN NULL ELSE nullif(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), '') END) AS abstract,
       CASE WHEN doc_id % 10 IN (3, 7) OR doc_id % 10 = 5 THEN NULL
            ELSE nullif(trim(split_part(text, chr(10), 1)), '') END AS title,
       doc_id % 10 NOT IN (3, 5) AS valid_for_scoring, row_number() OVER (PARTITION BY doc_id % 12 ORDER BY doc_id)::INT - 1 AS item FROM documents""")
def json_array_input(spark, sf):
    """The same items as arrays, one array per file, in their order."""
    path = fresh_path(spark, "json-array")
    docs = texts(spark, sf, "documents")
    items = docs.groupBy((F.col("doc_id") % 12).alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", json_item().alias("item")))).alias("items"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]"))
    items.select("file", whole.alias("value")).write.partitionBy("file").text(path)
    out = readers.read_score_json(spark, f"{path}/file=*")
    return out.select(F.md5("abstract").alias("abstract"), "title", "valid_for_scoring", "item")


@query("xml_articles", """
SELECT doc_id::VARCHAR AS "PMID", split_part(text, chr(10), 1) AS title,
       md5(trim(regexp_replace(replace(text, chr(13), ''), '<[^>]+>', '', 'g'), chr(32) || chr(10) || chr(9))) AS text,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '10.1/' || doc_id END AS doi,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || ', ' || source END AS "MESH_terms", 'pubmed' AS source, -1 AS labels
FROM documents""")
def xml_articles(spark, sf):
    """Documents exported in the article form of a citation service, read back as optional negatives."""
    path = fresh_path(spark, "xml")
    docs = texts(spark, sf, "documents")
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    ids = F.array_compact(F.array(
        F.struct(F.lit("x").alias("_VALUE"), F.lit("pii").alias("_EIdType")),
        F.when(F.col("doc_id") % 7 != 0, F.struct(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("_VALUE"),
                                                  F.lit("doi").alias("_EIdType")))))
    mesh = F.when(F.col("doc_id") % 5 != 0, F.struct(F.array(
        F.struct(F.col("lang").alias("DescriptorName")), F.struct(F.col("source").alias("DescriptorName"))).alias("MeshHeading")))
    article = F.struct(line.alias("ArticleTitle"), F.struct(F.array(
        "text", F.lit("second part")).alias("AbstractText")).alias("Abstract"), ids.alias("ELocationID"))
    citation = F.struct(F.col("doc_id").cast("string").alias("PMID"), article.alias("Article"), mesh.alias("MeshHeadingList"))
    docs.select(citation.alias("MedlineCitation")).write.format("xml").option("rowTag", "PubmedArticle").option(
        "rootTag", "PubmedArticleSet").save(path)
    out = readers.optional_negatives(readers.read_articles_xml(spark, path))
    return out.withColumn("text", F.md5("text"))


STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
CLOSED = ("CASE WHEN {0} = '' OR regexp_matches({0}, '[.?!…][\"'')\\]]?$') THEN {0} ELSE {0} || '.' END")


@query("fulltext_flattened", f"""
WITH lines AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}) AS l FROM documents),
parts AS (SELECT doc_id, {CLOSED.format('l[1]')} AS head,
  list_filter(list_transform(range(2, len(l) + 1), lambda i: {{'i': i, 't': {CLOSED.format('l[i]')}}}), lambda s: s.t <> '') AS c FROM lines)
SELECT doc_id::VARCHAR AS doc_id, md5(
  array_to_string(list_filter(list_concat([CASE WHEN doc_id % 3 = 0 THEN 'Box:' ELSE 'Part 1.' END, CASE WHEN head = '' THEN NULL ELSE head END],
    list_transform(list_filter(c, lambda s: s.i % 4 <> 0), lambda s: CASE WHEN s.i % 4 = 1 THEN '- ' || s.t ELSE s.t END)), lambda x: x IS NOT NULL), ' ')
  || ' closing remark.'
  || CASE WHEN len(list_filter(c, lambda s: s.i % 4 = 0)) > 0 THEN chr(10) || chr(10) || 'Footnotes:' || chr(10) ||
     array_to_string(list_transform(list_filter(c, lambda s: s.i % 4 = 0), lambda s: '- ' || s.t), chr(10)) ELSE '' END) AS digest
FROM parts""")
def fulltext_flattened(spark, sf):
    """Documents as nested sections of titles, paragraphs, list items and footnotes, flattened again."""
    path = fresh_path(spark, "fulltext")
    docs = texts(spark, sf, "documents")
    lines = F.split("text", "\n", -1)
    contents = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda t, i: F.struct(
        F.when(i % 4 == 2, "fn").when(i % 4 == 3, "list-item").otherwise("p").alias("tag"), t.alias("text")))
    body = F.struct(F.when(F.col("doc_id") % 3 == 0, " Box ").otherwise("Part 1").alias("label"),
                    F.lit(None).cast("string").alias("caption"), F.get(lines, F.lit(0)).alias("title"), contents.alias("contents"))
    closing = F.struct(F.lit("").alias("label"), F.lit("").alias("caption"), F.lit("Abstract").alias("title"),
                       F.array(F.struct(F.lit("p").alias("tag"), F.lit("closing remark").alias("text"))).alias("contents"))
    sections = F.array(body, closing).cast(BODY_SCHEMA)
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), sections.alias("body_sections")).write.json(path)
    out = readers.read_fulltext_json(spark, path, "doc_id")
    return out.select("doc_id", F.md5("full_text").alias("digest"))


def run_files(spark, sf):
    """Prediction files of all models, losses, folds and amounts of negatives, called after them, read back in one scan."""
    path = fresh_path(spark, "test preds")
    loss = F.when(F.col("run") == 0, "BCE").otherwise("focal")
    title = F.when(F.col("fold") < 3, "_with_title").otherwise("")
    stem = F.concat(F.lit("fold_"), F.col("fold").cast("string"), F.lit("_"), "model", F.lit("_"), loss, title,
                    F.lit("_run-0_opt_neg-"), F.col("added").cast("string"))
    rows = predictions(spark, sf).select(stem.alias("stem"), "label", "prediction", "score", "fold", F.lit(None).cast("string").alias("title"))
    sinks.write_named_csv(rows, path, "stem")
    return readers.read_fold_predictions(spark, f"{path}/fold_*.csv", line_breaks="escaped")


@query("run_names_parsed", """
SELECT fold, model, CASE WHEN run = 0 THEN 'BCE' ELSE 'focal' END AS loss, fold < 3 AS with_title, false AS with_keywords, 0 AS run,
       added AS opt_neg, count(*) AS n, round(avg(score), 9) AS score FROM predictions GROUP BY fold, model, run, added""", "predictions")
def run_names_parsed(spark, sf):
    named = run_files(spark, sf).select("score", readers.run_metadata(F.col("source_file")).alias("m"))
    return named.select("score", "m.fold", "m.model", "m.loss", "m.with_title", "m.with_keywords", "m.run", "m.opt_neg").groupBy(
        "fold", "model", "loss", "with_title", "with_keywords", "run", "opt_neg").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("score"))


@query("available_models", """
SELECT DISTINCT model || '_' || CASE WHEN run = 0 THEN 'BCE' ELSE 'focal' END || CASE WHEN fold < 3 THEN '_with_title' ELSE '' END
       || CASE WHEN added = 500 THEN '' ELSE '_run-0_opt_neg-0' END AS model FROM predictions ORDER BY 1""", "predictions")
def available_models(spark, sf):
    return readers.available_models(run_files(spark, sf))


@query("abbreviated_runs", """
SELECT CASE model WHEN 'roberta-base' THEN 'RoBERTa' WHEN 'biobert-v1' THEN 'BioBERT' WHEN 'bert-base' THEN 'Other' ELSE 'BiomedBERT-A' END
       || CASE WHEN run = 0 THEN ' +BCE' ELSE ' +FL' END || CASE WHEN fold < 3 THEN ' +T' ELSE '' END
       || CASE WHEN added = 500 THEN ' (N500)' ELSE '' END AS label, count(*) AS n FROM predictions GROUP BY 1""", "predictions")
def abbreviated_runs(spark, sf):
    """Short labels of the runs that the files' names stand for."""
    return run_files(spark, sf).groupBy(L.abbreviated_run(F.col("source_file")).alias("label")).agg(F.count("*").alias("n"))


@query("fold_files_pruned", with_folds(
    "SELECT id, labels, is_optional FROM folds WHERE run = 1 AND fold = 2 AND split = 'train'"))
def fold_files_pruned(spark, sf):
    path = fresh_path(spark, "fold-files")
    sinks.write_folds(built(spark, sf), path)
    return sinks.read_fold(spark, path, 1, 2, "train").select("id", "labels", "is_optional")


@query("identifier_lists", with_folds("""
SELECT run::INT AS run, fold::INT AS fold, split, CASE labels WHEN 1 THEN 'pos' ELSE 'neg' END AS label, id::VARCHAR AS value FROM folds"""))
def identifier_lists(spark, sf):
    path = fresh_path(spark, "ids")
    sinks.write_id_lists(built(spark, sf), path, "id", label="labels", cells=["run", "fold"])
    return spark.read.text(path).select("run", "fold", "split", "label", "value")


@query("appended_metrics", """
SELECT model AS model_name, added AS nb_added_negs, fold, run, f1, accuracy FROM fold_metrics""", "predictions cells fold_metrics")
def appended_metrics(spark, sf):
    """Two jobs append to one table; neither rewrites the other's rows."""
    path = fresh_path(spark, "metrics")
    rows = fold_metrics(spark, sf).withColumnsRenamed({"model": "model_name", "added": "nb_added_negs", "mcc": "MCC"})
    for run in (0, 1):
        sinks.append_metrics(rows.where(F.col("run") == run), path)
    return sinks.read_stored_metrics(spark, path).select("model_name", "nb_added_negs", "fold", "run", "f1", "accuracy")


@query("metric_cells_checked", """
SELECT verdict, count(*) AS n, round(sum(f1), 6) AS f1 FROM (
  SELECT CASE WHEN fold = 3 THEN 'quarantined' ELSE 'kept' END AS verdict, CASE WHEN fold = 1 THEN NULL ELSE f1 END AS f1 FROM fold_metrics)
GROUP BY verdict""", "predictions cells fold_metrics")
def metric_cells_checked(spark, sf):
    """Cells such as {} become NULL; rows with a cell of the wrong type are set aside."""
    raw = fold_metrics(spark, sf).select(
        F.col("model").alias("model_name"), F.col("fold").cast("string").alias("fold"),
        F.when(F.col("fold") == 1, "{}").otherwise(F.col("f1").cast("string")).alias("f1"),
        F.when(F.col("fold") == 3, "False.1").otherwise("True").alias("with_title"))
    kept, quarantined = readers.checked_metrics(raw)
    parts = [kept.select(F.lit("kept").alias("verdict"), "f1"),
             quarantined.select(F.lit("quarantined").alias("verdict"), F.col("f1").cast("double").alias("f1"))]
    return parts[0].unionByName(parts[1]).groupBy("verdict").agg(
        F.count("*").alias("n"), F.round(F.sum("f1"), 6).alias("f1"))


@query("scored_json_lines", """
SELECT id, round(score, 9) AS score, positive_folds, CASE WHEN valid THEN round(s0 + 2 * s4, 9) END AS mixed
FROM ensembled JOIN (SELECT id, s0, s4 FROM scored) USING (id)""", "scored ensembled")
def scored_json_lines(spark, sf):
    path = fresh_path(spark, "scored-json")
    rows = scored_records(spark, sf).select("id", "score", "positive_folds", "fold_scores")
    sinks.write_scored(rows, path, "json")
    back = spark.read.schema("id bigint, score double, positive_folds int, fold_scores array<double>").json(path)
    mixed = F.get("fold_scores", F.lit(0)) + 2 * F.get("fold_scores", F.lit(4))
    return back.select("id", F.round("score", 9).alias("score"), "positive_folds", F.round(mixed, 9).alias("mixed"))


@query("scored_csv", """
SELECT id, title, md5(abstract) AS abstract, round(score, 9) AS score, positive_folds, CASE WHEN valid THEN round(s0 + 2 * s4, 9) END AS mixed
FROM ensembled JOIN (SELECT id, s0, s4 FROM scored) USING (id)""", "scored ensembled")
def scored_csv(spark, sf):
    """Whole records with nested scores as CSV, fields with quotes and line breaks included."""
    path = fresh_path(spark, "scored-csv")
    rows = scored_records(spark, sf).select("id", "title", "abstract", "score", "positive_folds", "fold_scores")
    sinks.write_scored(rows, path, "csv", "escaped")
    back = readers.read_csv(spark, path, "id bigint, title string, abstract string, score double, positive_folds int, fold_scores string", "escaped")
    scores = F.from_json("fold_scores", "array<double>")
    return back.select("id", "title", F.md5("abstract").alias("abstract"), F.round("score", 9).alias("score"), "positive_folds",
                       F.round(F.get(scores, F.lit(0)) + 2 * F.get(scores, F.lit(4)), 9).alias("mixed"))


@query("ensemble_prediction_files", """
SELECT model_name, added, fold, count(*) AS n, sum(prediction)::BIGINT AS positive FROM (
  SELECT 'Ensemble' AS model_name, added, fold, id, (avg(score) > 0.5)::INT AS prediction FROM predictions
  GROUP BY added, run, fold, id) GROUP BY ALL""", "predictions")
def ensemble_prediction_files(spark, sf):
    out = ensemble_models(predictions(spark, sf), ["added", "run", "fold", "id"], 5).withColumn("model_name", F.lit("Ensemble"))
    return out.groupBy("model_name", "added", "fold").agg(F.count("*").alias("n"), F.sum("prediction").alias("positive"))


@query("incremental_ingest", """
SELECT (l_orderkey % 10)::INT AS bucket, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) AS ids FROM lineitem GROUP BY 1""")
def incremental_ingest(spark, sf):
    """Order lines arrive in two overlapping waves; each order is stored once."""
    path = fresh_path(spark, "ingest")
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 10).cast("int").alias("bucket"), "l_linenumber")
    for wave in (lines.where("l_linenumber <= 3"), lines):
        store.ingest(wave.select("l_orderkey", "bucket"), path, "l_orderkey", buckets=16)
    return store.read_store(spark, path).groupBy("bucket").agg(
        F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("ids"))


@query("replacing_ingest", """
SELECT l_orderkey, l_linenumber, l_quantity, wave FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY wave DESC, l_linenumber DESC, l_quantity DESC) AS place FROM (
    SELECT l_orderkey, l_linenumber, l_quantity, ((l_orderkey + l_linenumber) % 3)::INT AS wave FROM lineitem)) WHERE place = 1""")
def replacing_ingest(spark, sf):
    """Order lines arrive in three waves; a later wave replaces an order's line, and in a wave the last line stays."""
    path = fresh_path(spark, "replaced")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int").alias("wave"))
    for number in range(3):
        store.ingest(lines.where(F.col("wave") == number), path, "l_orderkey", overwrite=True, buckets=16,
                     order=F.struct("l_linenumber", "l_quantity"))
    return store.read_store(spark, path, lines.schema)


@query("first_stored_lines", """
SELECT l_orderkey, l_linenumber, wave FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY wave, l_linenumber) AS place FROM (
    SELECT l_orderkey, l_linenumber, ((l_orderkey + l_linenumber) % 3)::INT AS wave FROM lineitem)) WHERE place = 1""")
def first_stored_lines(spark, sf):
    """The same waves where what is stored stays, and in a wave the first line counts."""
    path = fresh_path(spark, "first")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int").alias("wave"))
    for number in range(3):
        store.ingest(lines.where(F.col("wave") == number), path, "l_orderkey", buckets=16, order="l_linenumber")
    return store.read_store(spark, path, lines.schema)


@query("screening_labels", """
SELECT screened_in, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM (
  SELECT d.doc_id, coalesce(l.quality = 1 OR l.toxic = 1, false) AS screened_in FROM documents d LEFT JOIN labels l USING (doc_id))
GROUP BY screened_in""")
def screening_labels(spark, sf):
    """A sheet in which a document counts as included once any rater wrote anything."""
    docs = table(spark, sf, "documents").select("doc_id")
    sheet = docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, "yes").otherwise("nan").alias("Comment: first"),
        F.when(F.col("toxic") == 1, " x ").otherwise("  ").alias("Comment: second"))
    out = A.screening_labels(sheet, ["Comment: first", "Comment: second", "Comment: absent"])
    return out.groupBy("screened_in").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query("fold_prediction_scan", """
SELECT fold, count(*) AS n, sum(label)::BIGINT AS positives, sum(prediction)::BIGINT AS called, round(sum(score), 6) AS score,
       0::BIGINT AS unnamed FROM predictions GROUP BY fold""", "predictions")
def fold_prediction_scan(spark, sf):
    """Exported prediction files of one folder, with an index column, in one scan that keeps each row's file."""
    path = fresh_path(spark, "test preds")
    rows = predictions(spark, sf).select(F.col("id").alias("Unnamed: 0"), "label", "prediction", "score", "fold",
                                         F.lit(None).cast("string").alias("title"))
    sinks.write_csv(rows, path, "escaped")
    read = readers.read_fold_predictions(spark, f"{path}/*.csv", line_breaks="escaped")
    return read.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum("prediction").alias("called"),
        F.round(F.sum("score"), 6).alias("score"), F.count_if(~F.col("source_file").startswith("part-")).alias("unnamed"))


@query("rating_sheet_kappa", """
SELECT criterion, agreements, total, round(CASE WHEN pe < 1 THEN (agreements / total::DOUBLE - pe) / (1 - pe) ELSE 1.0 END, 9) AS kappa FROM (
  SELECT criterion, sum((a = b)::INT)::BIGINT AS agreements, count(*) AS total,
         (sum(a) * sum(b) + sum(1 - a) * sum(1 - b)) / (count(*) * count(*))::DOUBLE AS pe FROM (
    SELECT 'quality' AS criterion, quality AS a, 1 - toxic AS b FROM labels WHERE doc_id % 7 <> 0 UNION ALL
    SELECT 'toxicity', toxic, (doc_id % 2)::INT FROM labels) GROUP BY criterion)""")
def rating_sheet_kappa(spark, sf):
    """Ratings exported as sheets with two header rows and two columns per criterion, read back in long form."""
    path = fresh_path(spark, "sheet")
    first = F.when(F.col("doc_id") % 7 != 0, F.col("quality").cast("string")).otherwise(" ")
    rows = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("paper"), first.alias("quality a"), (1 - F.col("toxic")).cast("string").alias("quality b"),
        F.col("toxic").cast("string").alias("toxicity a"), (F.col("doc_id") % 2).cast("string").alias("toxicity b"),
        (F.col("doc_id") % 3).alias("sheet"), F.lit(2).alias("line"))
    # Each sheet's first two rows hold names, and would count as ratings if they stayed.
    heads = spark.range(3).select(F.col("id").alias("sheet"), F.explode(F.array(F.lit(0), F.lit(1))).alias("line")).select(
        F.concat(F.lit("head "), F.col("sheet").cast("string")).alias("paper"), *[F.lit("1").alias(c) for c in rows.columns[1:5]], "sheet", "line")
    whole = rows.unionByName(heads).repartition(3, "sheet").sortWithinPartitions("sheet", "line")
    whole.drop("line").write.option("header", True).partitionBy("sheet").csv(path)
    long = readers.rating_sheet(spark, path, ["quality", "toxicity"], ("a", "b"), "Abstract", start_column=1, paper="paper", line_breaks="escaped")
    pairs = A.rating_pairs(long, ["phase", "criterion", "paper"], ("a", "b"))
    return A.rater_kappa(pairs, ["criterion"]).select("criterion", "agreements", "total", F.round("kappa", 9).alias("kappa"))
