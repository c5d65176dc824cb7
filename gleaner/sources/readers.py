"""Readers: CSV, JSON, XML, nested full text, file-name metadata, rating sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.fulltext import BODY_SCHEMA, flat_text
from gleaner.functions.text import clean_or_null, scorable
from gleaner.operators.columns import drop_index_columns, find_column, lenient_double
from gleaner.sources import schemas
from gleaner.sources.sinks import LINE_CODES


def _empty_to_null(df: DataFrame) -> DataFrame:
    """An empty cell is missing, quoted or not."""
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def _csv(spark: SparkSession, path: str | list[str], line_breaks: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of CSV files with headers. Only ``quoted`` line breaks keep a file in one task; ``escaped`` ones are put back."""
    if line_breaks not in ("quoted", "escaped"):
        raise ValueError(f"unsupported line breaks: {line_breaks}")
    reader = (spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks == "quoted")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    reader = reader.option("enforceSchema", False).schema(schema) if schema else reader.option("inferSchema", False)
    return reader.csv(path)


def _restored(df: DataFrame, line_breaks: str) -> DataFrame:
    def decoded(name: str) -> Column:
        cell = F.col(f"`{name}`")
        for raw, code in reversed(LINE_CODES):
            cell = F.replace(cell, F.lit(code), F.lit(raw))
        return cell.alias(name)
    if line_breaks == "quoted":
        return df
    return df.select(*[decoded(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, line_breaks: str = "quoted") -> DataFrame:
    """CSV with a header; fields may hold quotes and line breaks.

    Without a schema every column is a string, which needs no inference pass. Files whose line breaks are ``escaped``
    (:func:`sinks.write_csv`), or that have none and no percent codes, are split over tasks; a file with quoted ones is one task's.
    """
    return drop_index_columns(_empty_to_null(_restored(_csv(spark, path, line_breaks, schema), line_breaks)))


def score_input(df: DataFrame) -> DataFrame:
    """Add cleaned ``abstract``, ``title`` and the flag ``valid_for_scoring``; no row is dropped.

    Columns are found by name in any case, or by the first name that contains it.
    """
    abstract, title = find_column(df.columns, "abstract"), find_column(df.columns, "title")
    if abstract is None:
        raise ValueError(f"an abstract column is needed; there are {', '.join(df.columns)}")
    cells = {"abstract": clean_or_null(F.col(f"`{abstract}`"))}
    if title:
        cells["title"] = clean_or_null(F.col(f"`{title}`"))
    cells["valid_for_scoring"] = scorable(F.col(f"`{abstract}`"), F.col(f"`{title}`") if title else None)
    return df.withColumns(cells)


def read_score_csv(spark: SparkSession, path: str, line_breaks: str = "quoted") -> DataFrame:
    return score_input(read_csv(spark, path, line_breaks=line_breaks))


def _given(value: Column) -> Column:
    """True for a variant that is there and holds something."""
    return value.isNotNull() & ~F.is_variant_null(value)


def _member(keys: Column, members: Column, wanted: str) -> Column:
    """Value of the key that equals ``wanted`` in any case, else of the first that contains it."""
    exact = F.get(F.filter(keys, lambda k: F.lower(F.trim(k)) == wanted), F.lit(0))
    near = F.get(F.filter(keys, lambda k: F.lower(k).contains(wanted)), F.lit(0))
    value = F.try_element_at(members, exact)
    return F.when(_given(value), value).otherwise(F.try_element_at(members, near))


def _string_of(value: Column) -> Column:
    """Text of a variant that is a string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def read_score_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a JSON array whose items are objects or bare strings, in order.

    Returns ``file``, ``item``, ``abstract``, ``title``, ``valid_for_scoring``
    and the item's ``raw`` JSON; an item that cannot be scored keeps its row.
    With ``lines`` each line is one item, which Spark can split; ``item`` then
    grows in file order but has gaps.
    """
    if lines:
        text = spark.read.text(path).where("trim(value) != ''").select(
            F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("item"),
            F.parse_json("value").alias("v"))
    else:
        whole = spark.read.option("wholetext", True).text(path)
        text = whole.select(F.col("_metadata.file_name").alias("file"),
                            F.posexplode(F.from_json("value", "array<variant>")).alias("item", "v"))
    shaped = text.withColumn("raw", F.to_json("v")).withColumn("kind", F.schema_of_variant("v"))
    shaped = shaped.withColumn("members", F.when(
        F.col("kind").startswith("OBJECT"), F.from_json("raw", "map<string,variant>")))
    keys, members = F.json_object_keys("raw"), F.col("members")
    found_title = _member(keys, members, "title")
    item_text = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string"))
    abstract = clean_or_null(F.coalesce(_string_of(_member(keys, members, "abstract")), item_text))
    title = clean_or_null(_string_of(found_title))
    valid = abstract.isNotNull() & (~F.coalesce(_given(found_title), F.lit(False)) | title.isNotNull())
    return shaped.select("file", "item", abstract.alias("abstract"), title.alias("title"),
                         valid.alias("valid_for_scoring"), "raw")


def _plain_xml(text: Column) -> Column:
    """Element text without inner markup."""
    return F.regexp_replace(text, r"<[^>]+>", "")


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per article: first abstract part, title, DOI, MeSH descriptors."""
    raw = (spark.read.format("xml").option("rowTag", "PubmedArticle")
           .schema(schemas.ARTICLE_XML).load(path))
    article = F.col("MedlineCitation.Article")
    dois = F.filter(article["ELocationID"], lambda e: e["_EIdType"] == "doi")
    mesh = F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda h: h["DescriptorName"])
    no_mesh = F.array().cast("array<string>")
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), _plain_xml(article["ArticleTitle"]).alias("title"),
        _plain_xml(F.get(article["Abstract"]["AbstractText"], F.lit(0))).alias("abstract"),
        F.get(dois, F.lit(0))["_VALUE"].alias("doi"),
        F.array_compact(F.coalesce(mesh, no_mesh)).alias("mesh_terms"))


def optional_negatives(articles: DataFrame, source: str = "pubmed", label: int = -1) -> DataFrame:
    """Articles in the table form of optional negatives, descriptors joined by a comma."""
    return articles.select(
        "title", F.col("abstract").alias("text"), F.col("pmid").alias("PMID"),
        F.array_join("mesh_terms", ", ").alias("MESH_terms"), "doi",
        F.lit(source).alias("source"), F.lit(label).alias("labels"))


def read_fulltext_json(spark: SparkSession, path: str, id_: str = "pmcid") -> DataFrame:
    """Nested article bodies, one JSON object per line, with their flat text."""
    df = spark.read.schema(f"`{id_}` string, body_sections {BODY_SCHEMA}").json(path)
    return df.withColumn("full_text", flat_text(F.col("body_sections")))


def file_stem() -> Column:
    """Name of the file a row came from, without extension; blanks arrive URL-encoded."""
    return F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "")


def read_fold_predictions(spark: SparkSession, pattern: str, schema: str = schemas.PREDICTIONS,
                          line_breaks: str = "quoted") -> DataFrame:
    """All prediction files that match, in one scan, with ``source_file``.

    Columns are taken by name, so an index column an export added does no harm.
    """
    wanted = T.StructType.fromDDL(schema)
    raw = _csv(spark, pattern, line_breaks)
    named = _restored(raw.select(*[f"`{f.name}`" for f in wanted], file_stem().alias("source_file")), line_breaks)
    cells = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted]
    return named.select(*cells, "source_file")


# The three forms of a prediction file's name.
RUN_NAME = r"^fold[_-](\d+)_(.+?)_(BCE|focal)(_with_title)?(_with_keywords)?_run-(\d+)_opt_neg-(\d+)$"
FOREST_NAME = r"^fold-(\d+)_(rf)_(log_loss|gini|entropy)(_with_title)?(_with_keywords)?_(\d+)_run-(\d+)_opt_neg-(\d+)$"
KERNEL_NAME = r"^(svm)_([a-z]+)(_with_title)?(_with_keywords)?_run-(\d+)_opt_neg-(\d+)$"


def run_metadata(stem: Column) -> Column:
    """Struct of what a prediction file's name says; parts it lacks are NULL."""
    def part(pattern: str, index: int) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, index), F.lit(""))

    def first(*cells: Column) -> Column:
        return F.coalesce(*cells)

    known = stem.rlike(RUN_NAME) | stem.rlike(FOREST_NAME) | stem.rlike(KERNEL_NAME)

    def flag(*cells: Column) -> Column:
        return F.when(known, first(*cells).isNotNull())

    return F.struct(
        first(part(RUN_NAME, 1), part(FOREST_NAME, 1)).cast("int").alias("fold"),
        first(part(RUN_NAME, 2), part(FOREST_NAME, 2), part(KERNEL_NAME, 1)).alias("model"),
        part(RUN_NAME, 3).alias("loss"),
        part(FOREST_NAME, 3).alias("criterion"), part(FOREST_NAME, 6).cast("int").alias("num_trees"),
        part(KERNEL_NAME, 2).alias("kernel"),
        flag(part(RUN_NAME, 4), part(FOREST_NAME, 4), part(KERNEL_NAME, 3)).alias("with_title"),
        flag(part(RUN_NAME, 5), part(FOREST_NAME, 5), part(KERNEL_NAME, 4)).alias("with_keywords"),
        first(part(RUN_NAME, 6), part(FOREST_NAME, 7), part(KERNEL_NAME, 5)).cast("int").alias("run"),
        first(part(RUN_NAME, 7), part(FOREST_NAME, 8), part(KERNEL_NAME, 6)).cast("int").alias("opt_neg"))


def available_models(predictions: DataFrame, suffix: str = "_run-0_opt_neg-500") -> DataFrame:
    """Distinct model patterns among the source files, sorted."""
    rest = F.regexp_extract("source_file", r"^[^_]*_[^_]*_(.*)$", 1)
    names = predictions.select(F.replace(rest, F.lit(suffix), F.lit("")).alias("model")).distinct()
    return names.where("model != ''").orderBy("model")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Recorded metrics; cells that are no numbers, such as ``{}``, become NULL."""
    return lenient_double(read_csv(spark, path), schemas.METRIC_COLUMNS)


def checked_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics under the declared schema, and the rows in which a present cell does not fit it."""
    wanted = T.StructType.fromDDL(schemas.METRICS)
    names = {c.lower(): c for c in df.columns}
    cells, broken = [], F.lit(False)
    for field in wanted:
        if field.name.lower() not in names:
            cells.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        raw = F.nullif(F.col(names[field.name.lower()]).cast("string"), F.lit("{}"))
        number = isinstance(field.dataType, (T.IntegerType, T.LongType))
        read = raw.try_cast("double").try_cast(field.dataType) if number else raw.try_cast(field.dataType)
        cells.append(read.alias(field.name))
        broken = broken | (raw.isNotNull() & read.isNull())
    return df.where(~broken).select(*cells), df.where(broken)


def without_header_rows(df: DataFrame, rows: int) -> DataFrame:
    """Drop the first data rows of every file, which hold names and not ratings.

    They are in the file's first block, whatever task reads it and however many blocks there are: a row's number within its
    scan task grows along a block, and the smallest number in the first block is where the file starts. One such row
    per file is kept in the list, so it joins as a small side.
    """
    numbered = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_row"))
    starts = numbered.where("_block = 0").groupBy("_file").agg(F.min("_row").alias("_start"))
    named = (F.col("_block") == 0) & (F.col("_row") < F.col("_start") + rows)
    return numbered.join(starts, "_file").where(~named).drop("_file", "_block", "_start").withColumnRenamed("_row", "sheet_row")


def rating_sheet(spark: SparkSession, path: str, criteria: Sequence[str], raters: tuple[str, str],
                 phase: str, start_column: int = 4, header_rows: int = 2, paper: str | None = None,
                 line_breaks: str = "quoted") -> DataFrame:
    """Long ratings (paper, phase, criterion, rater, rating) of a sheet with two columns per criterion."""
    raw = _csv(spark, path, line_breaks)
    names = raw.columns[start_column:start_column + 2 * len(criteria)]
    data = _restored(without_header_rows(raw, header_rows), line_breaks)
    cells = [F.struct(F.lit(criterion).alias("criterion"), F.lit(raters[side]).alias("rater"),
                      clean_or_null(F.col(f"`{names[2 * i + side]}`")).alias("rating"))
             for i, criterion in enumerate(criteria) for side in (0, 1)]
    paper_id = F.col(f"`{paper}`") if paper else F.col("sheet_row").cast("string")
    return data.select(paper_id.alias("paper"), F.lit(phase).alias("phase"), F.inline(F.array(*cells)))
