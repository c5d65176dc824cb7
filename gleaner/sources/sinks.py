"""Sinks: folds, metrics, scored results, identifier lists."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import fresh_path, gathered
from gleaner.sources import schemas


def write_folds(folds: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per run, fold and split; a large split becomes several files written in parallel."""
    cells = ("run", "fold", "split")
    writer = gathered(folds, *cells).write.mode("overwrite").partitionBy(*cells)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_fold(spark: SparkSession, path: str, run: int, fold: int, split: str) -> DataFrame:
    """One split; only its folder is scanned."""
    wanted = (F.col("run") == run) & (F.col("fold") == fold) & (F.col("split") == split)
    return spark.read.parquet(path).where(wanted)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append under the declared schema; concurrent writers add files and lose none."""
    wanted = T.StructType.fromDDL(schemas.METRICS)
    present = {c.lower(): c for c in metrics.columns}
    cells = [(F.col(present[f.name.lower()]) if f.name.lower() in present else F.lit(None))
             .cast(f.dataType).alias(f.name) for f in wanted]
    metrics.select(*cells).write.mode("append").parquet(path)


def read_stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).parquet(path)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                       for f in df.schema])


# Line breaks and their marker as a percent code. The marker is written first and read back last.
LINE_CODES = (("%", "%25"), ("\n", "%0A"), ("\r", "%0D"))


def escaped_lines(df: DataFrame) -> DataFrame:
    """String cells without line breaks, so that a line of a CSV file is a row and large files can be split."""
    def encoded(name: str) -> Column:
        cell = F.col(f"`{name}`")
        for raw, code in LINE_CODES:
            cell = F.replace(cell, F.lit(raw), F.lit(code))
        return cell.alias(name)
    return df.select(*[encoded(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, line_breaks: str = "quoted") -> None:
    """CSV with a header; line breaks in cells stand quoted, or ``escaped`` for :func:`readers.read_csv` to split files."""
    if line_breaks not in ("quoted", "escaped"):
        raise ValueError(f"unsupported line breaks: {line_breaks}")
    (escaped_lines(df) if line_breaks == "escaped" else df).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_scored(df: DataFrame, path: str, fmt: str, line_breaks: str = "quoted") -> None:
    """Scored records as JSON lines, or as CSV with nested columns in JSON."""
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        write_csv(flatten_nested(df), path, line_breaks)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def write_named_csv(df: DataFrame, path: str, name: str) -> None:
    """One CSV file per value of ``name``, called after it, so that a file's name says what its rows share.

    Rows are written by all tasks into a folder per name; the driver then moves one file per name to its place.
    """
    spark = df.sparkSession
    staged = fresh_path(spark, "named")
    df.repartition(F.col(name)).write.option("header", True).option("escape", '"').partitionBy(name).csv(staged)
    jvm = spark._jvm
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(path))
    for found in files.globStatus(hadoop(f"{staged}/{name}=*/part-*")):
        source = found.getPath()
        called = unquote(source.getParent().getName().split("=", 1)[1])
        if not files.rename(source, hadoop(f"{path}/{called}.csv")):
            raise OSError(f"{path}/{called}.csv exists already")
    files.delete(hadoop(staged), True)


def write_id_lists(df: DataFrame, path: str, id_: str, split: str = "split", label: str = "label", cells: Sequence[str] = ()) -> None:
    """Identifiers as text, one per line, in a folder per split and class, inside a folder for each of ``cells``."""
    named = F.when(F.col(label) == 1, "pos").when(F.col(label) == 0, "neg")
    lists = df.select(*cells, F.col(split).alias("split"), named.alias("label"),
                      F.col(id_).cast("bigint").cast("string").alias("value"))
    folders = [*cells, "split", "label"]
    lists = gathered(lists.where("label is not null and value is not null"), *folders)
    lists.write.mode("overwrite").partitionBy(*folders).text(path)
