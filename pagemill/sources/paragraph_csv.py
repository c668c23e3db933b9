"""Paragraph CSVs written by :mod:`pagemill.sinks.paragraph_csv`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAGRAPH_CSV_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("par_language", T.StringType()),
        T.StructField("page_language", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("depth", T.IntegerType()),
    ]
)
CSV_OPTIONS = {
    "sep": ";",
    "quote": '"',
    "escape": '"',
    "header": "true",
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def scan_paragraph_csv(spark: SparkSession, path: str) -> DataFrame:
    """All CSVs of a crawl folder, the spider from the partition folder. Other files are ignored."""
    schema = T.StructType([*PARAGRAPH_CSV_SCHEMA.fields, T.StructField("spider", T.StringType())])
    return (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS, multiLine="true", pathGlobFilter="*.csv")
        .option("basePath", path)
        .csv(path)
    )


def csv_spiders(spark: SparkSession, path: str) -> DataFrame:
    """Spiders of a crawl folder, those without any row included."""
    lines = spark.read.schema("value string, spider string").option("pathGlobFilter", "*.csv")
    return lines.option("basePath", path).text(path).select("spider").distinct()


def scan_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Loose CSVs, one per spider: the file stem is the spider."""
    rows = (
        spark.read.schema(PARAGRAPH_CSV_SCHEMA)
        .options(**CSV_OPTIONS, multiLine="true", pathGlobFilter="*.csv")
        .csv(path)
    )
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return rows.select("*", F.url_decode(stem).alias("spider"))
