"""Stored raw responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import decode_body
from pagemill.operators.export import html_only

RAW_FILE_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("spider", T.StringType()),
    ]
)


def scan_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML files of a raw crawl as text: spider, filename, url, content.

    File names are a column: names made from paths start with ``_``, and Spark's file sources pass
    over files named like that. The ``.html`` test reaches the scan as a pushed filter.
    """
    files = html_only(spark.read.schema(RAW_FILE_SCHEMA).option("basePath", path).parquet(path))
    return files.select("spider", "filename", "url", decode_body(F.col("content")).alias("content"))
