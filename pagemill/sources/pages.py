"""Captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def scan_pages(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """The table of captured pages; ``page_id`` identifies one capture.

    Splits follow the files' bytes (``spark.sql.files.maxPartitionBytes``). Parsing costs far more than reading, so whoever
    reads one small file with many cores may ask for its rows to be dealt to ``tasks``; nothing else is shuffled.
    """
    pages = spark.read.schema(PAGES_SCHEMA).parquet(path)
    return pages.repartition(tasks, "page_id") if tasks else pages


def bucket_pages(pages: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write pages, raw or parsed, bucketed by page_id. Pay this shuffle once: every later join and sum by page_id
    (language scores of parsed pages, stored bodies) runs without another one."""
    writer = pages.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id")
    if path:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(table)
    return pages.sparkSession.table(table)
