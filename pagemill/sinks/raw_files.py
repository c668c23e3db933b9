"""Raw responses to a table of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_raw_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (spider, filename, url, content) partitioned by spider; text content becomes bytes."""
    content = F.col("content")
    if dict(files.dtypes)["content"] == "string":
        content = F.encode(content, "utf-8")
    (
        files.select("spider", "filename", "url", content.alias("content"))
        .hint("rebalance", F.col("spider"))
        .write.mode(mode)
        .partitionBy("spider")
        .parquet(path)
    )
