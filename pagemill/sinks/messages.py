"""Result messages to JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("crawl", T.StringType()),
        T.StructField("raw", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)


def send_results(messages: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per message. Committed files take the place of durable delivery."""
    messages.select(*MESSAGE_SCHEMA.names).write.mode(mode).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).json(path)
