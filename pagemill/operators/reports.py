"""Counts of what was dropped and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_report(responses: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows (stage, reason, n): failed requests, unrouted content types, rejected links; a NULL
    reason is the total of its stage. ``responses`` has handler and failure."""
    failed = responses.filter(F.col("failure").isNotNull()).select(
        F.lit("request").alias("stage"), F.col("failure").alias("reason")
    )
    unrouted = responses.filter(F.col("failure").isNull() & F.col("handler").isNull()).select(
        F.lit("route").alias("stage"), F.lower("content_type").alias("reason")
    )
    rejected = audited.filter(F.col("reason").isNotNull()).select(
        F.lit("link").alias("stage"), "reason"
    )
    events = failed.unionByName(unrouted).unionByName(rejected)
    return (
        events.rollup("stage", "reason")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
        .filter(F.col("level") < 3)
        .select("stage", "reason", "n")
    )
