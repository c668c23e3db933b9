"""Paragraph rows to one set of CSV files per spider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.export import CSV_COLUMNS, CSV_HEADER, ROW_ORDER
from pagemill.sources.paragraph_csv import CSV_OPTIONS


def write_paragraph_csv(
    rows: DataFrame,
    path: str,
    mode: str = "overwrite",
    max_rows_per_file: int = 1_000_000,
    spiders: DataFrame | None = None,
) -> None:
    """Write ``rows`` (with ``spider``) partitioned by spider, in page order, header in each file.

    The rebalance brings a spider's rows together so that few files are written, and adaptive
    execution splits a spider too large for one task. Files appear only when the job commits, so a
    reader never sees part of a result. Those of ``spiders`` that have no row get a file with the header
    alone, so that "nothing found" differs from "not run"; without ``spiders`` they leave no trace.
    """
    empty_as_null = [
        F.when(F.col(c) != "", F.col(c)).alias(c) if c != "depth" else F.col(c) for c in CSV_COLUMNS
    ]
    (
        rows.select("spider", *ROW_ORDER, *empty_as_null)
        .hint("rebalance", F.col("spider"))
        .sortWithinPartitions("spider", *ROW_ORDER)
        .select("spider", *CSV_COLUMNS)
        .write.mode(mode)
        .partitionBy("spider")
        .options(**CSV_OPTIONS, maxRecordsPerFile=max_rows_per_file)
        .csv(path)
    )
    if spiders is not None:
        empty = spiders.select("spider").distinct().join(rows.select("spider"), "spider", "left_anti")
        (
            empty.select("spider", F.lit(CSV_HEADER).alias("header"))
            .write.mode("append")
            .partitionBy("spider")
            .options(header="false", sep="\t")
            .csv(path)
        )
