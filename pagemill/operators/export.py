"""Result messages: sizes, chunks, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import csv_line
from pagemill.operators.numbering import even_chunk, number_rows

# The CSV columns in order, and the size limit of one message in bytes.
CSV_COLUMNS = ("url", "content", "par_language", "page_language", "origin", "depth")
CSV_HEADER = ";".join(CSV_COLUMNS)
MESSAGE_LIMIT = 10_485_760
# Parser names of a specification.
PARAGRAPH_PARSER = "parsers.ParagraphParser"
RAW_PARSER = "parsers.RawParser"

ROW_ORDER = ("page_id", "xp_idx", "pos")


def csv_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """Add ``line``, the CSV text of a paragraph row."""
    return rows.select(*keys, *ROW_ORDER, csv_line(*[F.col(c) for c in CSV_COLUMNS]).alias("line"))


HEADER_BYTES = len(CSV_HEADER.encode()) + 1


def result_size(rows: DataFrame, key: str = "spider") -> DataFrame:
    """Rows and bytes of each spider's CSV, header included."""
    return (
        csv_lines(rows, key)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.sum(F.octet_length("line") + 1) + HEADER_BYTES).alias("n_bytes"),
        )
    )


def _chunked(rows: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame:
    totals = {"_rows": F.lit(1), "_bytes": F.octet_length("line") + 1}
    numbered = number_rows(
        csv_lines(rows, *keys), keys, "page_id", ("xp_idx", "pos"), "rn", totals
    )
    chunks = F.ceil((F.col("_bytes") + HEADER_BYTES) / F.lit(limit)).cast("long")
    return (
        numbered.withColumn("chunks", chunks)
        .withColumn("chunk", even_chunk(F.col("rn"), F.col("_rows"), F.col("chunks")))
        .drop("_bytes")
    )


def chunk_rows(
    rows: DataFrame, limit: int = MESSAGE_LIMIT, keys: Sequence[str] = ("spider",)
) -> DataFrame:
    """CSV lines with ``chunk`` (from 0) and ``chunks``. The number of chunks comes from the bytes,
    the split is by rows, so a chunk may exceed the limit."""
    return _chunked(rows, limit, keys).drop("_rows")


def _message_rows(
    df: DataFrame, crawl: Column, raw: bool, url: str, filename: Column, data: Column
) -> DataFrame:
    return df.select(
        crawl.alias("crawl"),
        F.lit(raw).alias("raw"),
        F.col(url).alias("url"),
        filename.alias("filename"),
        data.alias("data"),
    )


def paragraph_messages(
    rows: DataFrame,
    crawl: Column,
    limit: int = MESSAGE_LIMIT,
    keys: Sequence[str] = ("spider",),
    spiders: DataFrame | None = None,
) -> DataFrame:
    """Rows (crawl, raw, url, filename, data), one per chunk. A group is one chunk, whose size the
    limit sets, never a whole spider. The last of ``keys`` names the spider; ``crawl`` may use all.

    With fewer rows than chunks, the chunks beyond the last row have the header alone; so has the one
    message of each of ``spiders`` (a table with ``keys``) that has no rows.
    """
    spider = keys[-1]
    chunk = F.col("chunk")
    last = F.least("_rows", "chunks") - 1
    bodies = (
        _chunked(rows, limit, keys)
        .groupBy(*keys, "chunk", "chunks")
        .agg(
            F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("_lines"),
            F.first("_rows").alias("_rows"),
        )
        .withColumn("_chunk", F.when(chunk == last, F.sequence(chunk, F.col("chunks") - 1)).otherwise(F.array(chunk)))
        .withColumn("_chunk", F.explode("_chunk"))
        .withColumn("_lines", F.when(F.col("_chunk") == chunk, F.col("_lines")))
        .select(*keys, F.col("_chunk").alias("chunk"), "chunks", "_lines")
    )
    if spiders is not None:
        empty = spiders.select(*keys).distinct().join(rows.select(*keys), list(keys), "left_anti")
        bodies = bodies.unionByName(
            empty.withColumns({"chunk": F.lit(0).cast("long"), "chunks": F.lit(1).cast("long")}),
            allowMissingColumns=True,
        )
    part = F.concat(
        F.col(spider),
        F.lit("_part"),
        (F.col("chunk") + 1).cast("string"),
        F.lit("_"),
        F.col("chunks").cast("string"),
    )
    lines = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    text = F.concat(F.lit(CSV_HEADER + "\n"), F.coalesce(F.concat(lines, F.lit("\n")), F.lit("")))
    filename = F.when(F.col("chunks") == 1, F.col(spider)).otherwise(part)
    return _message_rows(bodies, crawl, False, spider, filename, text)


def html_only(files: DataFrame) -> DataFrame:
    return files.filter(F.col("filename").endswith(".html"))


def raw_messages(files: DataFrame, crawl: Column, key: str = "spider") -> DataFrame:
    """One row per stored HTML file; ``content`` is text."""
    return _message_rows(html_only(files), crawl, True, key, F.col("filename"), F.col("content"))


def to_messages(rows: DataFrame) -> DataFrame:
    """Message rows as JSON text."""
    columns = [F.col(c) for c in ("crawl", "raw", "url", "filename", "data")]
    return rows.select("crawl", "filename", F.to_json(F.struct(*columns)).alias("message"))


def dispatch_finalizer(
    specs: DataFrame,
    paragraphs: DataFrame,
    files: DataFrame,
    limit: int = MESSAGE_LIMIT,
    spiders: DataFrame | None = None,
) -> DataFrame:
    """Messages of many crawls: paragraph rows of the paragraph crawls, files of the raw crawls.
    All inputs carry ``spec`` and ``spider``; paragraph crawls have a message for each of ``spiders``."""
    parsers = specs.select(F.col("name").alias("spec"), "parser")

    def crawls(parser: str) -> DataFrame:
        return parsers.filter(F.col("parser") == parser).select("spec")

    par = paragraphs.join(crawls(PARAGRAPH_PARSER), "spec", "left_semi")
    raw = files.join(crawls(RAW_PARSER), "spec", "left_semi")
    owners = None if spiders is None else spiders.join(crawls(PARAGRAPH_PARSER), "spec", "left_semi")
    return paragraph_messages(par, F.col("spec"), limit, ("spec", "spider"), owners).unionByName(
        raw_messages(raw, F.col("spec"))
    )
