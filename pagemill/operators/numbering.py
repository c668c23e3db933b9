"""Row numbers inside groups that may hold a third of the table, and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.urls import (
    abbreviate_filename,
    is_long_name,
    numbered_filename,
    raw_filename,
)
from pagemill.session import materialize


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    then_by: Sequence[str] = (),
    name: str = "rn",
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """``row_number`` over (keys) in the order of (seq, then_by), without one task per group.

    A plain window sends a whole group to one task. Here rows are range-partitioned by (keys, seq,
    then_by) and stored with the number of their range, so a large group is cut evenly whatever its ids
    look like. Rows are numbered inside their range, and a group's part of a range starts where its parts
    of earlier ranges end; only these counts, at most one per range, are put in order per group.
    ``totals`` names expressions to sum over the whole group; they ride on the counts. The input is
    evaluated once, when the plan is made. Rows with a NULL key are dropped.
    """
    keys, totals = list(keys), totals or {}
    ranged = df.dropna(subset=keys).repartitionByRange(*keys, seq, *then_by)
    stored = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = (
        stored.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(k) for k, v in totals.items()])
    )
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        *[F.sum(k).over(group).alias(k) for k in totals],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(seq, *then_by)
    return (
        stored.withColumn("_local", F.row_number().over(inside))
        .join(starts, [*keys, "_range"])
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_range", "_local", "_start")
    )


def unique_long_names(
    named: DataFrame, dirs: Sequence[str] = ("spider",), seq: str = "page_id"
) -> DataFrame:
    """Abbreviate long names; the n-th repeat of an abbreviated name in a directory gets `` (n)``."""
    long = named.filter(is_long_name(F.col("filename"))).withColumn(
        "filename", abbreviate_filename(F.col("filename"))
    )
    numbered = number_rows(long, [*dirs, "filename"], seq, name="_rn")
    return numbered.withColumn(
        "filename", numbered_filename(F.col("filename"), F.col("_rn") - 1)
    ).drop("_rn")


def last_writer_wins(
    named: DataFrame, dirs: Sequence[str] = ("spider",), seq: str = "page_id"
) -> DataFrame:
    """Of several rows with one short name the latest stays. ``max`` of the sequence combines before
    the shuffle, so a name that all rows share costs no more than any other."""
    short = named.filter(~is_long_name(F.col("filename")))
    return short.groupBy(*dirs, "filename").agg(F.max(seq).alias(seq))


def raw_file_names(items: DataFrame, dirs: Sequence[str] = ("spider",)) -> DataFrame:
    """Rows (dirs, filename, page_id) of the files that remain. Works on thin columns only; bodies
    are joined afterwards by page_id."""
    named = items.select(*dirs, "page_id", raw_filename(F.col("url")).alias("filename"))
    columns = [*dirs, "filename", "page_id"]
    return (
        last_writer_wins(named, dirs)
        .select(*columns)
        .unionByName(unique_long_names(named, dirs).select(*columns))
    )


def raw_file_table(
    items: DataFrame, seeds_of: DataFrame, dirs: Sequence[str] = ("spider",)
) -> DataFrame:
    """Rows (dirs, filename, url, content): ``items`` has page_id, url, content and ``seeds_of``
    the (dirs, page_id, url) pairs of pages and spiders."""
    names = raw_file_names(seeds_of, dirs)
    return names.join(items.select("page_id", "url", "content"), "page_id").select(
        *dirs, "filename", "url", "content"
    )


def even_chunk(rn: Column, n: Column, k: Column) -> Column:
    """Zero-based chunk of row ``rn`` (from 1) when n rows go to k chunks as evenly as possible, the
    longer chunks first."""
    r = rn - 1
    q = F.floor(n / k)
    m = n % k
    cut = m * (q + 1)
    late = m + F.floor((r - cut) / F.greatest(q, F.lit(1)))
    return F.when(r < cut, F.floor(r / (q + 1))).otherwise(late).cast("long")


def first_link_per_page(links: DataFrame) -> DataFrame:
    """First occurrence of a URL in a page, for link tables that are no longer arrays. A page is one
    record, so the groups are small."""
    order = Window.partitionBy("page_id", "url").orderBy("pos")
    return links.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
