"""Responses to paragraph rows and raw rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.elements import paragraph_arrays
from pagemill.functions.html import strip_hidden
from pagemill.functions.text import has_text, split_lines

# Defaults of the two parsers.
DEFAULT_XPATHS = ("//p", "//td")
DEFAULT_RAW_TYPES = ("text/html", "application/pdf")


def matched_type(content_type: Column, handled: Sequence[str]) -> Column:
    """First of ``handled`` that is a part of the lower-cased header, else NULL."""
    header = F.lower(F.coalesce(content_type, F.lit("")))
    return F.coalesce(*[F.when(header.contains(t), F.lit(t)) for t in handled])


def route_content_type(responses: DataFrame, handled: Sequence[str]) -> DataFrame:
    """Add ``handler``; NULL means nobody parses this response."""
    return responses.withColumn("handler", matched_type(F.col("content_type"), handled))


def content_type_allow(responses: DataFrame, types: Sequence[str] = DEFAULT_RAW_TYPES) -> DataFrame:
    return responses.filter(matched_type(F.col("content_type"), types).isNotNull())


def explode_structs(df: DataFrame, kept: Sequence[str], array: str, present: str) -> DataFrame:
    """Explode an array of structs; ``present`` is a field that is never NULL.

    The outer form and a filter, because for the plain form the optimizer adds a test of the array's
    size and pushes it below the projection that computes the array, which then runs twice.
    """
    return df.select(*kept, F.inline_outer(array)).filter(F.col(present).isNotNull())


def parse_pages(
    pages: DataFrame, xpaths: Sequence[str] | Mapping[int, str] = DEFAULT_XPATHS, html: str = "html"
) -> DataFrame:
    """Replace the HTML of each page by ``paragraphs``, its array of matched elements; a mapping gives the
    selectors by their xp_idx.

    Narrow: the fat column goes no further than this projection.
    """
    kept = [c for c in pages.columns if c != html]
    visible = pages.select(*kept, strip_hidden(F.col(html)).alias("_visible"))
    numbered = dict(xpaths) if isinstance(xpaths, Mapping) else dict(enumerate(xpaths))
    return paragraph_arrays(visible, "_visible", numbered, kept)


def paragraph_rows(parsed: DataFrame) -> DataFrame:
    """One row per entry of ``paragraphs``: xp_idx, pos, origin, content."""
    kept = [c for c in parsed.columns if c != "paragraphs"]
    return explode_structs(parsed, kept, "paragraphs", "pos")


def extract_paragraphs(
    pages: DataFrame, xpaths: Sequence[str] = DEFAULT_XPATHS, html: str = "html"
) -> DataFrame:
    return paragraph_rows(parse_pages(pages, xpaths, html))


def page_text(parsed: DataFrame) -> DataFrame:
    """All paragraph texts of a page joined by one blank. The page is one record, so its texts are
    joined inside the row and nothing is shuffled."""
    kept = [c for c in parsed.columns if c != "paragraphs"]
    contents = F.transform(F.col("paragraphs"), lambda p: p["content"])
    return parsed.select(*kept, F.array_join(contents, " ").alias("page_text"))


def paragraphs_per_page(parsed: DataFrame) -> DataFrame:
    """Matched paragraphs per page, pages without any included."""
    kept = [c for c in parsed.columns if c != "paragraphs"]
    return parsed.select(*kept, F.size("paragraphs").cast("long").alias("n_paragraphs"))


def drop_blank(rows: DataFrame, text: str = "content") -> DataFrame:
    return rows.filter(has_text(F.col(text)))


def line_paragraphs(documents: DataFrame, text: str, origin: str = "pdf") -> DataFrame:
    """Extracted document text to one row per non-blank line."""
    kept = [c for c in documents.columns if c != text]
    lines = documents.select(*kept, F.posexplode(split_lines(F.col(text))).alias("pos", "content"))
    return drop_blank(lines).withColumn("origin", F.lit(origin))


def raw_items(responses: DataFrame, types: Sequence[str] = DEFAULT_RAW_TYPES) -> DataFrame:
    """Rows (page_id, url, content, depth) of the allowed content types."""
    return content_type_allow(responses, types).select(
        "page_id", "url", F.col("body").alias("content"), "depth"
    )
