"""Elements that any selector finds: nested ones, attributes, paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pagemill.operators.paragraphs import extract_paragraphs


def html_elements(
    pages: DataFrame, xpaths: Sequence[str], key: str = "page_id", html: str = "html"
) -> DataFrame:
    """Rows (key, xp_idx, pos, origin, content): every element matched by each selector, nested ones too, blanks
    dropped. Selectors are steps ``//tag``, ``/tag`` or ``*`` with attribute tests ``[@a]`` and ``[@a='b']``."""
    return extract_paragraphs(pages.select(key, html), xpaths, html)
