"""HTML on columns, for pages that are not well formed.

``xpath()`` fails a job on the first broken page, so pages are cut with regular expressions that both Java and
RE2 accept. Comments, scripts and styles go first; elements are found by their tags, in ``elements``.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script(?:[\s/][^>]*)?>.*?(?:</script[^>]*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style[^>]*>|\z)"
)
TAG_PATTERN = r"(?s)<[/!?a-zA-Z][^>]*(?:>|\z)"
ENTITY_PATTERN = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Tags whose start or end closes an open paragraph.
PARAGRAPH_CLOSERS = (
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td "
    "tfoot th thead tr ul"
).split()
# HTML 4 entity names from the standard library, and the one XML adds.
ENTITIES = {**{name: chr(cp) for name, cp in name2codepoint.items()}, "apos": "'"}


def strip_hidden(html: Column) -> Column:
    """Drop comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN_PATTERN, "")


def _entity_value(name: Column) -> Column:
    """Character of an entity name without ``&`` and ``;``, NULL when there is no such name."""
    digits = (
        F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10))
        .when(name.startswith("#"), F.substring(name, 2, 7))
        .cast("long")
    )
    usable = ((digits > 0) & (digits < 0xD800)) | ((digits > 0xDFFF) & (digits <= 0x10FFFF))
    utf32 = F.unhex(F.lpad(F.hex(F.when(usable, digits).otherwise(F.lit(0xFFFD))), 8, "0"))
    # Read from JSON so that the plan is built in one call; the optimizer folds it to a constant.
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    return (
        F.when(name == "amp", F.lit("&"))
        .when(name.startswith("#"), F.decode(utf32, "UTF-32"))
        .otherwise(F.try_element_at(names, name))
    )


def decode_entities(text: Column) -> Column:
    """Replace character references once, left to right; unknown ones stay as they are.

    Lambdas are evaluated as written, so what is used twice is first put into an array: the pieces
    between ampersands, then each piece with its entity name.
    """
    named = F.transform(
        F.split(text, "&", -1),
        lambda p, i: F.struct(
            p.alias("p"), F.when(i > 0, F.regexp_extract(p, ENTITY_PATTERN, 1)).alias("name")
        ),
    )

    def piece(q: Column) -> Column:
        name, p = q["name"], q["p"]
        value = F.when(name != "", _entity_value(name))
        rest = F.substr(p, F.length(name) + F.lit(2))
        return F.when(name.isNull(), p).otherwise(
            F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), p))
        )

    return F.when(text.contains("&"), F.array_join(F.transform(named, piece), "")).otherwise(text)


def strip_tags(fragment: Column) -> Column:
    return F.regexp_replace(fragment, TAG_PATTERN, "")


def element_text(fragment: Column) -> Column:
    """All descendant text of a fragment, joined and not trimmed."""
    return decode_entities(strip_tags(fragment))


LINK_OPEN_PATTERN = r"(?is)<a(?:rea)?[\s/]"
HREF_PATTERN = (
    r"(?is)^(?:[^>]*?[\s/\"'])?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
)


def link_array(visible: Column) -> Column:
    """Array of (pos, href, text) for each ``a`` and ``area`` element that has an href."""
    pieces = F.split(visible, LINK_OPEN_PATTERN, -1)
    bodies = F.slice(pieces, F.lit(2), F.size(pieces))

    def parts(body: Column, pos: Column) -> Column:
        inner = F.regexp_replace(
            F.regexp_replace(body, r"(?s)^[^>]*(?:>|\z)", ""), r"(?is)</a(?:[\s>].*|\z)", ""
        )
        return F.struct(
            pos.alias("pos"),
            F.when(
                body.rlike(HREF_PATTERN),
                F.concat(*[F.regexp_extract(body, HREF_PATTERN, g) for g in (1, 2, 3)]),
            ).alias("raw"),
            strip_tags(inner).alias("inner"),
        )

    with_href = F.filter(F.transform(bodies, parts), lambda a: a["raw"].isNotNull())
    return F.transform(
        with_href,
        lambda a: F.struct(
            a["pos"].alias("pos"),
            F.regexp_replace(
                decode_entities(a["raw"]), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""
            ).alias("href"),
            decode_entities(a["inner"]).alias("text"),
        ),
    )


BASE_PATTERN = (
    r"(?is)<base\s(?:[^>]*?[\s\"'])?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
)


def base_href(visible: Column) -> Column:
    """Value of the page's ``base`` tag, ``''`` when it has none."""
    tag = F.regexp_extract(visible, r"(?is)<base\s[^>]*>", 0)
    href = F.concat(*[F.regexp_extract(tag, BASE_PATTERN, g) for g in (1, 2, 3)])
    return decode_entities(href)
