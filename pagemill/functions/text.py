"""Text helpers: blank test, line split, decoding, CSV quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WHITE_SPACE = (
    r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
HAS_TEXT_PATTERN = f"[^{WHITE_SPACE}]"
# Line boundaries of extracted document text.
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def has_text(text: Column) -> Column:
    """False for text that is empty or only white space, Unicode blanks included."""
    return text.rlike(HAS_TEXT_PATTERN)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK_PATTERN, -1)


def decode_body(body: Column) -> Column:
    """Bytes to text: UTF-8 where the bytes are valid UTF-8, else Latin-1; empty gives ``''``."""
    as_text = body.cast("string")
    return (
        F.when(body.isNull() | (F.octet_length(body) == 0), F.lit(""))
        .when(F.is_valid_utf8(as_text), as_text)
        .otherwise(F.decode(body, "iso-8859-1"))
    )


def encode_text(text: Column, charset: str = "utf-8") -> Column:
    """Text to bytes; characters the charset lacks are dropped (US-ASCII and Latin-1)."""
    limits = {"us-ascii": r"[^\x00-\x7f]", "iso-8859-1": r"[^\x00-\xff]"}
    pattern = limits.get(charset.lower())
    return F.encode(F.regexp_replace(text, pattern, "") if pattern else text, charset)


def csv_field(value: Column) -> Column:
    """One ``;``-separated field, quoted only where needed; NULL and ``''`` are both nothing."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[;"\n\r]'), quoted).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(";", *[csv_field(v) for v in values])
