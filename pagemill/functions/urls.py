"""URL algebra on columns.

One pattern splits a URL into its five parts. ``parse_url`` is not used: it yields NULL or raises on
the illegal characters that captured links are full of, and its HOST drops port and user info.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic URI syntax, groups = scheme, authority, path, query, fragment.
URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
# Schemes a link may have.
LINK_SCHEMES = ("http", "https", "file", "ftp")
# Extensions that are synonyms of another one.
EXTENSION_SYNONYMS = {
    ".jpeg": ".jpg",
    ".tff": ".tiff",
    ".tif": ".tiff",
    ".htm": ".html",
    "": ".txt",
    ".log": ".txt",
}
# Generic URI syntax, characters that mean the same escaped or not, and those that may stand unescaped.
UNRESERVED = r"^[A-Za-z0-9\-._~]$"
RESERVED = r"^[!$&'()*+,;=:@/?\[\]#]$"
# File name limit and the mark put in place of the removed middle.
NAME_LIMIT = 100
NAME_MARK = "(...)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, group)


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def url_netloc(url: Column) -> Column:
    """Authority with user info and port; ``''`` when there is none."""
    return _part(url, 2)


def url_path(url: Column) -> Column:
    """Path without query, fragment and the ``;parameters`` of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return _part(url, 4)


def url2filename(url: Column) -> Column:
    """Authority and path with slashes turned into underscores."""
    return F.translate(F.concat(url_netloc(url), url_path(url)), "/", "_")


def raw_filename(url: Column) -> Column:
    """File name of a stored response: a path without a file part stands for its index page."""
    path = url_path(url)
    has_file = F.regexp_extract(path, r"[^/]*$", 0).contains(".")
    named = (
        F.when(has_file, path)
        .when(path.endswith("/"), F.concat(path, F.lit("index.html")))
        .otherwise(F.concat(path, F.lit("/index.html")))
    )
    return F.translate(named, "/", "_")


def is_long_name(name: Column) -> Column:
    return F.length(name) > NAME_LIMIT


def abbreviate_filename(name: Column) -> Column:
    """Keep both ends of a name longer than the limit."""
    room = NAME_LIMIT - len(NAME_MARK)
    front = room // 2
    back = room - front
    short = F.concat(F.substring(name, 1, front), F.lit(NAME_MARK), F.right(name, F.lit(back)))
    return F.when(is_long_name(name), short).otherwise(name)


def numbered_filename(name: Column, n: Column) -> Column:
    """``name`` for n = 0, else `` (n)`` before the last dot."""
    stem = F.regexp_extract(name, r"(?s)^(.*)\.([^.]*)$", 1)
    ending = F.regexp_extract(name, r"(?s)^(.*)\.([^.]*)$", 2)
    return F.when(n == 0, name).otherwise(
        F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")."), ending)
    )


def url_scheme_ok(url: Column) -> Column:
    return F.substring_index(url, "://", 1).isin(*LINK_SCHEMES)


def url_extension(url: Column) -> Column:
    """Lower-case extension of the path with its dot; dots that lead a name do not count."""
    return F.lower(F.regexp_extract(url_path(url), r"[^/.][^/]*(\.[^./]*)$", 1))


def host_in_domains(netloc: Column, domains: Column) -> Column:
    """Equal to a domain of the array or below it; an empty host is in no domain."""
    host = F.lower(netloc)
    return (host != "") & F.exists(
        domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d)))
    )


def host_suffixes(netloc: Column) -> Column:
    """The host and all its parent domains, the equi-join form of :func:`host_in_domains`."""
    labels = F.split(F.lower(netloc), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; surplus ``..`` at the root vanish."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    full = F.regexp_replace(F.concat(F.lit("/"), joined, tail), r"^//+", "/")
    full = F.when(tail == "/", F.regexp_replace(full, r"//$", "/")).otherwise(full)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), full).otherwise(path)


def url_base(url: Column) -> Column:
    """The parts of a page URL that resolving needs, computed once per page."""
    folder = F.regexp_extract(url_path(url), r"(?s)^(.*/)?[^/]*$", 1)
    return F.struct(
        url.alias("url"),
        _part(url, 1).alias("scheme"),
        F.concat(_part(url, 1), F.lit("://"), url_netloc(url)).alias("origin"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
        F.regexp_extract(url, r"(?s)^[^#]*", 0).alias("no_fragment"),
        F.regexp_extract(url, r"(?s)^[^?#]*", 0).alias("no_query"),
    )


def resolve_from(base: Column, ref: Column) -> Column:
    """Absolute form of a link, given the :func:`url_base` of its page."""
    path = F.regexp_extract(ref, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    beside = F.regexp_replace(F.concat(base["folder"], path), "//+", "/")
    return (
        F.when(ref == "", base["url"])
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(base["scheme"], F.lit(":"), ref))
        .when(ref.startswith("/") & ~ref.contains("/."), F.concat(base["origin"], ref))
        .when(ref.startswith("/"), F.concat(base["origin"], _without_dots(path), rest))
        .when(ref.startswith("#"), F.concat(base["no_fragment"], ref))
        .when(ref.startswith("?"), F.concat(base["no_query"], ref))
        .otherwise(F.concat(base["origin"], _without_dots(beside), rest))
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of a link found on page ``base``."""
    return resolve_from(url_base(base), ref)


def normalized_escapes(text: Column, space: str = "%20") -> Column:
    """One spelling of percent-escapes, byte by byte.

    Escapes of unreserved characters are undone, other ones have upper-case digits; what may not stand in a URL is
    escaped as UTF-8, and so is a ``%`` that starts no escape. Reserved characters stay as they are written, since an
    escaped one means another thing. ``space`` is the spelling of a blank. Null stays null.
    """
    # After url_encode the text has only letters, digits and .*_+-%, so "!" is free to mark the escapes that were
    # written, and "+" is a blank.
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    marked = F.regexp_replace(encoded, "%25([0-9A-Fa-f]{2})", "!$1")
    pieces = F.regexp_extract_all(marked, F.lit("([!%][0-9A-Fa-f]{2}|[^!%]+)"), F.lit(1))

    def spelled(p: Column) -> Column:
        digits = F.upper(F.substring(p, 2, 2))
        char = F.unhex(digits).cast("string")
        stands = char.rlike(UNRESERVED) | (p.startswith("%") & char.rlike(RESERVED))
        escape = F.when(digits == "20", F.lit(space)).when(stands, char).otherwise(F.concat(F.lit("%"), digits))
        return F.when(p.rlike("^[!%]"), escape).otherwise(p)

    spelled_out = F.array_join(F.transform(pieces, spelled), "")
    return F.when(text.rlike(r"\A[A-Za-z0-9\-._~!$&'()*,;=:@/?]*\z"), text).otherwise(spelled_out)


def canonical_url(url: Column) -> Column:
    """Key under which a URL counts as visited: host in lower case, query arguments in order of
    name and value, percent-escapes in one spelling (``+`` for a blank in the query), no fragment, ``/`` for an empty path;
    ``//`` only before a host."""
    arguments = F.transform(
        F.filter(F.split(normalized_escapes(url_query(url), "+"), "&"), lambda a: a != ""),
        lambda a: F.struct(
            F.regexp_extract(a, r"(?s)^([^=]*)=?(.*)$", 1).alias("k"),
            F.regexp_extract(a, r"(?s)^([^=]*)=?(.*)$", 2).alias("v"),
        ),
    )
    query = F.array_join(
        F.transform(F.array_sort(arguments), lambda a: F.concat(a["k"], F.lit("="), a["v"])), "&"
    )
    path = normalized_escapes(_part(url, 3))
    return F.concat(
        url_scheme(url),
        F.when(url_netloc(url) == "", F.lit(":")).otherwise(F.concat(F.lit("://"), F.lower(url_netloc(url)))),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def normalize_extension(ext: Column) -> Column:
    """Extension with a leading dot, in lower case, synonyms mapped to one spelling."""
    dotted = F.lower(
        F.when((ext == "") | ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    )
    synonyms = F.create_map(*[F.lit(x) for pair in EXTENSION_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(synonyms, dotted), dotted)
