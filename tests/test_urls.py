import posixpath
import re
from urllib.parse import quote, unquote_to_bytes, urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import urls as U

word = st.text("abcXYZ019.-_~ |;é", min_size=0, max_size=6)
url = st.builds(
    lambda scheme, user, host, port, segments, query, fragment: scheme
    + user
    + host
    + port
    + "".join("/" + s for s in segments)
    + query
    + fragment,
    st.sampled_from(["http://", "https://", "ftp://", "//"]),
    st.sampled_from(["", "u:p@", "me@"]),
    st.sampled_from(["example.com", "WWW.Example.org", "a.b.c", "h"]),
    st.sampled_from(["", ":8080"]),
    st.lists(word, max_size=4),
    st.sampled_from(["", "?", "?q=1&a=2", "?x=/y"]),
    st.sampled_from(["", "#", "#f/g?h"]),
)
quick = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(st.lists(url, min_size=50, max_size=200))
def test_parts_agree_with_urllib(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    c = F.col("u")
    rows = df.select(
        "u",
        U.url_netloc(c).alias("netloc"),
        U.url_path(c).alias("path"),
        U.url_extension(c).alias("ext"),
        U.url2filename(c).alias("name"),
    ).collect()
    for row in rows:
        parsed = urlparse(row.u)
        path = parsed.path if parsed.scheme or ";" not in row.u else row.path
        assert row.netloc == parsed.netloc, row.u
        assert row.path == path, row.u
        assert row.ext == posixpath.splitext(row.path)[1].lower(), row.u
        assert row.name == (row.netloc + row.path).replace("/", "_")


REFS = ["", "/x", "//h2/p", "?q=1", "#f", "a/b", "../c", "./d", "../../../e", "/../f", "/a/./b/../c"]
REFS += [".", "..", "g;x=1", "http://o/x", "mailto:a", "x?y=../z", "a//b", "/", "../", "a/..", "/a/b/.."]
BASES = ["http://h/a/b/c?q#f", "http://h", "https://u@h:80/x/", "http://h/a.html", "http://h/a/../b/c"]


def test_resolve_agrees_with_urljoin(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "b string, r string")
    for row in df.select("b", "r", U.resolve_url(F.col("b"), F.col("r")).alias("o")).collect():
        assert row.o == urljoin(row.b, row.r), (row.b, row.r)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_file_names(spark):
    assert one(spark, U.raw_filename(F.lit("http://h"))) == "_index.html"
    assert one(spark, U.raw_filename(F.lit("http://h/a/b/?q=1#x"))) == "_a_b_index.html"
    assert one(spark, U.raw_filename(F.lit("http://h/a.b/c"))) == "_a.b_c_index.html"
    assert one(spark, U.raw_filename(F.lit("http://h/a/c.pdf?v=2"))) == "_a_c.pdf"
    for size in (99, 100, 101, 250):
        name = ("é" * size)[:-5] + ".html"
        short = one(spark, U.abbreviate_filename(F.lit(name)))
        assert short == (name if size <= 100 else name[:47] + "(...)" + name[-48:])
        assert len(short) <= 100


def test_canonical_and_domains(spark):
    canonical = lambda u: one(spark, U.canonical_url(F.lit(u)))
    assert canonical("mailto:me@h") == "mailto:me@h"
    assert canonical("HTTP://Ex.COM?b=2&a-b=1&a=1&a#f") == "http://ex.com/?a=&a=1&a-b=1&b=2"
    domains = F.array(F.lit("Example.com"))
    inside = lambda h: one(spark, U.host_in_domains(F.lit(h), domains))
    assert inside("example.com") and inside("a.example.COM")
    assert not inside("badexample.com") and not inside("example.com:80") and not inside("")


def spelled(text, space="%20"):
    """The same by urllib: runs of escapes byte by byte, anything else quoted."""
    out = ""
    for piece in re.split("(%[0-9A-Fa-f]{2})", text):
        if re.fullmatch("%[0-9A-Fa-f]{2}", piece):
            byte = unquote_to_bytes(piece)
            out += quote(byte, safe="") if byte != b" " else space
        else:
            out += quote(piece, safe="!$&'()*+,;=:@/?[]#").replace("%20", space)
    return out


escaped = st.text("aZ0%%%25eEcCaA9/~+ é€|\"!*'[]=&?\n\U0001f600", max_size=14)


@quick
@given(st.lists(escaped, min_size=50, max_size=200))
def test_escapes_agree_with_urllib(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    for r in rows.select("t", U.normalized_escapes(F.col("t")).alias("path"), U.normalized_escapes(F.col("t"), "+").alias("query")).collect():
        assert (r.path, r.query) == ((None, None) if r.t is None else (spelled(r.t), spelled(r.t, "+"))), r.t


def test_canonical_escapes(spark):
    same = [("/%7Eu", "/~u"), ("/%c3%a9", "/é"), ("/a b", "/a%20b"), ("/?q=a+b", "/?q=a%20b"), ("/%é%2f~%zz?b=%&a=é+%7e", "/%25%C3%A9%2F~%25zz?a=%C3%A9+~&b=%25")]
    other = [("/a%2Fb", "/a/b"), ("/?a=1%262", "/?a=1&2"), ("/%", "/%25x"), ("/?a=%2B", "/?a=+")]
    rows = spark.createDataFrame([(f"http://h{a}", f"http://h{b}", k < len(same)) for k, (a, b) in enumerate(same + other)], "a string, b string, same boolean")
    for r in rows.select("*", U.canonical_url(F.col("a")).alias("x"), U.canonical_url(F.col("b")).alias("y")).collect():
        assert (r.x == r.y) == r.same, r


def test_scheme_and_synonyms(spark):
    assert one(spark, U.url_scheme_ok(F.lit("ftp://x")))
    assert not one(spark, U.url_scheme_ok(F.lit("HTTP://x")))
    assert not one(spark, U.url_scheme_ok(F.lit("mailto:x")))
    for ext, want in [("JPEG", ".jpg"), (".tff", ".tiff"), ("", ".txt"), ("log", ".txt"), ("x", ".x")]:
        assert one(spark, U.normalize_extension(F.lit(ext))) == want
