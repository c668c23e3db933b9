import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import text as T
from pagemill.operators.links import extract_links
from pagemill.operators.numbering import first_link_per_page
from pagemill.operators.paragraphs import extract_paragraphs, line_paragraphs, page_text, parse_pages
from pagemill.functions.elements import intervals, parse_selector
from pagemill.operators.selectors import html_elements


def pages(spark, *texts):
    rows = [(i, f"http://h/d/{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def paragraphs(spark, html, xpaths=("//p", "//td")):
    rows = extract_paragraphs(pages(spark, html), list(xpaths)).orderBy("xp_idx", "pos").collect()
    return [(r.origin, r.content) for r in rows]


def test_text_is_joined_and_not_trimmed(spark):
    assert paragraphs(spark, "<p> a <b>b<i>c</i></b>\n d </p>") == [("//p", " a bc\n d ")]


def test_paragraph_in_cell_comes_twice_in_xpath_order(spark):
    html = "<table><tr><td>x <p>in</p> y</td><td>z</td></tr></table><p>out</p>"
    assert paragraphs(spark, html) == [
        ("//p", "in"),
        ("//p", "out"),
        ("//td", "x in y"),
        ("//td", "z"),
    ]


def test_nested_elements_keep_the_outer_text(spark):
    html = "<div>outer <div class='x'>inner <DIV>deep</DIV></div> tail</div><div>next</div><div>open <p>end"
    expected = ["outer inner deep tail", "inner deep", "deep", "next", "open end"]
    assert paragraphs(spark, html, ["//div"]) == [("//div", t) for t in expected]
    assert paragraphs(spark, "<span>a<span>b</span></span></span><span>c", ["//span"]) == [("//span", t) for t in ("ab", "b", "c")]


def test_broken_markup(spark):
    html = "<P class='a'>one<b>two<br><p>three<div>no</div><pre>no</pre><p>four<!-- <p>no --> end <b"
    assert paragraphs(spark, html, ["//p"]) == [("//p", "onetwo"), ("//p", "three"), ("//p", "four end ")]
    assert paragraphs(spark, '<script>var t="<p>no</p>";</script><style>p{}</style><p>a<script>x', ["//p"]) == [
        ("//p", "a")
    ]


def test_entities_are_decoded_once(spark):
    html = "<p>&amp;lt; &lt;b&gt; &eacute;&#233;&#xE9; &#128512; &bogus; &amp &#0; a & b &apos;</p>"
    assert paragraphs(spark, html, ["//p"]) == [
        ("//p", "&lt; <b> ééé \U0001f600 &bogus; &amp � a & b '")
    ]


BLANKS = ["", " ", "\t\n\x0b\x0c\r", " ", "\x1c\x1d\x1e\x1f", "\u0085", " 　", "a", " . ", "​"]


def test_blank_means_what_strip_means(spark):
    df = spark.createDataFrame([(b,) for b in BLANKS], "t string")
    for row in df.select("t", T.has_text(F.col("t")).alias("keep")).collect():
        assert row.keep == bool(row.t.strip()), repr(row.t)


def test_lines_agree_with_splitlines(spark):
    text = "a\r\nb\rc\n\nd\x0be\x0cf\u0085g h\x1ci j\n"
    rows = line_paragraphs(spark.createDataFrame([(1, text)], "k int, text string"), "text")
    assert [r.content for r in rows.orderBy("pos").collect()] == [x for x in text.splitlines() if x]


def test_decode_body(spark):
    bodies = ["é€".encode(), "é".encode("latin-1"), b"", b"plain"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary")
    got = [r.t for r in df.orderBy("i").select(T.decode_body(F.col("b")).alias("t")).collect()]
    assert got == ["é€", "é", "", "plain"]
    kept = spark.range(1).select(T.encode_text(F.lit("aé€"), "iso-8859-1").alias("b")).first().b
    assert bytes(kept) == "aé".encode("latin-1")


def test_page_text_keeps_order(spark):
    parsed = parse_pages(pages(spark, "<td>c</td><p>a</p><p>b</p>", "<div>none</div>"))
    assert [r.page_text for r in page_text(parsed).orderBy("page_id").collect()] == ["a b c", ""]


LINKS = """<a href='x?a=1&amp;b=2'>one <b>two</b></a><!-- <a href="/no"> --><A HREF=/y class=q>y</A>
<a name=n>no</a><area href="z"><a data-href="/no" href=" x?a=1&b=2 ">again</a><a href="#f">f</a>"""


def test_links(spark):
    got = extract_links(pages(spark, LINKS)).orderBy("pos").collect()
    assert [(r.url, r.text) for r in got] == [
        ("http://h/d/x?a=1&b=2", "one two"),
        ("http://h/y", "y"),
        ("http://h/d/z", ""),
        ("http://h/d/0#f", "f"),
    ]
    every = extract_links(pages(spark, LINKS), unique=False)
    assert every.count() == 5
    assert sorted(first_link_per_page(every).collect()) == sorted(extract_links(pages(spark, LINKS)).collect())


def test_base_tag(spark):
    html = '<head><base href="/other/"></head><a href="x">x</a>'
    assert extract_links(pages(spark, html)).first().url == "http://h/other/x"


def test_selectors(spark):
    html = """<div class=box><div id=in><p>a</p></div><ul><li>1<ul><li>2</li></ul></li><li>3</ul></div>
    <p class="box">b &amp; c<img src=i><p>d"""
    paths = ["//div[@class='box']//p", "//li", "//*[@class='box']", "//div/p", "//p[@class]"]
    got = {}
    for row in html_elements(pages(spark, html), paths).orderBy("xp_idx", "pos").collect():
        got.setdefault(row.origin, []).append(row.content.strip())
    assert got["//div[@class='box']//p"] == ["a"]
    assert got["//li"] == ["12", "2", "3"]
    assert got["//div/p"] == ["a"] and got["//p[@class]"] == ["b & c"]
    assert got["//*[@class='box']"] == ["a123", "b & c"]


def test_both_ways_decode_the_same_references(spark):
    html = "<p>&amp &amp;&amp x&copy; &copy &bogus; &notit; &#38;lt; &#60;b> &#x80; &#0; &#11; &check; & &</p>"
    df = pages(spark, html)
    native = extract_paragraphs(df, ["//p"]).select("content").first().content
    assert html_elements(df, ["//p"]).select("content").first().content == native
    assert native.startswith("&amp &&amp x© &copy &bogus; &notit; &lt; <b>")


def test_selector_grammar():
    assert parse_selector("//a[@b]/c") == [(True, "a", (("b", None),)), (False, "c", ())]
    for bad in ("p", "//p[1]", "//p/text()", ""):
        with pytest.raises(ValueError):
            parse_selector(bad)


def test_nested_cells_and_items_keep_their_whole_text(spark):
    html = "<table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d<th>e</table><p>f"
    assert paragraphs(spark, html, ["//td", "//table", "//th"]) == [("//td", t) for t in ("abc", "b", "d")] + [("//table", t) for t in ("abcde", "b")] + [("//th", "e")]
    html = "<ul><li>1<ol><li>2<li>3</ol>4<li>5</ul><dl><dt>a<dd>b<dl><dt>c</dl>d<dt>e</dl>"
    assert paragraphs(spark, html, ["//li", "//dt", "//dd"]) == [("//li", t) for t in ("1234", "2", "3", "5")] + [("//dt", t) for t in "ace"] + [("//dd", "bcd")]


def test_broken_nesting(spark):
    html = "<div><p>a<b>b</p>c</b></div>d</div><p>e<h2>f<h3>g</h2>h<div>i<li>j<li>k</div>l"
    got = paragraphs(spark, html, ["//p", "//h2", "//h3", "//li", "//b"])
    assert got == [("//p", "ab"), ("//p", "e"), ("//h2", "f"), ("//h3", "g"), ("//li", "j"), ("//li", "k"), ("//b", "b")]


def test_selector_steps():
    tags = ["<div class=x>", "<p>", "<a href='1&amp;2'>", "</a>", "</p>", "<div>", "<p id=P>", "</p>", "</div>", "</div>", "<p>"]

    def starts(xpath):
        return intervals([t if t[1] != "/" else t[:-1] for t in tags], [parse_selector(xpath)])[2::4]

    assert starts("//p") == [1, 6, 10] and starts("//div//p") == [1, 6] and starts("//div/div/p") == [6]
    assert starts("//div[@class='x']/p") == [1] and starts("//div[@class]//*") == [1, 2, 5, 6]
    assert starts("/div/p") == [1] and starts("/p") == [10] and starts("//a[@href='1&2']") == [2] and starts("//p[@id]/a") == []


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "td", "span", "table", "ul"])
def test_time_is_linear_in_the_page(tag):
    started = time.perf_counter()
    for tags in ([f"<{tag}"] * 100_000, [f"<{tag}", "<p"] * 50_000, [f"<{tag}"] * 50_000 + [f"</{tag}"] * 50_000):
        found = intervals(tags, [parse_selector(f"//{tag}"), parse_selector("//p")])
        assert len(found) >= 4 * 50_000
    assert time.perf_counter() - started < 10


def test_deep_pages(spark):
    df = pages(spark, "<div>x" * 1500 + "<p>end", "<b>" * 20000 + "<p>end", None)
    assert [r.content for r in extract_paragraphs(df, ["//p"]).orderBy("page_id").collect()] == ["end", "end"]
    nested = extract_paragraphs(df, ["//div"]).orderBy("pos").collect()
    assert [len(r.content) for r in nested] == [n + 3 for n in range(1500, 0, -1)]
