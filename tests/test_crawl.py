import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import language as L
from pagemill.operators.extension import ParserRegistry, run_finalizers, run_pipelines
from pagemill.operators.paragraphs import parse_pages
from pagemill.plans import crawl as C
from pagemill.plans import fixtures as fx
from pagemill.sources.paragraph_csv import csv_spiders, scan_paragraph_csv
from pagemill.sources.raw_files import scan_raw_files
from pagemill.sources.specs import load_spec, parse_specs

EN = "the house is on the hill and there is nothing that they are doing with this"
FR = "la maison est dans la rue avec les enfants qui sont pour une autre et des"
SITE = [
    ("http://h.org/", f"<p>{EN}</p><a href='/a'>a</a><a href='/no/x'>x</a><a href='http://sub.h.org/s'>s</a><a href='/f.zip'>z</a>"),
    ("http://h.org/a", f"<p>{FR} {FR}</p><td>{EN}</td><a href='b#top'>b</a>"),
    ("http://h.org/b", "<p>123</p><a href='/'>home</a>"),
    ("http://h.org/no/x", f"<p>{EN}</p>"),
    ("http://sub.h.org/s", f"<p>{EN}</p><a href='http://h.org/deep'>d</a>"),
    ("http://h.org/deep", f"<p>{EN} again</p>"),
    ("http://else.org/", f"<p>{EN}</p>"),
]


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(SITE)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.train(fx.documents(spark, sf_dir), fx.MODEL_LANGUAGES)


def spec(spark, **changes):
    body = {
        "name": "c",
        "urls": ["http://h.org/", "http://h.org/"],
        "blacklist": ["/no/"],
        "parser": "parsers.ParagraphParser",
        "pipelines": {"pipelines.Paragraph2CsvPipeline": 300},
        "finalizers": {"pipelines.RemoteCrawlFinalizer": {}},
    }
    return load_spec(spark, json.dumps({**body, **changes}))


def test_paragraph_crawl(spark, site, model, tmp_path):
    result = C.run_crawl(spark, spec(spark), site, model)
    depths = {r.url: r.depth for r in result.visits.collect()}
    assert depths == {"http://h.org/": 0, "http://h.org/a": 1, "http://sub.h.org/s": 1, "http://h.org/b": 2, "http://h.org/deep": 2}
    items = {(r.url, r.content, r.page_language) for r in result.items.collect()}
    assert items == {
        ("http://h.org/", EN, "en"),
        ("http://h.org/b", "123", None),
        ("http://h.org/deep", f"{EN} again", "en"),
    }
    C.write_items(result, str(tmp_path / "out"))
    assert scan_paragraph_csv(spark, str(tmp_path / "out")).count() == 3
    (name, messages), = C.finalize(result).items()
    row = messages.first()
    assert name == "pipelines.RemoteCrawlFinalizer" and messages.count() == 1
    assert (row.crawl, row.raw, row.url) == ("c", False, "h.org_") and row.data.count("\n") == 4


def test_strict_errors_and_any(spark, site, model):
    data = {"allowed_languages": ["any"], "keep_langdetect_errors": False}
    items = C.run_crawl(spark, spec(spark, parser_data=data), site, model).items.collect()
    assert {r.url for r in items} == {"http://h.org/", "http://h.org/a", "http://h.org/deep"}
    assert all(r.page_language.startswith("[") for r in items)


def test_disabled_needs_no_model_and_nested_selectors_work(spark, site):
    data = {"allowed_languages": ["disabled"], "xpaths": ["//p", "//a[@href='/a']"]}
    items = C.run_crawl(spark, spec(spark, parser_data=data), site).items.collect()
    assert [r.content for r in items if r.origin != "//p"] == ["a"]
    assert len([r for r in items if r.origin == "//p"]) == 4


def test_a_spider_without_text_leaves_its_header(spark, site, tmp_path):
    off = spec(spark, urls=["http://h.org/", "http://nobody.org/"], parser_data={"allowed_languages": ["disabled"]})
    result = C.run_crawl(spark, off, site)
    C.write_items(result, str(tmp_path / "out"))
    assert {r.spider for r in csv_spiders(spark, str(tmp_path / "out")).collect()} == {"h.org_", "nobody.org_"}
    assert {r.spider for r in scan_paragraph_csv(spark, str(tmp_path / "out")).collect()} == {"h.org_"}
    (messages,) = C.finalize(result).values()
    assert {r.url: r.data.count("\n") for r in messages.collect()} == {"h.org_": 6, "nobody.org_": 1}


def test_a_selector_changes_no_rows_of_another(spark, site):
    pages = site.withColumn("html", F.concat("html", F.lit("<ul><li>one<ul><li>two</ul></ul><div>a<div>b</div></div>")))
    plain, more = ["//div", "//li", "//p"], ["//div", "//a[@href='/a']", "//li", "//p"]

    def rows(paths):
        found = parse_pages(pages, paths).selectExpr("page_id", "inline(paragraphs)").collect()
        return {(r.page_id, r.origin, r.pos, r.content) for r in found}, [r.xp_idx for r in found if r.origin == "//p"]

    (few, at), (many, moved) = rows(plain), rows(more)
    assert few == {r for r in many if r[1] in plain} and {r[1] for r in many} == set(more)
    assert set(at) == {2} and set(moved) == {3}


def test_raw_crawl(spark, site, tmp_path):
    raw = spec(spark, parser="parsers.RawParser", pipelines={"pipelines.Raw2FilePipeline": 300}, parser_data={"allowed_languages": ["any"]})
    result = C.run_crawl(spark, raw, site)
    C.write_items(result, str(tmp_path / "raw"))
    files = {r.filename: r.url for r in scan_raw_files(spark, str(tmp_path / "raw")).collect()}
    assert files == {
        "_index.html": "http://h.org/", "_a_index.html": "http://h.org/a", "_b_index.html": "http://h.org/b", "_deep_index.html": "http://h.org/deep",
    }
    (messages,) = C.finalize(result).values()
    assert {r.filename for r in messages.filter("raw").collect()} == set(files)


def test_misfits_are_refused(spark, site):
    wrong = spec(spark, parser="parsers.RawParser")
    with pytest.raises(ValueError):
        C.write_items(C.run_crawl(spark, wrong, site))
    with pytest.raises(ValueError):
        C.run_crawl(spark, spec(spark), site)
    with pytest.raises(ValueError):
        C.run_crawl(spark, spec(spark, parser="parsers.Other"), site)


def test_extension_surface(spark):
    df = spark.createDataFrame([(1, "TEXT/HTML; x"), (2, "text/plain"), (3, "image/png"), (4, None)], "page_id long, content_type string")
    registry = ParserRegistry()
    registry.register("text/html", lambda d, data: d.select("page_id", F.lit(data["k"]).alias("v")), ["csv"])
    registry.register("text/", lambda d, data: d.select("page_id", F.lit(1).alias("w")))
    rows = {r.page_id: (r.v, r.w) for r in registry.parse(df, {"k": "x"}).collect()}
    assert rows == {1: ("x", None), 2: (None, 1)}
    assert registry.accepted("text/html", "csv") and not registry.accepted("text/html", "raw")
    assert registry.accepted("text/", "raw")
    add, double = (lambda d: d.withColumn("page_id", F.col("page_id") + 1)), (lambda d: d.withColumn("page_id", F.col("page_id") * 2))
    steps = {"add": add, "double": double}
    assert run_pipelines(df, {"double": 9, "add": 1}, steps).agg(F.sum("page_id")).first()[0] == 28
    done = run_finalizers(df, "spec", {"f": {"n": "2"}}, {"f": lambda d, s, data: d.limit(int(data["n"]))})
    assert done["f"].count() == 2


def test_many_specifications_equal_each_alone(spark, site, model):
    changes = [
        {"parser_data": {"allowed_languages": ["disabled"]}},
        {"parser_data": {"allowed_languages": ["any"], "xpaths": ["//p", "//a[@href='/a']"]}},
        {"whitelist": ["/a$"], "parser_data": {"allowed_languages": ["any"], "xpaths": ["//p", "//a[@href='/a']"]}},
        {"urls": ["http://h.org/", "http://nobody.org/"], "parser": "parsers.RawParser"},
        {"parser": "parsers.Unknown"},
        {"parser_data": {"allowed_languages": ["any"], "xpaths": ["p[1]"]}},
    ]
    base = {"name": "x", "urls": ["http://h.org/"], "parser": "parsers.ParagraphParser"}
    bodies = [json.dumps({**base, **c, "name": f"s{k}"}) for k, c in enumerate(changes)]
    specs = parse_specs(spark.createDataFrame([(b,) for b in bodies], "body string"))
    done = C.run_crawls(spark, specs, site, model)
    assert {(r.name, r.reason) for r in done.rejected.collect()} == {("s4", "unknown parser"), ("s5", "unsupported selector")}
    for k in range(4):
        alone = C.run_crawl(spark, load_spec(spark, bodies[k]), site, model)
        own = done.visits.where(f"spec = 's{k}'")
        assert {tuple(r) for r in alone.visits.select("spider", "page_id", "depth").collect()} == {tuple(r) for r in own.select("spider", "page_id", "depth").collect()}
        items, columns = (done.raw, ("spider", "filename", "content")) if k == 3 else (done.paragraphs, ("spider", "page_id", "xp_idx", "pos", "content", "par_language", "page_language"))
        got = sorted((tuple(r) for r in items.where(f"spec = 's{k}'").select(*columns).collect()), key=repr)
        assert got and got == sorted((tuple(r) for r in alone.items.select(*columns).collect()), key=repr)
