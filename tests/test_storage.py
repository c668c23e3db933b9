import pytest
import os

from pyspark.sql import functions as F

from pagemill.sinks.messages import read_results, send_results
from pagemill.sinks.paragraph_csv import write_paragraph_csv
from pagemill.sinks.raw_files import write_raw_files
from pagemill.sources.pages import bucket_pages, scan_pages
from pagemill.sources.paragraph_csv import scan_csv_files, scan_paragraph_csv
from pagemill.sources.raw_files import scan_raw_files
from pagemill.sources.specs import load_spec, overlay_specs, parse_patches, parse_specs, read_specs, split_spec_files, split_specs

ROWS = (
    "spider string, page_id long, xp_idx int, pos int, url string, content string, "
    "par_language string, page_language string, origin string, depth int"
)
NASTY = ['a;b', 'say "x"', "two\nlines\r\nthree", "back\\slash\\", " x ", "NA", "'", "é€"]


def rows(spark):
    data = [("123", i, 0, 0, f"http://h/{i}", c, "en", None, "//p", i) for i, c in enumerate(NASTY)]
    data += [("http_x=y", 1, 0, 0, "http://k/", "k", "", "de", "//td", 0)]
    return spark.createDataFrame(data, ROWS)


def test_paragraph_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_paragraph_csv(rows(spark), path)
    back = scan_paragraph_csv(spark, path)
    want = {(r.spider, r.url, r.content, r.par_language or None, r.page_language, r.origin, r.depth) for r in rows(spark).collect()}
    got = {(r.spider, r.url, r.content, r.par_language, r.page_language, r.origin, r.depth) for r in back.collect()}
    assert got == want
    assert sorted(x for x in os.listdir(path) if not x.startswith(".")) == ["_SUCCESS", "spider=123", "spider=http_x%3Dy"]


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "csv")
    broken = rows(spark).withColumn(
        "depth", F.when(F.col("page_id") == 3, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("depth"))
    )
    try:
        write_paragraph_csv(broken, path)
        raise AssertionError("should have failed")
    except Exception as error:
        assert "stop" in str(error)
    assert not os.path.exists(f"{path}/_SUCCESS")
    assert not [f for _, _, files in os.walk(path) for f in files if f.endswith(".csv")]


def test_loose_csv_files_keep_their_stem_and_others_are_ignored(spark, tmp_path):
    (tmp_path / "h_a.csv").write_text('url;content;par_language;page_language;origin;depth\nu;"a\nb";en;;//p;2\n')
    (tmp_path / "notes.txt").write_text("url;content\nx;y\n")
    got = scan_csv_files(spark, str(tmp_path)).collect()
    assert [(r.spider, r.content, r.page_language, r.depth) for r in got] == [("h_a", "a\nb", None, 2)]


def test_raw_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "raw")
    data = [("s", "_index.html", "http://h/", "é<p>"), ("s", "_x.css", "http://h/x.css", "p{}")]
    files = spark.createDataFrame(data, "spider string, filename string, url string, content string")
    write_raw_files(files, path)
    back = scan_raw_files(spark, path)
    assert [(r.spider, r.filename, r.content) for r in back.collect()] == [("s", "_index.html", "é<p>")]


def test_messages_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    data = [("c", True, "u", "f", 'x"\n;é'), (None, False, "u", "g", "")]
    df = spark.createDataFrame(data, "crawl string, raw boolean, url string, filename string, data string")
    send_results(df, path)
    assert sorted(read_results(spark, path).collect(), key=repr) == sorted(df.collect(), key=repr)


def test_spec_defaults_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "name": "a", "urls": ["http://h"],\n "unknown": 1}')
    spec = load_spec(spark, str(tmp_path / "a.json"))
    assert spec == load_spec(spark, '{"name": "a", "urls": ["http://h"]}')
    assert (spec.allowed_languages, spec.xpaths) == (["de", "en"], ["//p", "//td"])
    assert spec.keep_langdetect_errors is True and spec.pipelines == {} and spec.whitelist == []
    assert read_specs(spark, str(tmp_path)).count() == 1


def test_overlay_takes_only_filled_fields(spark):
    def specs(text):
        return parse_specs(spark.createDataFrame([(text,)], "body string"))

    def patches(text):
        return parse_patches(spark.createDataFrame([(text,)], "body string"))

    base = specs('{"name":"a","output":"o","urls":["u"],"pipelines":{"p":1},"parser":"P","parser_data":{"xpaths":["//h1"]}}')
    patch = patches('{"name":"a","output":"","urls":[],"blacklist":["b"],"pipelines":{"q":2}}')
    row = overlay_specs(base, patch).first()
    assert (row.output, row.urls, row.blacklist, row.pipelines, row.parser) == ("o", ["u"], ["b"], {"q": 2}, "P")
    assert row.parser_data.xpaths == ["//h1"]
    row = overlay_specs(base, patches('{"name":"a","parser_data":{"allowed_languages":["fr"]}}')).first()
    assert (row.parser_data.allowed_languages, row.parser_data.xpaths) == (["fr"], ["//p", "//td"])
    row = overlay_specs(base, patches('{"name":"a","parser_data":{}}')).first()
    assert row.parser_data.xpaths == ["//h1"]


def test_unreadable_and_several_specifications_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        load_spec(spark, '{"name": "a", oops')
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(f'{{"name": "{name}"}}')
    with pytest.raises(ValueError):
        load_spec(spark, str(tmp_path))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"name": "a", oops')
    with pytest.raises(Exception, match="oops|[Mm]alformed|FAILFAST|parse"):
        load_spec(spark, str(tmp_path / "bad" / "x.json"))


def test_pages_are_dealt_out_only_on_request(spark, sf_dir):
    path = f"{sf_dir}/pages.parquet"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(scan_pages(spark, path)) and "Exchange" in plan(scan_pages(spark, path, 5))
    assert scan_pages(spark, path, 5).exceptAll(scan_pages(spark, path)).count() == 0


def test_bucketed_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table = bucket_pages(pages, "bucketed_pages_storage", 8)
    assert table.exceptAll(pages).count() == 0 and table.count() == pages.count()


def test_what_is_no_specification_is_rejected_with_its_reason(spark, tmp_path):
    bodies = {
        '{"name": "a", oops': "not JSON", '{"name": "a"': "not JSON", "[1]": "not an object", "3": "not an object", "null": "not an object",
        '{"name": "a", "urls": "x"}': "field of another type", '{"name": "a", "pipelines": {"p": "high"}}': "field of another type",
        '{"urls": []}': "no name", '{"name": ""}': "no name", " ": "empty", None: "empty",
        '{"name": "b", "more": 1}': None, ' {"name": "c"} ': None,
    }
    df = spark.createDataFrame([(k, b, "x") for k, b in enumerate(bodies)], "k int, body string, reason string").drop("reason")
    split = split_specs(df)
    assert {r.body: r.reason for r in split.rejected.collect()} == {b: r for b, r in bodies.items() if r}
    assert sorted((r.k, r.name) for r in split.accepted.collect()) == [(11, "b"), (12, "c")]
    (tmp_path / "good.json").write_text('{\n "name": "a",\n "urls": ["http://h"]\n}')
    (tmp_path / "bad.json").write_text('{"name": "a", oops')
    files = split_spec_files(spark, str(tmp_path))
    assert [(r.name, r.file.endswith("good.json")) for r in files.accepted.collect()] == [("a", True)]
    assert [(r.reason, r.file.endswith("bad.json")) for r in files.rejected.collect()] == [("not JSON", True)]
    assert [r.name for r in read_specs(spark, str(tmp_path)).collect()] == ["a"]
