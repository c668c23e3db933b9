from pyspark.sql import functions as F

from pagemill.operators import export
from pagemill.operators.paragraphs import extract_paragraphs
from pagemill.plans.catalog import QUERIES
from pagemill.sinks.messages import read_results
from pagemill.streaming import crawls
from pagemill.streaming import results as R
from pagemill.streaming import tasks as T

TASKS = "msg_id long, ts string, redelivered boolean, body string"


def task_file(spark, path, rows):
    T.send_tasks(spark.createDataFrame(rows, TASKS).withColumn("ts", F.col("ts").cast("timestamp")), path)


def test_repeats_and_redeliveries_are_dropped_across_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    task_file(spark, src, [(1, "2024-01-01", False, "a"), (1, "2024-01-01", False, "a"), (2, "2024-01-01", True, "b")])
    run = lambda: R.run_to_parquet(T.drop_redelivered(T.stream_tasks(spark, src)), out, mark)
    run()
    task_file(spark, src, [(1, "2024-01-02", False, "a"), (3, "2024-01-02", False, "c"), (2, "2024-01-02", True, "b")])
    run()
    got = sorted((r.msg_id, r.body) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a"), (3, "c")]  # the lost first delivery of 2 stays lost


def test_old_first_deliveries_are_not_late(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k, day in ((1, "2024-03-01"), (3, "2024-03-02"), (4, "2024-03-20"), (2, "2024-01-01")):
        task_file(spark, src, [(k, day, False, "x")])
        R.run_to_parquet(T.drop_redelivered(T.stream_tasks(spark, src)), out, mark)
    assert sorted(r.msg_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_stream_equals_batch_and_replayed_batches_count_once(spark, sf_dir, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.repartition(3).write.parquet(src)
    stream = R.stream_pages(spark, src).withColumn("content_type", F.lit("text/html"))
    R.run_to_parquet(R.stream_parse(stream, ["//p"]), out, mark)
    got, want = spark.read.parquet(out), extract_paragraphs(pages, ["//p"])
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()

    def to_messages(batch):
        none = F.lit(None).cast("string")
        rows = batch.select("*", F.lit("s").alias("spider"), none.alias("par_language"), none.alias("page_language"), F.lit(0).alias("depth"))
        return export.paragraph_messages(rows, F.lit("c"))

    sent = str(tmp_path / "sent")
    R.stream_results(R.stream_parse(stream, ["//p"]), sent, str(tmp_path / "m1"), to_messages)
    first = sorted(read_results(spark, f"{sent}/*").collect(), key=repr)
    assert len(first) == 3
    # As after a crash before the commit: the same batches run again, into the same folders.
    R.stream_results(R.stream_parse(stream, ["//p"]), sent, str(tmp_path / "m2"), to_messages)
    again = read_results(spark, f"{sent}/*").collect()
    assert len(again) == 3 and sum(len(m.data) for m in again) == sum(len(m.data) for m in first)


def test_tasks_drive_crawls(spark, tmp_path):
    """Two batches of tasks: rows of good ones, reasons for the others, and the same again when the batches are replayed."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages = spark.createDataFrame(
        [(1, "http://h.org/", "<p>start<a href=/a>a</a><a href=/no>no</a>"), (2, "http://h.org/a", "<p>second"), (3, "http://h.org/no", "<p>third"), (4, "http://i.org/", "<p>other")],
        "page_id long, url string, html string",
    )
    body = '{"name":"%s","urls":["http://h.org/"],"parser":"parsers.ParagraphParser","parser_data":{"allowed_languages":["disabled"]%s}%s}'
    raw = '{"name":"r","urls":["http://i.org/"],"parser":"parsers.RawParser"}'
    first = [(1, "2024-01-01", False, body % ("a", "", ',"blacklist":["/no$"]')), (2, "2024-01-01", False, "{oops"), (3, "2024-01-01", True, body % ("lost", "", ""))]
    first += [(4, "2024-01-01", False, body % ("b", "", "")), (5, "2024-01-01", False, body % ("b", ',"xpaths":["//a"]', "")), (6, "2024-01-01", False, raw)]
    task_file(spark, src, first)
    spark.createDataFrame([("no message at all",)], "value string").write.mode("append").text(src)
    tasks = lambda: T.stream_tasks(spark, src, 1000)
    crawls.stream_crawls(spark, tasks(), pages, out, str(tmp_path / "m"))

    def rows():
        found = spark.read.parquet(f"{out}/paragraphs").collect()
        refused = spark.read.parquet(f"{out}/rejected").collect()
        files = spark.read.parquet(f"{out}/raw").collect()
        return (
            sorted((r.spec, r.url, r.content, r.depth) for r in found),
            sorted((r.msg_id or 0, r.reason) for r in refused),
            [(r.spec, r.spider, r.filename) for r in files],
        )

    start = [("http://h.org/", "startano", 0), ("http://h.org/a", "second", 1)]
    items, refused, files = rows()
    assert items == sorted([("a", *r) for r in start] + [("b", "http://h.org/", t, 0) for t in ("a", "no")])
    assert refused == [(0, "malformed message"), (2, "not JSON"), (4, "superseded")]
    assert files == [("r", "i.org_", "_index.html")]
    task_file(spark, src, [(7, "2024-01-02", False, body % ("c", "", "")), (1, "2024-01-02", False, body % ("a", "", "")), (8, "2024-01-02", False, '{"name":"d"}')])
    crawls.stream_crawls(spark, tasks(), pages, out, str(tmp_path / "m"))
    items, refused, _ = rows()
    assert [r for r in items if r[0] == "c"] == sorted([("c", *r) for r in start] + [("c", "http://h.org/no", "third", 1)])
    assert (8, "unknown parser") in refused and len([r for r in items if r[0] == "a"]) == 2


def test_streamed_results_do_not_depend_on_the_files_of_the_table(spark, tmp_path):
    """A table of pages that is one file and one that is a folder of files give the same rows and messages."""
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>text {i}</p><td>cell {i}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(4).write.parquet(str(tmp_path / "many/pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "one/pages.parquet")
    for name in ("stream_parse", "stream_results"):
        one, many = (sorted(QUERIES[name](spark, str(tmp_path / d)).collect(), key=repr) for d in ("one", "many"))
        assert one and one == many
