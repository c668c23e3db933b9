import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators import export, numbering as N


def test_number_rows_equals_window_on_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") * 37 % 1000).alias("seq"),
        F.col("id").alias("tie"),
    )
    window = Window.partitionBy("g").orderBy("seq", "tie")
    want = df.withColumn("rn", F.row_number().over(window).cast("long"))
    got = N.number_rows(df, ["g"], "seq", ("tie",), totals={"all": F.lit(1)})
    assert got.drop("all").exceptAll(want).count() == 0 and got.count() == 3000
    sizes = {r.g: r.all for r in got.select("g", "all").distinct().collect()}
    assert sizes == {r.g: r["count"] for r in df.groupBy("g").count().collect()}


def test_sparse_ids_of_one_group_are_spread(spark):
    df = spark.range(5000).select(F.lit("s").alias("g"), F.xxhash64("id").alias("seq"))
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("seq")).cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = N.number_rows(df, ["g"], "seq")
        assert got.exceptAll(want).count() == 0 and got.count() == 5000
        stored = spark.read.parquet(*got.inputFiles())
        ranges = [r["count"] for r in stored.groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 8 and max(ranges) < 1500


def test_even_chunk_equals_array_split(spark):
    for n, k in [(1, 1), (5, 5), (23, 5), (7, 3), (3, 5), (100, 7), (64, 8)]:
        df = spark.range(1, n + 1).select(N.even_chunk(F.col("id"), F.lit(n), F.lit(k)).alias("c"), "id")
        got = [r.c for r in df.orderBy("id").collect()]
        want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
        assert got == want, (n, k)


def test_name_collisions(spark):
    long = "http://h/" + "a" * 60 + "{}" + "b" * 60 + ".html"
    urls = [(i, long.format(i % 2)) for i in range(3)] + [(10, "http://h/x?1"), (11, "http://h/x?2"), (12, "http://h/y.css")]
    df = spark.createDataFrame([("s", i, u) for i, u in urls], "spider string, page_id long, url string")
    names = {r.page_id: r.filename for r in N.raw_file_names(df).collect()}
    short = "_" + "a" * 46 + "(...)" + "b" * 43 + ".html"
    assert names == {
        0: short,
        1: short[:-5] + " (1).html",
        2: short[:-5] + " (2).html",
        11: "_x_index.html",
        12: "_y.css",
    }


ROWS = "spider string, page_id long, xp_idx int, pos int, url string, content string, par_language string, page_language string, origin string, depth int"


def test_messages_cover_all_rows_in_order(spark):
    data = [("s", i, 0, 0, f"http://h/{i}", "x" * (i % 50), None, None, "//p", 1) for i in range(200)]
    data += [("t", 1, 0, 0, "http://t/", 'a;"b"\nc', "en", "en", "//p", 0)]
    df = spark.createDataFrame(data, ROWS)
    sizes = {r.spider: r for r in export.result_size(df).collect()}
    whole = {r.url: r for r in export.paragraph_messages(df, F.lit("c")).collect()}
    assert whole["t"].data == export.CSV_HEADER + '\nhttp://t/;"a;""b""\nc";en;en;//p;0\n'
    assert len(whole["s"].data.encode()) == sizes["s"].n_bytes and whole["s"].filename == "s"
    parts = export.paragraph_messages(df.filter("spider = 's'"), F.lit("c"), 1500).collect()
    k = -(-sizes["s"].n_bytes // 1500)
    assert sorted(p.filename for p in parts) == sorted(f"s_part{i + 1}_{k}" for i in range(k))
    ordered = sorted(parts, key=lambda p: int(p.filename.split("_")[1][4:]))
    lines = [x for p in ordered for x in p.data.splitlines()[1:]]
    assert lines == whole["s"].data.splitlines()[1:]


def test_small_result_is_one_message_named_after_the_spider(spark):
    df = spark.createDataFrame([("s", 1, 0, 0, "http://h/", "x", None, None, "//p", 1)], ROWS)
    (row,) = export.paragraph_messages(df, F.lit("c")).collect()
    assert (row.url, row.filename) == ("s", "s")


def test_spiders_and_chunks_without_rows_have_the_header(spark):
    head = export.CSV_HEADER + "\n"
    df = spark.createDataFrame([("s", i, 0, 0, "http://h/", "x" * 500, None, None, "//p", 1) for i in range(2)], ROWS)
    seeds = spark.createDataFrame([("s",), ("none",), ("none",)], "spider string")
    got = {r.filename: r.data for r in export.paragraph_messages(df, F.lit("c"), 250, spiders=seeds).collect()}
    assert set(got) == {"none", *(f"s_part{i}_5" for i in range(1, 6))}
    assert got["none"] == head and [got[f"s_part{i}_5"] == head for i in range(1, 6)] == [False, False, True, True, True]
    nothing = export.paragraph_messages(df.limit(0), F.lit("c"), spiders=seeds).collect()
    assert sorted((r.filename, r.data) for r in nothing) == [("none", head), ("s", head)]
