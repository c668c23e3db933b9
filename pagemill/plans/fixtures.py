"""Inputs that Spark derives from the given tables, one row or more per row of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import url2filename, url_netloc, url_scheme
from pagemill.sources.pages import scan_pages

MODEL_LANGUAGES = ("de", "en", "es", "fr")
# Link forms tried against every page URL.
REFERENCES = (
    "",
    "/x",
    "//other.example.org/p",
    "?q=1",
    "#f",
    "a/b",
    "../c",
    "./d",
    "../../../e",
    "/../f",
    "/a/./b/../c",
    ".",
    "..",
    "g;x=1",
    "http://o.example.org/x",
    "mailto:a@example.org",
    "x?y=../z",
    "a//b",
)
# File extensions tried in all spellings.
EXTENSIONS = ("jpeg", ".TFF", "tif", ".htm", "", "log", "PDF", ".html", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table is one small file, so its rows are dealt to all cores."""
    return scan_pages(spark, f"{sf_dir}/pages.parquet", spark.sparkContext.defaultParallelism)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rows.repartition(spark.sparkContext.defaultParallelism, "doc_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a content type header, a depth and, now and then, a request failure."""
    kind = F.col("page_id") % 10
    return pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.when(kind == 0, "application/pdf")
        .when(kind == 1, "Text/HTML; charset=utf-8")
        .when(kind == 2, "image/png")
        .otherwise("text/html")
        .alias("content_type"),
        F.col("html").alias("body"),
        (F.col("page_id") % 7).cast("int").alias("depth"),
        F.when(F.col("page_id") % 17 == 5, "TimeoutError").alias("failure"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each host, its first page as the start URL of a spider; hosts of two pages stay offsite."""
    hosts = (
        pages(spark, sf_dir)
        .select("page_id", "url", url_netloc(F.col("url")).alias("domain"))
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "url")).alias("first"))
        .filter("n <> 2")
    )
    return hosts.select(
        F.concat(F.lit("crawl-"), F.col("first.page_id").cast("string")).alias("spec"),
        F.col("first.url").alias("url"),
        "domain",
        url2filename(F.col("first.url")).alias("spider"),
    )


def td_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, the paragraphs of every fifth one turned to table cells; with depth."""
    cells = F.replace(
        F.replace(F.col("html"), F.lit("<p>"), F.lit("<td>")), F.lit("</p>"), F.lit("</td>")
    )
    return pages(spark, sf_dir).select(
        "page_id",
        "url",
        (F.col("page_id") % 7).cast("int").alias("depth"),
        F.when(F.col("page_id") % 5 == 0, cells).otherwise(F.col("html")).alias("html"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links per page to other pages, as URLs."""
    ids = pages(spark, sf_dir).select("page_id", "url")
    n = F.lit(ids.count())
    targets = ids.select(
        F.col("url").alias("src_url"),
        F.explode(
            F.array((F.col("page_id") * 7 + 3) % n, (F.col("page_id") * 11 + 5) % n)
        ).alias("page_id"),
    )
    return targets.join(ids, "page_id").select("src_url", "url")


def crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spider per registered domain, started at its first page."""
    return (
        pages(spark, sf_dir)
        .select(
            "page_id",
            "url",
            F.regexp_extract(url_netloc(F.col("url")), r"[^.]+\.[^.]+$", 0).alias("domain"),
        )
        .groupBy("domain")
        .agg(F.min(F.struct("page_id", "url")).alias("first"))
        .select(F.col("domain").alias("spider"), "domain", F.col("first.url").alias("url"))
    )


def long_url() -> Column:
    return F.concat(
        F.lit("http://"),
        url_netloc(F.col("url")),
        F.lit("/" + "section/" * 8),
        (F.col("page_id") % 3).cast("string"),
        F.lit("/" + "item-" * 12 + "page.html"),
    )


def colliding_url() -> Column:
    return F.concat(
        F.lit("http://"),
        url_netloc(F.col("url")),
        F.lit("/doc"),
        (F.col("page_id") % 3).cast("string"),
        F.lit("?v="),
        F.col("page_id").cast("string"),
    )


def long_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", long_url().alias("url"))


def colliding_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", colliding_url().alias("url"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose URL is, in turn, long, colliding, or the page's own."""
    kind = F.col("page_id") % 3
    url = F.when(kind == 0, long_url()).when(kind == 1, colliding_url()).otherwise(F.col("url"))
    return responses(spark, sf_dir).withColumn("url", url)


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight URLs per page: its own and forms that are hard to take apart."""
    host = url_netloc(F.col("url"))
    lit = F.lit
    forms = [
        F.col("url"),
        F.concat(lit("http://user:pw@"), host, lit(":8080/a;b?x=1#f")),
        F.concat(
            url_scheme(F.col("url")), lit("://"), host, lit("/file-"), F.col("page_id").cast("string"), lit(".tar.GZ")
        ),
        F.concat(lit("mailto:me@"), host),
        F.lit("javascript:void(0)"),
        F.concat(lit("https://"), F.upper(host)),
        F.concat(lit("http://sub."), host, lit("/a b|c/?z=2&a=1&b&a-b=3&z=1#top")),
        F.concat(lit("ftp://"), host, lit("/dir/.bashrc")),
    ]
    return pages(spark, sf_dir).select("page_id", F.posexplode(F.array(*forms)).alias("form", "url"))


def body_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text as bytes: UTF-8 for even ids, Latin-1 for odd ones."""
    latin = F.regexp_replace(F.col("html"), r"[^\x00-\xff]", "")
    return pages(spark, sf_dir).select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.encode(F.col("html"), "utf-8"))
        .otherwise(F.encode(latin, "iso-8859-1"))
        .alias("body"),
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each seed host: nothing under /de/ but what starts with /de/1, no pages by number but those
    under /en/1, nothing that ends with 7; an empty rule forbids nothing."""
    told = [(False, "/de/"), (True, "/de/1"), (False, "/*page="), (True, "/en/1*?page="), (False, "/*7$"), (False, "")]
    rules = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("prefix")) for a, p in told])
    return seeds(spark, sf_dir).select(F.col("domain").alias("host"), F.inline(rules))


def spec_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON specification per page, in turn of four kinds."""
    own = F.col("url")
    bare = F.regexp_extract(own, "^[^#]*", 0)
    page = F.col("page_id").cast("string")
    urls = F.format_string('"urls":["%s","%s","%s"]', own, bare, own)
    head = F.format_string('{"name":"crawl-%s","output":"out/%s","logs":"logs/%s",', page, page, page)
    kinds = [
        '"blacklist":["utm_source=","/de/[0-9]"],"whitelist":["//blog[.]","/en/[0-9]*5","example[.]com"],'
        '"finalizers":{},"parser":"parsers.ParagraphParser","parser_data":{"allowed_languages":["any"],'
        '"keep_langdetect_errors":false,"xpaths":["//p","//td"]},'
        '"pipelines":{"pipelines.Paragraph2CsvPipeline":300}}',
        '"blacklist":[],"whitelist":[],"finalizers":{},"parser":"parsers.RawParser",'
        '"parser_data":{"allowed_languages":["any"],"keep_langdetect_errors":false},'
        '"pipelines":{"pipelines.Raw2FilePipeline":300}}',
        '"blacklist":["[?]page="],"finalizers":{"pipelines.RemoteCrawlFinalizer":{}},'
        '"parser":"parsers.ParagraphParser","parser_data":{"allowed_languages":["de","en"],'
        '"keep_langdetect_errors":false,"xpaths":["//p","//td"]},'
        '"pipelines":{"pipelines.Paragraph2CsvPipeline":300}}',
        '"parser":"parsers.ParagraphParser","parser_data":{"allowed_languages":["disabled"]}}',
    ]
    kind = F.col("page_id") % 4
    tail = F.when(kind == 0, kinds[0]).when(kind == 1, kinds[1]).when(kind == 2, kinds[2])
    return pages(spark, sf_dir).select(
        "page_id", F.concat(head, urls, F.lit(","), tail.otherwise(kinds[3])).alias("body")
    )


def task_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph specifications of pages, now and then damaged: cut off, in a list, with a text for a list, without a
    name, or blank."""
    kind = F.col("page_id") % 7
    body = F.col("body")
    damaged = (
        F.when(kind == 1, F.substr(body, F.lit(1), F.length(body) - 1))
        .when(kind == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 3, F.replace(body, F.lit('"urls":['), F.lit('"urls":"","other":[')))
        .when(kind == 4, F.replace(body, F.lit('"name":'), F.lit('"title":')))
        .when(kind == 5, F.lit("  "))
        .otherwise(body)
    )
    return spec_bodies(spark, sf_dir).where("page_id % 4 <> 1").select("page_id", damaged.alias("body"))


def patch_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every third page a patch of its specification, some fields of it empty."""
    page = F.col("page_id").cast("string")
    return (
        pages(spark, sf_dir)
        .filter(F.col("page_id") % 3 == 0)
        .select(
            F.concat(F.lit("crawl-"), page).alias("name"),
            F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("new/"), page)).otherwise(F.lit("")).alias("output"),
            F.lit(None).cast("string").alias("logs"),
            F.array(F.col("url")).alias("urls"),
            F.array().cast("array<string>").alias("blacklist"),
            F.when(F.col("page_id") % 2 == 0, F.array(F.lit("patched"))).alias("whitelist"),
            F.lit("").alias("parser"),
            F.lit(None)
            .cast(
                "struct<allowed_languages:array<string>,keep_langdetect_errors:boolean,"
                "xpaths:array<string>,allowed_content_type:array<string>>"
            )
            .alias("parser_data"),
            F.create_map(F.lit("pipelines.Patched"), F.lit(1)).alias("pipelines"),
            F.create_map().cast("map<string,map<string,string>>").alias("finalizers"),
        )
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task messages from events; one in twenty is there twice, one in thirteen is redelivered."""
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 13 == 0).alias("redelivered"),
        F.format_string(
            '{"name":"task-%s","urls":["http://example.com/%s"]}',
            F.col("event_id").cast("string"),
            F.col("user_id").cast("string"),
        ).alias("body"),
    )
    return base.unionAll(base.filter(F.col("msg_id") % 20 == 0))
