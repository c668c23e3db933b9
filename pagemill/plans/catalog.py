"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.operators import export, frontier, language, links, numbering, paragraphs, spiders
from pagemill.operators.extension import ParserRegistry, run_finalizers, run_pipelines
from pagemill.operators.reports import drop_report
from pagemill.operators.selectors import html_elements
from pagemill.plans import fixtures as fx
from pagemill.session import materialize, scratch_path
from pagemill.sinks.messages import read_results, send_results
from pagemill.sinks.paragraph_csv import write_paragraph_csv
from pagemill.sinks.raw_files import write_raw_files
from pagemill.sources.paragraph_csv import csv_spiders, scan_paragraph_csv
from pagemill.sources.raw_files import scan_raw_files
from pagemill.sources.specs import overlay_specs, parse_specs, split_specs
from pagemill.streaming import crawls as stream_crawl
from pagemill.streaming import results as stream_out
from pagemill.streaming import tasks as stream_in

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHUNK_LIMIT = 20_000
ALLOW = (r"example\.(com|net)", "^ftp:")
DENY = ("/de/", r"[?&]page=")
DENY_DOMAINS = ("spam-farm.example.org", "cheap-pills.example.com")
HTML_TYPES = ["text/html"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Results that several queries start from are computed once per session and folder, as a crawl
# writes its output once and finalizers read it.
_stages: dict[tuple[str, str, str], object] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        _stages[key] = make()
    return _stages[key]


def model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    """The trigram profile of the documents table, trained once and stored."""

    def make() -> language.LanguageModel:
        trained = language.train(fx.documents(spark, sf_dir), fx.MODEL_LANGUAGES)
        stored = materialize(trained.profile, "profile")
        return language.LanguageModel(stored, trained.languages, trained.grams)

    return _stage(spark, sf_dir, "model", make)


def crawl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph rows of the seed spiders with page_id, spec and spider, as a stored crawl."""

    def make() -> DataFrame:
        rows = _parsed_rows(spark, sf_dir, language.DEFAULT_LANGUAGES, True)
        return materialize(spiders.pages_to_spiders(rows, fx.seeds(spark, sf_dir)), "crawl-rows")

    return _stage(spark, sf_dir, "rows", make)


def crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files of the seed spiders, as a stored crawl."""

    def make() -> DataFrame:
        items = paragraphs.raw_items(fx.raw_responses(spark, sf_dir))
        owners = spiders.pages_to_spiders(items.select("page_id", "url"), fx.seeds(spark, sf_dir))
        return materialize(
            numbering.raw_file_table(items, owners, ("spec", "spider")), "crawl-files"
        )

    return _stage(spark, sf_dir, "files", make)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.parse_pages(fx.td_pages(spark, sf_dir))


def _parsed_rows(spark, sf_dir, allowed, keep_errors) -> DataFrame:
    stored = materialize(_parsed(spark, sf_dir), "parsed")  # html is read and parsed once
    return language.parse_with_languages(stored, model(spark, sf_dir), allowed, keep_errors, bucketed=False)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.extract_paragraphs(fx.td_pages(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links and, from the hard URL forms, links that rules reject."""
    found = links.extract_links(fx.pages(spark, sf_dir)).select("page_id", "url", "text")
    forms = fx.url_forms(spark, sf_dir).select(
        "page_id", "url", F.concat(F.lit("form "), F.col("form").cast("string")).alias("text")
    )
    return found.unionByName(forms)


def _joined(column) -> Column:
    return F.array_join(column, " ")


def _flat_specs(specs: DataFrame) -> DataFrame:
    data = F.col("parser_data")
    return specs.select(
        "name",
        "output",
        "logs",
        *[_joined(c).alias(c) for c in ("urls", "blacklist", "whitelist")],
        "parser",
        _joined(data["allowed_languages"]).alias("allowed_languages"),
        data["keep_langdetect_errors"].alias("keep_langdetect_errors"),
        _joined(data["xpaths"]).alias("xpaths"),
        _joined(data["allowed_content_type"]).alias("allowed_content_type"),
        _joined(
            F.transform(
                F.map_entries("pipelines"),
                lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
            )
        ).alias("pipelines"),
        _joined(F.map_keys("finalizers")).alias("finalizers"),
    )


# --- sources ---------------------------------------------------------------------------------


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_specs(fx.spec_bodies(spark, sf_dir))


@query
def scan_specs(spark, sf_dir):
    return _flat_specs(_specs(spark, sf_dir))


@query
def reject_specs(spark, sf_dir):
    return split_specs(fx.task_bodies(spark, sf_dir)).rejected.select("page_id", "reason")


@query
def overlay_specs_(spark, sf_dir):
    return _flat_specs(overlay_specs(_specs(spark, sf_dir), fx.patch_bodies(spark, sf_dir)))


@query
def seed_urls(spark, sf_dir):
    return spiders.seed_urls(_specs(spark, sf_dir))


@query
def scan_pages(spark, sf_dir):
    return fx.responses(spark, sf_dir).drop("failure")


@query
def scan_paragraph_csv_(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_paragraph_csv(crawl_rows(spark, sf_dir), path, spiders=fx.seeds(spark, sf_dir))
    return scan_paragraph_csv(spark, path)


@query
def scan_raw_files_(spark, sf_dir):
    path = scratch_path(spark, "raw")
    write_raw_files(crawl_files(spark, sf_dir), path)
    return scan_raw_files(spark, path)


# --- sinks -----------------------------------------------------------------------------------


@query
def write_paragraph_csv_(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_paragraph_csv(crawl_rows(spark, sf_dir), path, spiders=fx.seeds(spark, sf_dir))
    counts = scan_paragraph_csv(spark, path).groupBy("spider").agg(F.count(F.lit(1)).alias("n"))
    written = csv_spiders(spark, path).join(counts, "spider", "left")
    return written.select("spider", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query
def raw_file_table(spark, sf_dir):
    items = paragraphs.raw_items(fx.raw_responses(spark, sf_dir))
    owners = spiders.pages_to_spiders(items.select("page_id", "url"), fx.seeds(spark, sf_dir))
    return numbering.raw_file_table(items, owners)


@query
def paragraph_messages(spark, sf_dir):
    return export.paragraph_messages(
        crawl_rows(spark, sf_dir), F.col("spec"), keys=("spec", "spider"), spiders=fx.seeds(spark, sf_dir)
    )


@query
def paragraph_messages_chunked(spark, sf_dir):
    return export.paragraph_messages(
        crawl_rows(spark, sf_dir), F.col("spec"), CHUNK_LIMIT, ("spec", "spider"), fx.seeds(spark, sf_dir)
    )


@query
def raw_messages(spark, sf_dir):
    return export.raw_messages(crawl_files(spark, sf_dir), F.col("spec"))


@query
def send_result(spark, sf_dir):
    path = scratch_path(spark, "messages")
    send_results(export.raw_messages(crawl_files(spark, sf_dir), F.col("spec")), path)
    return read_results(spark, path)


@query
def dispatch_finalizer(spark, sf_dir):
    return export.dispatch_finalizer(
        _specs(spark, sf_dir),
        crawl_rows(spark, sf_dir),
        crawl_files(spark, sf_dir),
        CHUNK_LIMIT,
        fx.seeds(spark, sf_dir),
    )


# --- URL functions ---------------------------------------------------------------------------


def _url_query(name: str, fn: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        return fx.url_forms(spark, sf_dir).select("page_id", "form", fn(F.col("url")).alias(name))

    run.__name__ = name
    query(run)


_url_query("url_netloc", U.url_netloc)
_url_query("url2filename", U.url2filename)
_url_query("raw_filename", U.raw_filename)
_url_query("url_scheme_ok", U.url_scheme_ok)
_url_query("url_extension", U.url_extension)
_url_query("canonical_url", U.canonical_url)


@query
def abbreviate_filename(spark, sf_dir):
    named = fx.long_urls(spark, sf_dir).unionByName(fx.colliding_urls(spark, sf_dir))
    return named.select(
        "page_id", U.abbreviate_filename(U.raw_filename(F.col("url"))).alias("filename")
    )


@query
def host_in_domains(spark, sf_dir):
    domains = F.array(F.lit("example.com"), F.lit("spam-farm.example.org"))
    return fx.url_forms(spark, sf_dir).select(
        "page_id",
        "form",
        U.host_in_domains(U.url_netloc(F.col("url")), domains).alias("inside"),
    )


@query
def resolve_url(spark, sf_dir):
    refs = F.array(*[F.lit(r) for r in fx.REFERENCES])
    pairs = fx.pages(spark, sf_dir).select("page_id", "url", F.explode(refs).alias("ref"))
    return pairs.select("page_id", "ref", U.resolve_url(F.col("url"), F.col("ref")).alias("absolute"))


@query
def normalize_extension(spark, sf_dir):
    exts = F.array(*[F.lit(e) for e in fx.EXTENSIONS], U.url_extension(F.col("url")))
    rows = fx.pages(spark, sf_dir).select("page_id", F.posexplode(exts).alias("form", "ext"))
    return rows.select("page_id", "form", U.normalize_extension(F.col("ext")).alias("ext"))


# --- extraction ------------------------------------------------------------------------------


@query
def route_content_type(spark, sf_dir):
    routed = paragraphs.route_content_type(
        fx.responses(spark, sf_dir), ["text/html", "application/pdf"]
    )
    return routed.select("page_id", "content_type", "handler")


@query
def extract_paragraphs(spark, sf_dir):
    rows = paragraphs.extract_paragraphs(fx.pages(spark, sf_dir), ["//p"])
    return rows.select("page_id", "url", "pos", "origin", "content")


@query
def element_text(spark, sf_dir):
    visible = fx.pages(spark, sf_dir).select("page_id", H.strip_hidden(F.col("html")).alias("visible"))
    return visible.select("page_id", H.element_text(F.col("visible")).alias("content"))


@query
def split_lines(spark, sf_dir):
    documents = fx.documents(spark, sf_dir).select("doc_id", "text")
    return paragraphs.line_paragraphs(documents, "text")


@query
def extract_links(spark, sf_dir):
    return links.extract_links(fx.pages(spark, sf_dir))


@query
def decode_body(spark, sf_dir):
    return fx.body_bytes(spark, sf_dir).select("page_id", T.decode_body(F.col("body")).alias("body"))


@query
def raw_items(spark, sf_dir):
    return paragraphs.raw_items(fx.responses(spark, sf_dir))


ROW_COLUMNS = (
    "page_id",
    "url",
    "xp_idx",
    "pos",
    "content",
    "par_language",
    "page_language",
    "origin",
    "depth",
)


@query
def paragraph_rows(spark, sf_dir):
    return _parsed_rows(spark, sf_dir, language.DEFAULT_LANGUAGES, True).select(*ROW_COLUMNS)


@query
def paragraph_rows_any(spark, sf_dir):
    return _parsed_rows(spark, sf_dir, (language.ANY,), False).select(*ROW_COLUMNS)


@query
def paragraph_rows_disabled(spark, sf_dir):
    return language.parse_with_languages(
        _parsed(spark, sf_dir), None, (language.DISABLED,)
    ).select(*ROW_COLUMNS)


# --- filters ---------------------------------------------------------------------------------


@query
def drop_blank(spark, sf_dir):
    blanks = ["", " \t", " ", "\u001c", "\u0085　", "x "]
    pad = F.get(F.array(*[F.lit(b) for b in blanks]), (F.col("turn") % 6).cast("int"))
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, pad).otherwise(F.col("text")).alias("content")
    )
    return paragraphs.drop_blank(turns)


@query
def whitelist(spark, sf_dir):
    return links.whitelist(_links(spark, sf_dir), ALLOW)


@query
def blacklist(spark, sf_dir):
    return links.blacklist(_links(spark, sf_dir), DENY)


@query
def valid_scheme(spark, sf_dir):
    return links.valid_scheme(_links(spark, sf_dir))


@query
def allow_deny_domains(spark, sf_dir):
    hosts = fx.pages(spark, sf_dir).select(U.url_netloc(F.col("url")).alias("domain"))
    denied = hosts.filter(F.col("domain").rlike("spam-farm|cheap-pills"))
    allowed = fx.seeds(spark, sf_dir).select("domain")
    return links.allow_deny_domains(_links(spark, sf_dir), allowed, denied)


@query
def deny_extensions(spark, sf_dir):
    return links.deny_extensions(_links(spark, sf_dir))


@query
def restrict_text(spark, sf_dir):
    return links.restrict_text(_links(spark, sf_dir), ("^[Tt]h", "form [0-3]"))


@query
def page_language_filter(spark, sf_dir):
    parsed = materialize(paragraphs.parse_pages(fx.pages(spark, sf_dir), ["//p"]), "parsed")
    scored = language.page_languages(parsed, model(spark, sf_dir), bucketed=False).select("page_id", "langs")
    rows = parsed.select("page_id", "url").join(scored, "page_id", "left")
    return language.page_language_filter(rows, ("fr", "es"), False).drop("langs")


@query
def in_domain(spark, sf_dir):
    return spiders.pages_to_spiders(fx.url_forms(spark, sf_dir), fx.seeds(spark, sf_dir)).select(
        "page_id", "form", "url", "spider"
    )


@query
def depth_limit(spark, sf_dir):
    return links.depth_limit(fx.responses(spark, sf_dir)).select("page_id", "url", "depth")


@query
def robots_filter(spark, sf_dir):
    return links.robots_filter(
        fx.pages(spark, sf_dir).select("page_id", "url"), fx.robots(spark, sf_dir)
    )


@query
def content_type_allow(spark, sf_dir):
    return paragraphs.content_type_allow(fx.responses(spark, sf_dir)).select(
        "page_id", "url", "content_type"
    )


@query
def html_only(spark, sf_dir):
    named = fx.url_forms(spark, sf_dir).select(
        "page_id", "form", U.raw_filename(F.col("url")).alias("filename")
    )
    return export.html_only(named)


def _rules() -> links.LinkRules:
    return links.LinkRules(
        allow=ALLOW, deny=DENY, deny_domains=DENY_DOMAINS, restrict_text=("[a-z]",)
    )


@query
def link_audit(spark, sf_dir):
    return links.link_audit(_links(spark, sf_dir), _rules())


# --- joins -----------------------------------------------------------------------------------


@query
def pages_to_spiders(spark, sf_dir):
    return spiders.pages_to_spiders(
        fx.pages(spark, sf_dir).select("page_id", "url"), fx.seeds(spark, sf_dir)
    )


@query
def semi_in_domain(spark, sf_dir):
    return spiders.semi_in_domain(
        fx.pages(spark, sf_dir).select("page_id", "url"), fx.seeds(spark, sf_dir)
    )


def _visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = fx.pages(spark, sf_dir).filter("page_id % 2 = 0")
    return even.select(U.canonical_url(F.col("url")).alias("key"))


@query
def anti_visited(spark, sf_dir):
    return frontier.anti_visited(fx.edges(spark, sf_dir), _visited(spark, sf_dir))


@query
def regex_rule_join(spark, sf_dir):
    found = _links(spark, sf_dir).withColumn(
        "spec", F.concat(F.lit("crawl-"), F.col("page_id").cast("string"))
    )
    return links.regex_rule_join(found, _specs(spark, sf_dir))


@query
def page_score_join(spark, sf_dir):
    parsed = materialize(_parsed(spark, sf_dir), "parsed")
    scored = language.page_languages(parsed, model(spark, sf_dir), bucketed=False)
    top = scored.select("page_id", F.get("langs", F.lit(0))["lang"].alias("page_top"))
    return paragraphs.paragraph_rows(parsed).join(top, "page_id").select(
        "page_id", "xp_idx", "pos", "page_top"
    )


@query
def ngram_profile_join(spark, sf_dir):
    trained = model(spark, sf_dir)
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return language.score_texts(turns, ["conv_id", "turn"], "text", trained)


# --- aggregations ----------------------------------------------------------------------------


@query
def paragraphs_per_page(spark, sf_dir):
    return paragraphs.paragraphs_per_page(_parsed(spark, sf_dir)).select(
        "page_id", "url", "n_paragraphs"
    )


@query
def language_histogram(spark, sf_dir):
    return language.language_histogram(crawl_rows(spark, sf_dir))


@query
def page_text(spark, sf_dir):
    return paragraphs.page_text(_parsed(spark, sf_dir)).select("page_id", "page_text")


@query
def page_language_distribution(spark, sf_dir):
    scored = language.page_languages(_parsed(spark, sf_dir), model(spark, sf_dir), bucketed=False)
    return scored.filter("langs is not null").select(
        "page_id",
        F.size("langs").alias("n_langs"),
        language.format_lang_list(F.col("langs")).alias("langs"),
    )


@query
def language_stats_pivot(spark, sf_dir):
    return language.language_stats(crawl_rows(spark, sf_dir))


@query
def result_size(spark, sf_dir):
    return export.result_size(crawl_rows(spark, sf_dir))


@query
def drop_report_(spark, sf_dir):
    routed = paragraphs.route_content_type(fx.responses(spark, sf_dir), HTML_TYPES)
    return drop_report(
        routed.select("content_type", "handler", "failure"),
        links.link_audit(_links(spark, sf_dir), _rules()),
    )


# --- windows ---------------------------------------------------------------------------------


def _named(df: DataFrame) -> DataFrame:
    return df.select(
        U.url_netloc(F.col("url")).alias("spider"),
        "page_id",
        U.raw_filename(F.col("url")).alias("filename"),
    )


@query
def unique_long_names(spark, sf_dir):
    return numbering.unique_long_names(_named(fx.long_urls(spark, sf_dir)))


@query
def last_writer_wins(spark, sf_dir):
    return numbering.last_writer_wins(_named(fx.colliding_urls(spark, sf_dir)))


@query
def chunk_rows(spark, sf_dir):
    return export.chunk_rows(crawl_rows(spark, sf_dir), CHUNK_LIMIT)


@query
def first_link_per_page(spark, sf_dir):
    every = links.extract_links(fx.pages(spark, sf_dir), unique=False)
    again = every.withColumn("pos", F.col("pos") + 1000).withColumn(
        "text", F.concat("text", F.lit(" again"))
    )
    return numbering.first_link_per_page(every.unionByName(again))


@query
def top_language(spark, sf_dir):
    trained = model(spark, sf_dir)
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    scored = language.score_texts(turns, ["conv_id", "turn"], "text", trained)
    return scored.select("conv_id", "turn", language.top_language(trained).alias("lang"))


# --- order, sets, iteration ------------------------------------------------------------------


@query
def paragraph_order(spark, sf_dir):
    return (
        _rows(spark, sf_dir)
        .select("page_id", "xp_idx", "pos", "content")
        .orderBy("page_id", "xp_idx", "pos")
    )


@query
def langs_by_prob(spark, sf_dir):
    scored = language.page_languages(_parsed(spark, sf_dir), model(spark, sf_dir), bucketed=False)
    return scored.select("page_id", F.posexplode("langs").alias("rank", "e")).select(
        "page_id", "rank", "e.lang", "e.prob"
    )


@query
def top_ngrams(spark, sf_dir):
    counts = language.gram_counts(fx.documents(spark, sf_dir))
    return language.top_grams(counts).select("lang", "gram", "cnt")


@query
def union_xpaths(spark, sf_dir):
    rows = paragraphs.extract_paragraphs(fx.td_pages(spark, sf_dir), ["//td", "//p", "//td", "//h1"])
    return rows.select("page_id", "xp_idx", "pos", "origin", "content")


@query
def distinct_urls(spark, sf_dir):
    return spiders.distinct_urls(_specs(spark, sf_dir))


@query
def new_minus_seen(spark, sf_dir):
    found = fx.edges(spark, sf_dir).select(U.canonical_url(F.col("url")).alias("key"))
    return frontier.new_minus_seen(found, _visited(spark, sf_dir))


@query
def crawl_frontier(spark, sf_dir):
    return frontier.crawl_frontier(fx.crawl_seeds(spark, sf_dir), fx.edges(spark, sf_dir)).select(
        "spider", "key", "depth"
    )


# --- language --------------------------------------------------------------------------------


@query
def ngram_profiles(spark, sf_dir):
    trained = language.train(fx.documents(spark, sf_dir), fx.MODEL_LANGUAGES)
    return language.profile_rows(trained)


@query
def detect_paragraph_lang(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 9 == 8, F.lit("12 + 30 = ?")).otherwise(F.col("text")).alias("text"),
    )
    return language.detect_texts(turns, ["conv_id", "turn"], "text", model(spark, sf_dir)).select(
        "conv_id", "turn", "par_language"
    )


@query
def detect_page_langs(spark, sf_dir):
    trained = model(spark, sf_dir)
    texts = fx.documents(spark, sf_dir).select("doc_id", "text")
    scored = language.score_texts(texts, ["doc_id"], "text", trained)
    return scored.select("doc_id", F.inline(language.language_list(trained)))


@query
def format_lang_list(spark, sf_dir):
    trained = model(spark, sf_dir)
    turns = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    scored = language.score_texts(turns, ["conv_id", "turn"], "text", trained)
    langs = language.format_lang_list(language.language_list(trained))
    return scored.select("conv_id", "turn", langs.alias("langs"))


# --- streaming -------------------------------------------------------------------------------


def _drain(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    stream_out.run_to_parquet(stream, path, scratch_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def _task_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "tasks")
    stream_in.send_tasks(fx.tasks(spark, sf_dir), path)
    return path


@query
def stream_tasks(spark, sf_dir):
    tasks = stream_in.stream_tasks(spark, _task_files(spark, sf_dir))
    return _drain(tasks, "stream-tasks").select("msg_id", "redelivered", "body")


@query
def drop_redelivered(spark, sf_dir):
    tasks = stream_in.stream_tasks(spark, _task_files(spark, sf_dir))
    once = stream_in.drop_redelivered(tasks)
    return _drain(once, "stream-once").select("msg_id", "body")


def _page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, since the table may be one file or a folder; one batch, so that messages do not depend on which.
    stream = stream_out.stream_pages(spark, f"{sf_dir}/pages[.]parquet", max_files=None)
    kind = F.col("page_id") % 10
    return stream.withColumn(
        "content_type",
        F.when(kind == 0, "application/pdf").when(kind == 2, "image/png").otherwise("text/html"),
    )


@query
def stream_parse(spark, sf_dir):
    rows = stream_out.stream_parse(_page_stream(spark, sf_dir))
    return _drain(rows, "stream-parse")


@query
def stream_results(spark, sf_dir):
    rows = stream_out.stream_parse(_page_stream(spark, sf_dir))
    seeds = fx.seeds(spark, sf_dir)

    def to_messages(batch: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        owned = spiders.pages_to_spiders(batch, seeds).select(
            "*",
            none.alias("par_language"),
            none.alias("page_language"),
            F.lit(0).alias("depth"),
        )
        return export.paragraph_messages(owned, F.col("spec"), keys=("spec", "spider"))

    path = scratch_path(spark, "stream-results")
    stream_out.stream_results(rows, path, scratch_path(spark, "results-checkpoint"), to_messages)
    return read_results(spark, f"{path}/*")


@query
def task_crawl(spark, sf_dir):
    """Tasks from specifications of pages, crawled as they arrive."""
    tasks = fx.task_bodies(spark, sf_dir).select(
        F.col("page_id").alias("msg_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(False).alias("redelivered"), "body"
    )
    inbox, path = scratch_path(spark, "task-inbox"), scratch_path(spark, "task-crawl")
    stream_in.send_tasks(tasks, inbox)
    stream = stream_in.stream_tasks(spark, inbox, max_files=1000)
    stream_crawl.stream_crawls(spark, stream, fx.td_pages(spark, sf_dir).drop("depth"), path, scratch_path(spark, "task-mark"), model(spark, sf_dir))
    rows = spark.read.parquet(f"{path}/paragraphs")
    return rows.select("spec", "spider", "page_id", "xp_idx", "pos", "content", "par_language", "page_language", "depth")


@query
def send_tasks(spark, sf_dir):
    bodies = stream_in.task_messages(_specs(spark, sf_dir))
    tasks = bodies.select(
        F.xxhash64("name").alias("msg_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
        F.lit(False).alias("redelivered"),
        "body",
    )
    path = scratch_path(spark, "sent-tasks")
    stream_in.send_tasks(tasks, path)
    received = spark.read.schema(stream_in.TASK_SCHEMA).json(path)
    return _flat_specs(parse_specs(received))


# --- extensions ------------------------------------------------------------------------------


@query
def register_parser(spark, sf_dir):
    registry = ParserRegistry()
    registry.register(
        "text/html",
        lambda df, data: paragraphs.extract_paragraphs(
            df.select("page_id", "body"), data["xpaths"], html="body"
        ),
    )
    registry.register(
        "application/pdf",
        lambda df, data: paragraphs.line_paragraphs(
            df.select("page_id", H.element_text(F.col("body")).alias("body")), "body"
        ),
    )
    rows = registry.parse(fx.responses(spark, sf_dir), {"xpaths": ["//h1", "//p"]})
    return rows.select("page_id", "xp_idx", "pos", "origin", "content")


def _tag_step(label: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("trace", F.concat("trace", F.lit(label)))


@query
def run_pipelines_(spark, sf_dir):
    rows = fx.pages(spark, sf_dir).select("page_id", "url", F.lit("").alias("trace"))
    steps = {
        "last": _tag_step("c"),
        "keep": lambda df: df.filter(U.url_netloc(F.col("url")).endswith(".example.com")),
        "first": _tag_step("a"),
        "middle": _tag_step("b"),
    }
    return run_pipelines(rows, {"last": 900, "first": 100, "middle": 300, "keep": 200}, steps)


@query
def run_finalizers_(spark, sf_dir):
    functions = {
        "rows": lambda df, spec, data: df.groupBy("spider").agg(F.count(F.lit(1)).alias("value")),
        "pages": lambda df, spec, data: df.groupBy("spider").agg(
            F.countDistinct("page_id").alias("value")
        ),
    }
    outputs = run_finalizers(crawl_rows(spark, sf_dir), None, {"pages": {}, "rows": {}, "absent": {}}, functions)
    tagged = [df.withColumn("finalizer", F.lit(name)) for name, df in sorted(outputs.items())]
    return tagged[0].unionByName(tagged[1])


@query
def html_elements_(spark, sf_dir):
    return html_elements(fx.pages(spark, sf_dir), ["//h1", "//nav//a", "//div[@class='ad']"])


# Names that an imported function already has carry an underscore above.
QUERIES = {name.rstrip("_"): fn for name, fn in QUERIES.items()}
