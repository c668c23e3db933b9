"""One crawl specification over a table of captured pages, end to end."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.elements import parse_selector
from pagemill.functions.text import decode_body
from pagemill.functions.urls import canonical_url, url_netloc
from pagemill.operators.export import (
    MESSAGE_LIMIT,
    PARAGRAPH_PARSER,
    RAW_PARSER,
    paragraph_messages,
    raw_messages,
)
from pagemill.operators.extension import Finalizer, run_finalizers
from pagemill.operators.frontier import DEPTH_LIMIT, crawl_frontier
from pagemill.operators.language import DISABLED, LanguageModel, parse_with_languages
from pagemill.operators.links import LinkRules, allowed_links, extract_links, regex_rule_join
from pagemill.operators.numbering import raw_file_table
from pagemill.operators.paragraphs import matched_type, parse_pages
from pagemill.operators.spiders import seed_urls
from pagemill.session import materialize
from pagemill.sinks.paragraph_csv import write_paragraph_csv
from pagemill.sinks.raw_files import write_raw_files
from pagemill.sources.specs import CrawlSpec

# Pipeline and finalizer names of a specification.
CSV_PIPELINE = "pipelines.Paragraph2CsvPipeline"
RAW_PIPELINE = "pipelines.Raw2FilePipeline"
REMOTE_FINALIZER = "pipelines.RemoteCrawlFinalizer"
ACCEPTED_PIPELINES = {PARAGRAPH_PARSER: (CSV_PIPELINE,), RAW_PARSER: (RAW_PIPELINE,)}


@dataclass(frozen=True)
class CrawlResult:
    """``visits``: pages per spider with their depth; ``items``: paragraph rows or raw files of the
    pages on the spider's own host."""

    spec: CrawlSpec
    visits: DataFrame
    items: DataFrame


def _with_content_type(pages: DataFrame) -> DataFrame:
    if "content_type" in pages.columns:
        return pages
    return pages.withColumn("content_type", F.lit("text/html"))


def spec_spiders(spark: SparkSession, spec: CrawlSpec) -> DataFrame:
    """The spiders of a specification, one per start URL."""
    specs = spark.range(1).select(
        F.lit(spec.name).alias("name"), F.array(*[F.lit(u) for u in spec.urls]).alias("urls")
    )
    return seed_urls(specs)


def visit_pages(
    spark: SparkSession, spec: CrawlSpec, pages: DataFrame, robots: DataFrame | None = None
) -> DataFrame:
    """Rows (spider, domain, page_id, url, depth) of the captured pages that each spider reaches.
    A URL captured more than once is visited once, in its latest capture."""
    rules = LinkRules(allow=tuple(spec.whitelist), deny=tuple(spec.blacklist))
    linking = _with_content_type(pages)
    linking = linking.filter(matched_type(F.col("content_type"), ["text/html"]).isNotNull())
    links = allowed_links(extract_links(linking), rules)
    return _captured(crawl_frontier(spec_spiders(spark, spec), links, DEPTH_LIMIT, robots), pages)


def _captured(reached: DataFrame, pages: DataFrame) -> DataFrame:
    """The latest capture of each URL that is reached."""
    captures = (
        pages.select(canonical_url(F.col("url")).alias("key"), "page_id", F.col("url").alias("url"))
        .groupBy("key")
        .agg(F.max(F.struct("page_id", "url")).alias("c"))
        .select("key", "c.page_id", "c.url")
    )
    return reached.join(captures, "key").drop("key")


def run_crawl(
    spark: SparkSession,
    spec: CrawlSpec,
    pages: DataFrame,
    model: LanguageModel | None = None,
    robots: DataFrame | None = None,
) -> CrawlResult:
    """Visit, parse and keep what belongs to each spider's own host.

    Offsite pages are removed before anything is parsed, and a page that several spiders visit is
    parsed once. Parsed pages and the items are stored, so that scores, pipelines and finalizers read
    no HTML again.
    """
    pages = _with_content_type(pages)
    visits = visit_pages(spark, spec, pages, robots)
    onsite = visits.filter(url_netloc(F.col("url")) == F.col("domain"))
    wanted = pages.join(onsite.select("page_id").distinct(), "page_id", "left_semi")
    places = onsite.select("page_id", "spider", "depth")
    if spec.parser == RAW_PARSER:
        allowed = wanted.filter(
            matched_type(F.col("content_type"), list(spec.allowed_content_type)).isNotNull()
        )
        bodies = allowed.select("page_id", "url", F.col("html").alias("content"))
        owners = places.join(bodies.select("page_id", "url"), "page_id")
        return CrawlResult(spec, visits, materialize(raw_file_table(bodies, owners), "items"))
    if spec.parser != PARAGRAPH_PARSER:
        raise ValueError(f"unknown parser {spec.parser!r}")
    if model is None and DISABLED not in spec.allowed_languages:
        raise ValueError("a language model is needed unless detection is disabled")
    html = wanted.filter(matched_type(F.col("content_type"), ["text/html"]).isNotNull())
    parsed = materialize(parse_pages(html.select("page_id", "url", "html"), list(spec.xpaths)), "parsed")
    rows = parse_with_languages(
        parsed, model, tuple(spec.allowed_languages), spec.keep_langdetect_errors
    )
    return CrawlResult(spec, visits, materialize(rows.join(places, "page_id"), "items"))


@dataclass(frozen=True)
class CrawlsResult:
    """Of many specifications: ``visits`` and ``paragraphs`` or ``raw`` files with spec and spider; ``rejected`` has the names of
    those that can't be run, with the reason."""

    visits: DataFrame
    paragraphs: DataFrame
    raw: DataFrame
    rejected: DataFrame


PARAGRAPH_ITEMS = (
    "spec string, spider string, page_id long, url string, xp_idx int, pos int, origin string, content string, par_language string, "
    "page_language string, depth int"
)
RAW_ITEMS = "spec string, spider string, filename string, url string, content string"


def runnable(specs: DataFrame, model: LanguageModel | None) -> tuple[DataFrame, DataFrame]:
    """The specifications that can be run, and (name, reason) of the others. Distinct selectors come to the driver."""
    listed = specs.where(F.col("parser") == PARAGRAPH_PARSER).select(F.explode("parser_data.xpaths").alias("x")).distinct()
    unknown = []
    for row in listed.collect():
        try:
            parse_selector(row.x or "")
        except ValueError:
            unknown.append(row.x)
    paragraph, data = F.col("parser") == PARAGRAPH_PARSER, F.col("parser_data")
    odd = F.exists(data["xpaths"], lambda x: x.isNull() | x.isin(*[x for x in unknown if x is not None]))
    scored = ~F.array_contains(data["allowed_languages"], DISABLED)
    reason = (
        F.when(~F.coalesce(F.col("parser").isin(PARAGRAPH_PARSER, RAW_PARSER), F.lit(False)), "unknown parser")
        .when(paragraph & odd, "unsupported selector")
        .when(paragraph & scored & F.lit(model is None), "no language model")
    )
    judged = specs.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("name", "reason")


def run_crawls(
    spark: SparkSession,
    specs: DataFrame,
    pages: DataFrame,
    model: LanguageModel | None = None,
    robots: DataFrame | None = None,
) -> CrawlsResult:
    """Many specifications at once, each as :func:`run_crawl` does it; their names are distinct.

    Links are extracted once; one frontier serves all spiders, whose keys include the specification, and tests what a
    round has found against the rules of its own specification. Pages are parsed once for each distinct setting
    of the parser (selectors and languages), however many specifications share it.
    """
    pages = _with_content_type(pages)
    specs, rejected = runnable(materialize(specs, "specs"), model)
    linking = pages.filter(matched_type(F.col("content_type"), ["text/html"]).isNotNull())
    links = allowed_links(extract_links(linking), LinkRules())

    def accept(found: DataFrame) -> DataFrame:
        return regex_rule_join(found, specs).where("reason is null")

    reached = crawl_frontier(seed_urls(specs), links, DEPTH_LIMIT, robots, ("spec", "spider"), accept=accept)
    visits = materialize(_captured(reached, pages), "visits")
    onsite = visits.filter(url_netloc(F.col("url")) == F.col("domain")).select("page_id", "spec", "spider", "depth")

    paragraphs = spark.createDataFrame([], PARAGRAPH_ITEMS)
    data = F.col("parser_data")
    fields = ("xpaths", "allowed_languages", "keep_langdetect_errors")
    settings = specs.where(F.col("parser") == PARAGRAPH_PARSER).select(*[data[f].alias(f) for f in fields], F.col("name").alias("spec"))
    for s in settings.select(*fields).distinct().collect():
        same = [F.col("xpaths") == F.array(*map(F.lit, s.xpaths)).cast("array<string>"), F.col("allowed_languages") == F.array(*map(F.lit, s.allowed_languages)).cast("array<string>")]
        own = settings.where(reduce(and_, same) & (F.col("keep_langdetect_errors") == F.lit(s.keep_langdetect_errors)))
        places = onsite.join(own.select("spec"), "spec")
        wanted = linking.join(places.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "url", "html")
        parsed = materialize(parse_pages(wanted, list(s.xpaths)), "parsed")
        rows = parse_with_languages(parsed, model, tuple(s.allowed_languages), s.keep_langdetect_errors, bucketed=False)
        paragraphs = paragraphs.unionByName(rows.join(places, "page_id").select(*paragraphs.columns))

    raw = specs.where(F.col("parser") == RAW_PARSER).select(F.col("name").alias("spec"), data["allowed_content_type"].alias("_types"))
    kinds = pages.select("page_id", "url", F.lower(F.coalesce("content_type", F.lit(""))).alias("_kind"))
    owners = onsite.join(raw, "spec").join(kinds, "page_id").where(F.exists("_types", lambda t: F.contains(F.col("_kind"), t)))
    bodies = pages.select("page_id", "url", F.col("html").alias("content"))
    files = raw_file_table(bodies, owners.select("spec", "spider", "page_id", "url"), ("spec", "spider"))
    columns = [c.split()[0] for c in RAW_ITEMS.split(", ")]
    return CrawlsResult(visits, materialize(paragraphs, "paragraphs"), materialize(files.select(*columns), "files"), rejected)


def write_items(result: CrawlResult, path: str | None = None) -> None:
    """Run the specification's pipelines in order of priority on the items. A spider that found nothing
    has a CSV with the header alone."""
    target = path or result.spec.output

    def write_csv(items: DataFrame, folder: str) -> None:
        write_paragraph_csv(items, folder, spiders=spec_spiders(items.sparkSession, result.spec))

    writers = {CSV_PIPELINE: write_csv, RAW_PIPELINE: write_raw_files}
    for name, _ in sorted(result.spec.pipelines.items(), key=lambda item: item[1]):
        if name not in ACCEPTED_PIPELINES.get(result.spec.parser, ()):
            raise ValueError(f"{result.spec.parser} does not fit pipeline {name}")
        writers[name](result.items, target)


def remote_finalizer(items: DataFrame, spec: CrawlSpec, data: Mapping[str, str]) -> DataFrame:
    """Result messages of a crawl, by its parser; of a paragraph crawl at least one for each spider."""
    crawl = F.lit(spec.name)
    if spec.parser == RAW_PARSER:
        content = F.col("content")
        if dict(items.dtypes)["content"] == "binary":
            content = decode_body(content)
        return raw_messages(items.withColumn("content", content), crawl)
    limit = int(data.get("max_message_size", MESSAGE_LIMIT))
    return paragraph_messages(items, crawl, limit, spiders=spec_spiders(items.sparkSession, spec))


def finalize(result: CrawlResult, extra: Mapping[str, Finalizer] | None = None) -> dict[str, DataFrame]:
    """Outputs of the specification's finalizers by name."""
    known = {REMOTE_FINALIZER: remote_finalizer, **(extra or {})}
    return run_finalizers(result.items, result.spec, result.spec.finalizers, known)
