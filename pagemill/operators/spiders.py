"""Start URLs, spiders, and the match of pages to spiders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import url2filename, url_netloc


def seed_urls(specs: DataFrame) -> DataFrame:
    """Distinct start URLs per crawl: spec, url, domain, spider."""
    urls = specs.select(F.col("name").alias("spec"), F.explode_outer("urls").alias("url"))
    urls = urls.filter(F.col("url").isNotNull()).distinct()
    return urls.select(
        "spec",
        "url",
        url_netloc(F.col("url")).alias("domain"),
        url2filename(F.col("url")).alias("spider"),
    )


def distinct_urls(specs: DataFrame) -> DataFrame:
    urls = specs.select(F.explode_outer("urls").alias("url"))
    return urls.filter(F.col("url").isNotNull()).distinct()


def pages_to_spiders(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each page once per spider whose domain equals the page's authority, port included.

    No broadcast hint: a short seed list is broadcast because its size says so, a long one is
    shuffled and a hot domain is split by the skew join.
    """
    spiders = seeds.select("domain", "spider", *[c for c in ("spec",) if c in seeds.columns])
    return pages.withColumn("domain", url_netloc(F.col("url"))).join(spiders, "domain")


def semi_in_domain(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages that have any spider, each once."""
    keyed = pages.withColumn("domain", url_netloc(F.col("url")))
    return keyed.join(seeds.select("domain"), "domain", "left_semi").drop("domain")
