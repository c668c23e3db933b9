"""Breadth-first expansion of a link graph from start URLs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import canonical_url, host_in_domains, url_netloc
from pagemill.operators.links import robots_filter
from pagemill.session import materialize, store_bucketed

DEPTH_LIMIT = 5
PART_EDGES = 100_000
Accept = Callable[[DataFrame], DataFrame]


def anti_visited(links: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Links whose canonical URL is not among the ``key`` values of ``visited``."""
    keyed = links.withColumn("key", canonical_url(F.col(url)))
    return keyed.join(visited.select("key"), "key", "left_anti")


def new_minus_seen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct keys found but not seen."""
    return found.select("key").subtract(seen.select("key"))


def link_edges(links: DataFrame, as_written: bool = False) -> DataFrame:
    """Links (src_url, url) as thin distinct edges (src, key, host) of canonical URLs; with the url ``as_written``, too."""
    return (
        links.select(
            canonical_url(F.col("src_url")).alias("src"),
            canonical_url(F.col("url")).alias("key"),
            *(["url"] if as_written else []),
        )
        .distinct()
        .withColumn("host", url_netloc(F.col("key")))
    )


def crawl_frontier(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int = DEPTH_LIMIT,
    robots: DataFrame | None = None,
    keys: Sequence[str] = ("spider",),
    buckets: int | None = None,
    accept: Accept | None = None,
) -> DataFrame:
    """Rows (keys, domain, key, depth): every canonical URL a spider reaches, at its least depth.

    ``seeds`` has ``keys``, domain, url; ``links`` src_url and url; two spiders are the same only if all ``keys`` are,
    so that many specifications may be worked at once. A spider stays on its domain and the domains below it,
    and asks nothing that ``robots`` forbids; ``accept`` filters what a round has found, rows (keys, domain, key, url).

    The state of the iteration is stored in buckets: the edges by their source, and each layer by spider and key, as
    many buckets as there are shuffle partitions. A round deals out only its delta: the last layer by key, to meet
    the edges where they lie, and the keys found, to meet all earlier layers where they lie. Edges and visited keys
    are dealt once, when they are stored. A page that very many edges leave has them in parts of about ``PART_EDGES``,
    and is looked up once for each part; one they lead to melts in the partial distinct. Only the question whether
    a layer is empty comes back to the driver. The result is stored, then the tables of the rounds are dropped.
    """
    spark, keys = seeds.sparkSession, list(keys)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if robots is not None:
        seeds, links = robots_filter(seeds, robots), robots_filter(links, robots)
    thin = materialize(link_edges(links, accept is not None), "links")
    parts = materialize(source_parts(thin), "parts")
    placed = thin.join(parts, "src", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)))
    edges = store_bucketed(placed.drop("parts"), "edges", ["src", "part"], buckets)
    start = seeds.select(*keys, "domain", canonical_url(F.col("url")).alias("key")).distinct()
    layers = [store_bucketed(start.withColumn("depth", F.lit(0)), "layer", [*keys, "key"], buckets)]
    try:
        for depth in range(1, max_depth + 1):
            layer = next_layer([t.rows for t in layers], edges.rows, parts, keys, accept).withColumn("depth", F.lit(depth))
            layers.append(store_bucketed(layer, "layer", [*keys, "key"], buckets))
            if layers[-1].rows.isEmpty():
                break
        return materialize(reduce(DataFrame.unionByName, [t.rows for t in layers]), "frontier")
    finally:
        for stored in (edges, *layers):
            stored.drop()


def source_parts(edges: DataFrame) -> DataFrame:
    """(src, parts) of the pages whose edges are stored in several parts."""
    out = edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_EDGES)).alias("parts"))
    return out.where("parts > 1")


def next_layer(
    layers: Sequence[DataFrame], edges: DataFrame, parts: DataFrame, keys: Sequence[str], accept: Accept | None = None
) -> DataFrame:
    """What the last of ``layers`` leads to and none of them holds. Each layer is asked on its own, since a union
    would lose the buckets they are stored in."""
    asked = layers[-1].select(*keys, "domain", F.col("key").alias("src")).join(parts, "src", "left")
    each = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)
    found = (
        asked.select(*keys, "domain", "src", F.explode(each).alias("part"))
        .join(edges, ["src", "part"])
        .filter(host_in_domains(F.col("host"), F.array("domain")))
    )
    found = (accept(found) if accept else found).select(*keys, "domain", "key").distinct()
    for layer in layers:
        found = found.join(layer.select(*keys, "key"), [*keys, "key"], "left_anti")
    return found.select(*keys, "domain", "key")
