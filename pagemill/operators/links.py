"""Link extraction, link rules and robots rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.html import base_href, link_array, strip_hidden
from pagemill.functions.urls import (
    host_in_domains,
    host_suffixes,
    resolve_from,
    resolve_url,
    url_base,
    url_extension,
    url_netloc,
    url_scheme_ok,
)
from pagemill.operators.paragraphs import explode_structs
from pagemill.session import materialize

# Extensions of links that are not followed.
DENIED_EXTENSIONS = (
    "mng", "pct", "bmp", "gif", "jpg", "jpeg", "png", "pst", "psp", "tif", "tiff", "ai", "drw", "dxf", "eps", "ps",
    "svg", "mp3", "wma", "ogg", "wav", "ra", "aac", "mid", "au", "aiff", "3gp", "asf", "asx", "avi", "mov", "mp4",
    "mpg", "qt", "rm", "swf", "wmv", "m4a", "m4v", "flv", "xls", "xlsx", "ppt", "pptx", "pps", "doc", "docx", "odt",
    "ods", "odg", "odp", "css", "exe", "bin", "rss", "zip", "rar", "gz", "tar",
)


def extract_links(pages: DataFrame, html: str = "html", unique: bool = True) -> DataFrame:
    """Rows (page_id, src_url, pos, url, text) with absolute URLs.

    With ``unique`` only the first occurrence of a URL in a page stays. A page is one record, so its
    links are compared inside the row, by sorting, and nothing is shuffled.
    """
    # One projection per step: a later one uses the column of an earlier one many times, and Catalyst
    # keeps such projections apart instead of repeating the work.
    visible = pages.select("page_id", "url", strip_hidden(F.col(html)).alias("_visible"))
    found = visible.select(
        "page_id",
        "url",
        link_array(F.col("_visible")).alias("_links"),
        base_href(F.col("_visible")).alias("_href"),
    )
    based = found.select(
        "page_id",
        "url",
        "_links",
        F.when(F.col("_href") == "", F.col("url"))
        .otherwise(resolve_url(F.col("url"), F.col("_href")))
        .alias("_base_url"),
    ).select("page_id", "url", "_links", url_base(F.col("_base_url")).alias("_base"))
    absolute = based.select(
        "page_id",
        F.col("url").alias("src_url"),
        F.array_sort(
            F.transform(
                "_links",
                lambda a: F.struct(
                    resolve_from(F.col("_base"), a["href"]).alias("url"),
                    a["pos"].alias("pos"),
                    a["text"].alias("text"),
                ),
            )
        ).alias("_links"),
    )
    if not unique:
        return explode_structs(absolute, ("page_id", "src_url"), "_links", "pos").select(
            "page_id", "src_url", "pos", "url", "text"
        )
    before = F.concat(
        F.array(F.lit(None).cast("string")), F.transform("_links", lambda a: a["url"])
    )
    pairs = F.slice(F.arrays_zip(F.col("_links").alias("a"), before.alias("b")), F.lit(1), F.size("_links"))
    first = F.filter(pairs, lambda p: p["b"].isNull() | (p["a"]["url"] != p["b"]))
    return absolute.select("page_id", "src_url", F.inline(F.transform(first, lambda p: p["a"]))).select(
        "page_id", "src_url", "pos", "url", "text"
    )


@dataclass(frozen=True)
class LinkRules:
    """Rules of one crawl; an empty list switches its rule off."""

    allow: Sequence[str] = ()
    deny: Sequence[str] = ()
    allow_domains: Sequence[str] = ()
    deny_domains: Sequence[str] = ()
    deny_extensions: Sequence[str] = DENIED_EXTENSIONS
    restrict_text: Sequence[str] = ()


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    """Is any of the regular expressions found in ``value``? Literal patterns are compiled once."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | value.rlike(pattern)
    return found


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    return host_in_domains(url_netloc(url), F.array(*[F.lit(d) for d in domains]))


def has_extension(url: Column, extensions: Sequence[str]) -> Column:
    return url_extension(url).isin(*[f".{e}" for e in extensions])


def reject_reason(rules: LinkRules, url: Column, text: Column) -> Column:
    """Name of the first rule a link breaks, NULL for an allowed link."""
    reason = F.when(~url_scheme_ok(url), "scheme")
    if rules.allow:
        reason = reason.when(~matches_any(url, rules.allow), "whitelist")
    if rules.deny:
        reason = reason.when(matches_any(url, rules.deny), "blacklist")
    if rules.allow_domains:
        reason = reason.when(~in_domains(url, rules.allow_domains), "allow_domain")
    if rules.deny_domains:
        reason = reason.when(in_domains(url, rules.deny_domains), "deny_domain")
    if rules.deny_extensions:
        reason = reason.when(has_extension(url, rules.deny_extensions), "extension")
    if rules.restrict_text:
        reason = reason.when(~matches_any(text, rules.restrict_text), "text")
    return reason


def link_audit(links: DataFrame, rules: LinkRules) -> DataFrame:
    return links.withColumn("reason", reject_reason(rules, F.col("url"), F.col("text")))


def allowed_links(links: DataFrame, rules: LinkRules) -> DataFrame:
    return links.filter(reject_reason(rules, F.col("url"), F.col("text")).isNull())


def whitelist(links: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return links.filter(matches_any(F.col("url"), patterns)) if patterns else links


def blacklist(links: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return links.filter(~matches_any(F.col("url"), patterns)) if patterns else links


def valid_scheme(links: DataFrame) -> DataFrame:
    return links.filter(url_scheme_ok(F.col("url")))


def deny_extensions(links: DataFrame, extensions: Sequence[str] = DENIED_EXTENSIONS) -> DataFrame:
    return links.filter(~has_extension(F.col("url"), extensions))


def restrict_text(links: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return links.filter(matches_any(F.col("text"), patterns)) if patterns else links


def restrict_domains(links: DataFrame, domains: DataFrame, keep: bool) -> DataFrame:
    """Keep (or drop) links whose host is in a table of domains or below one of them."""
    return allow_deny_domains(links, domains, None) if keep else allow_deny_domains(links, None, domains)


def host_verdicts(hosts: DataFrame, allow: DataFrame | None, deny: DataFrame | None) -> DataFrame:
    """(_host, allowed, denied) for distinct lower-case hosts that any table lists, by one join on their suffixes."""
    listed = []
    for table, allowed in ((allow, True), (deny, False)):
        if table is not None:
            suffix = F.lower("domain").alias("_suffix")
            listed.append(table.select(suffix, F.lit(allowed).alias("_allowed")).where("_suffix is not null").distinct())
    suffixes = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_suffix"))
    return (
        suffixes.join(reduce(DataFrame.unionByName, listed), "_suffix")
        .groupBy("_host")
        .agg(F.bool_or("_allowed").alias("allowed"), F.bool_or(~F.col("_allowed")).alias("denied"))
    )


def allow_deny_domains(links: DataFrame, allow: DataFrame | None, deny: DataFrame | None) -> DataFrame:
    """Links whose host is in a table of allowed domains or below one, if there is such a table, and in none of
    the denied ones.

    The links are stored with their hosts, so their source is read once. Each distinct host is then looked up once, and
    links meet the verdict by host; no side is forced to broadcast, and a hot host is split by the skew join. A
    NULL domain lists nothing; a link with a NULL URL or without a host is below no domain, so a deny table keeps it.
    """
    if allow is None and deny is None:
        return links
    stored = materialize(links.withColumn("_host", F.lower(url_netloc(F.col("url")))), "hosted")
    hosts = stored.select("_host").filter(F.col("_host") != "").distinct()
    verdicts = host_verdicts(hosts, allow, deny)
    if allow is None:
        return stored.join(verdicts.where("denied").select("_host"), "_host", "left_anti").drop("_host")
    return stored.join(verdicts.where("allowed and not denied").select("_host"), "_host", "left_semi").drop("_host")


def regex_rule_join(links: DataFrame, specs: DataFrame, spec: str = "spec") -> DataFrame:
    """Links of many crawls against the rules of their own crawl: an equi-join on the crawl name,
    then the patterns of the one matching row, each list joined into one alternation. A list with a back
    reference, whose number would change in there, with a named group, whose name may be there twice, or with a quotation, which may
    be open, is tested pattern by pattern. Adds ``reason``, NULL for an allowed link."""

    def alternation(patterns: str) -> Column:
        grouped = F.transform(patterns, lambda p: F.concat(F.lit("(?:"), p, F.lit(")")))
        plain = ~F.exists(patterns, lambda p: F.rlike(p, F.lit(r"\\([1-9QE]|k<)|\(\?<[a-zA-Z]|\(\?[a-zA-Z]*x")))
        return F.when(plain, F.array_join(grouped, "|"))

    rules = specs.select(
        F.col("name").alias(spec),
        "whitelist",
        "blacklist",
        alternation("whitelist").alias("_allow"),
        alternation("blacklist").alias("_deny"),
    )
    url = F.col("url")

    def hit(patterns: str, joined: str) -> Column:
        single = F.exists(patterns, lambda p: F.rlike(url, p))
        return (F.size(patterns) > 0) & F.when(F.col(joined).isNotNull(), F.rlike(url, F.col(joined))).otherwise(single)

    allowed = (F.size("whitelist") == 0) | hit("whitelist", "_allow")
    denied = hit("blacklist", "_deny")
    return (
        links.join(rules, spec)
        .withColumn(
            "reason",
            F.when(~url_scheme_ok(url), "scheme")
            .when(~allowed, "whitelist")
            .when(denied, "blacklist")
            .when(has_extension(url, DENIED_EXTENSIONS), "extension"),
        )
        .drop("whitelist", "blacklist", "_allow", "_deny")
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """(_host, _head, size, allow, residue) of the rules (host, allow, prefix).

    A rule without ``*`` and without ``$`` at its end is a plain prefix. Another one has its text up to there as head, and
    a regular expression that the whole must match. Rules with a null part and empty ones, which forbid nothing, are
    left out.
    """
    rule = F.col("prefix")
    body = F.regexp_replace(rule, r"\$\z", "")
    quoted = F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    anchored = rule.endswith("$")
    pattern = F.concat(F.lit("(?s)^\\Q"), quoted, F.lit("\\E"), F.when(anchored, "\\z").otherwise(""))
    return (
        robots.where("host is not null and allow is not null and prefix <> ''")
        .select(
            F.lower("host").alias("_host"),
            F.substring_index(body, "*", 1).alias("_head"),
            F.length(rule).alias("size"),
            "allow",
            F.when(anchored | rule.contains("*"), pattern).alias("residue"),
        )
        .distinct()
    )


def robots_filter(rows: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs that the robots rules (host, allow, prefix) of their host forbid.

    Hosts are compared in lower case. In a rule ``*`` stands for any characters and ``$`` at the end for the URL's end. The
    longest matching rule decides, allow wins a tie, no match allows.

    Each place (host, path and query) is looked up once. It asks for its beginnings of the lengths that its host's rules have,
    which are few, by an equality join, and only the rules with such a beginning are tested for the rest. Verdicts are
    maxima, so they combine before the shuffle; no host's rules or URLs are gathered.
    """
    place = F.regexp_extract(F.col(url), r"(?s)^[^/?#]*//[^/?#]*([^#]*)", 1)
    place = F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place))
    stored = materialize(rows.withColumn("_host", F.lower(url_netloc(F.col(url)))).withColumn("_place", place), "placed")
    rules = materialize(robots_rules(robots), "rules")
    lengths = rules.select("_host", F.length("_head").alias("_n")).distinct()
    asked = stored.select("_host", "_place").distinct().join(lengths, "_host").where(F.length("_place") >= F.col("_n"))
    heads = asked.select("_host", "_place", F.substr("_place", F.lit(1), F.col("_n")).alias("_head"))
    met = heads.join(rules, ["_host", "_head"]).where(F.col("residue").isNull() | F.rlike("_place", F.col("residue")))
    verdict = met.groupBy("_host", "_place").agg(F.max(F.struct("size", "allow")).alias("v"))
    return stored.join(verdict.where("not v.allow").select("_host", "_place"), ["_host", "_place"], "left_anti").drop("_host", "_place")


def depth_limit(rows: DataFrame, limit: int = 5) -> DataFrame:
    return rows.filter(F.col("depth") <= limit)
