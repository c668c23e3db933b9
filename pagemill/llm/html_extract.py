"""Main text of pages by consensus of their hosts.

Pages of a host share a template. Every page's containers are scored; the pages of a host vote, in Spark, on the
generalised path (tags and classes of the block elements, digits made one) of the container that holds the article; then
each page is read again with its host's winner. A page that lacks it is read with its own best container.

HTML is cut into blocks of text once, and only these are stored and read again. Time and memory are linear in the page,
whatever its markup: paths are a tree, a block names its node, and scores are summed from the leaves up.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.elements import OpenElements, ended_by_end, ended_by_start
from pagemill.llm.arrow import map_batches
from pagemill.llm.url_filter import host_of
from pagemill.session import materialize

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
# Elements that never hold an article's text.
SKIP = frozenset(
    "script style noscript template iframe object svg math canvas nav header footer aside form button select "
    "textarea input dialog menu head title audio video".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that hold an article's blocks, and so may be its container; others are blocks themselves.
HOLDERS = frozenset("article body center div html main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks that hold running text themselves: a word in their class is more often about the text than around it.
TEXTUAL = HEADINGS | frozenset("p blockquote pre".split())
# Words of classes and ids that name what surrounds an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side rail widget widgets footer header masthead topbar toolbar comment comments disqus reply "
    "replies respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended pagination pager copyright legal disclaimer form search skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_VALUE = re.compile(r"=\s*\Z")
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


SMALL_SHARE = 0.2


def _cut(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether the element is left out with all it holds: by its tag, its role, or because it is hidden."""
    if tag in SKIP and not (tag == "header" and inside_article):
        return True
    return attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"


def _named(tag: str, attributes: dict[str, str], inside_article: bool) -> str:
    """How classes and id name the element as surroundings: "whole" if one of them is made of such words alone,
    "part" if one has such a word among others, else "". What follows has, no, not, with or without names what is
    or isn't beside the element, so it doesn't count. Paragraphs, headings and inline elements are asked for whole classes
    only, not for ids: ``hidden-gem`` and ``id=search`` tell what they are about."""
    if tag in ("html", "body", "main", "article"):
        return ""
    own_text = tag in TEXTUAL or tag not in BLOCK
    out = ""
    for token in (attributes.get("class", "") + " " + ("" if own_text else attributes.get("id", ""))).lower().split():
        words = []
        for w in _WORD.findall(token):
            if w in ("has", "no", "not", "with", "without"):
                words.append("")
                break
            words.append(w)
        around = [w in AROUND and not (w == "header" and inside_article) and not (tag == "h1" and w != "hidden") for w in words]
        if around and all(around):
            return "whole"
        if any(around) and not own_text:
            out = "part"
    return out


class _Region:
    """An element that is named as surroundings: what speaks for reading it all the same."""

    def __init__(self, whole: bool, above: int):
        self.whole, self.above = whole, above  # above: number of the region around it, -1: none
        self.landmark, self.skipped, self.gone = False, False, False
        self.running = self.linked = self.length = 0


def _skip_regions(regions: list[_Region], found: list[tuple[int, str, int, int]]) -> None:
    """Marks the regions to skip: those without an article, main or h1, those that are mostly links, and those
    with a small share of the running text outside the others. If next to no running text is left, the first region that
    is named in part and holds a good share of the page's is read. Inner regions come later in the list."""
    good = [len(t) if 2 * linked < len(t) else 0 for _, t, linked, _ in found]

    def left() -> int:
        for r in regions:
            r.gone = r.skipped or (r.above >= 0 and regions[r.above].gone)
        return sum(n for n, (_, _, _, own) in zip(good, found, strict=True) if own < 0 or not regions[own].gone)

    for n, (_, text, linked, own) in zip(good, found, strict=True):
        if own >= 0:
            r = regions[own]
            r.running, r.linked, r.length = r.running + n, r.linked + linked, r.length + len(text)
    for r in reversed(regions):
        r.skipped = not r.landmark or 2 * r.linked >= r.length
        if r.above >= 0:
            outer = regions[r.above]
            outer.landmark = outer.landmark or r.landmark
            if not r.skipped:
                outer.running, outer.linked, outer.length = outer.running + r.running, outer.linked + r.linked, outer.length + r.length
    total = left()
    for r in regions:
        r.skipped = r.skipped or r.running < SMALL_SHARE * total
    if left() < SMALL_SHARE / 2 * sum(good):
        for r in regions:
            if not r.whole and 2 * r.linked < r.length and r.running >= SMALL_SHARE * sum(good):
                while r is not None:
                    r.skipped, r = False, regions[r.above] if r.above >= 0 else None
                break
        left()


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(attributes.get("class", "").split())
    return ".".join([tag, *(_DIGITS.sub("0", c.replace("/", "-")) for c in classes)])


class Page(NamedTuple):
    """Paths as a tree, a node after its parent (-1: none), and blocks (node, text, characters of it in links) in page
    order."""

    parents: list[int]
    steps: list[str]
    blocks: list[tuple[int, str, int]]


class _Quotes:
    """Where quoted values end. A quote that never ends is asked for once."""

    def __init__(self, html: str):
        self.html, self.none = html, {'"': len(html) + 1, "'": len(html) + 1}

    def after(self, quote: str, at: int) -> int:
        """Place after the quote that ends a value from ``at`` on, -1: there is none."""
        if at >= self.none[quote]:
            return -1
        end = self.html.find(quote, at)
        if end < 0:
            self.none[quote] = min(self.none[quote], at)
        return end + 1 if end >= 0 else -1

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` of a tag whose name ends at ``at``, the page's end if there is none. A quote counts only
        as the start of a value; if it is never closed, the tag ends with the next ``>``."""
        while True:
            stop = _STOP.search(self.html, at)
            if stop is None:
                return len(self.html)
            if stop[0] == ">":
                return stop.start()
            at = stop.end()
            before = self.html[max(0, stop.start() - 8) : stop.start()]
            if _VALUE.search(before):
                close = self.after(stop[0], at)
                at = close if close >= 0 else at


def parse(html: str) -> Page:
    """Blocks of text outside what surrounds an article. Texts have their references decoded and white space made single.
    Elements that are only named as surroundings are left out by what they hold (:func:`_skip_regions`).

    Line breaks and inline elements don't end a block. Broken markup is read as browsers do in the main:
    unknown end tags are passed over, an end tag closes what is open inside, open elements end with the page, and a tag
    whose quotation never ends stops at the next ``>``.
    """
    out: list[tuple[int, str, int, int]] = []
    raws: list[tuple[int, str]] = []  # blocks of one number are cut by inline elements only
    number = 0
    opened = OpenElements()  # keeps of each element: node, skipped, region, whether it is a link
    regions: list[_Region] = []
    parents, steps, nodes = [-1], ["html"], {}
    text: list[str] = []
    linked = links = 0
    top = (0, False, -1, False, ())

    def flush(inline: bool = False) -> None:
        nonlocal linked, number
        if text:
            raw = "".join(text)
            joined = _SPACE.sub(" ", raw).strip()
            own = opened.kept[-1] if opened.tags else top
            out.append((own[0], joined, min(linked, len(joined)), own[2]))
            raws.append((number, raw))
            text.clear()
        linked = 0
        number += not inline

    def pop(place: int) -> None:
        nonlocal links
        while len(opened.tags) > place:
            own = opened.kept[-1]
            above = opened.kept[-2] if len(opened.tags) > 1 else top
            if opened.tags[-1] in BLOCK:
                flush()
            elif own[2] != above[2]:
                flush(inline=True)
            links -= own[3]
            opened.cut(len(opened.tags) - 1, 0, [])

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not (opened.tags and opened.kept[-1][1]):
            decoded = unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if links:
                linked += len(decoded)

    at, end, quotes = 0, len(html), _Quotes(html)
    while at < end:
        less = html.find("<", at)
        if less < 0:
            add(html[at:])
            break
        if html.startswith("<!--", less):
            add(html[at:less])
            close = html.find("-->", less + 4)
            at = close + 3 if close >= 0 else end
            continue
        if html[less + 1 : less + 2] in ("!", "?"):
            add(html[at:less])
            close = html.find(">", less)
            at = close + 1 if close >= 0 else end
            continue
        ending = html.startswith("</", less)
        name = _NAME.match(html, less + 1 + ending)
        if name is None:
            add(html[at : less + 1])
            at = less + 1
            continue
        add(html[at:less])
        close = quotes.tag_end(name.end())
        inner, at, tag = html[name.end() : close], close + 1, name[0].lower()
        if ending:
            pop(ended_by_end(tag, opened))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        pop(ended_by_start(tag, opened))
        attributes: dict[str, str] = {}
        if inner.strip():
            for a in _ATTRIBUTE.finditer(inner):
                attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        node, skipped, region, _, _ = opened.kept[-1] if opened.tags else top
        inside = bool(opened.places.get("article") or opened.places.get("main"))
        cut = skipped or _cut(tag, attributes, inside)
        named = "" if cut else _named(tag, attributes, inside)
        if tag in BLOCK:
            flush()
            key = (node if opened.tags else -1, _step(tag, attributes))
            if key not in nodes:
                nodes[key] = len(parents)
                parents.append(key[0])
                steps.append(key[1])
            node = nodes[key]
        elif named:
            flush(inline=True)
        if named:
            regions.append(_Region(named == "whole", region))
            region = len(regions) - 1
        elif tag in ("article", "main", "h1") and not cut and not AROUND.intersection(_WORD.findall(attributes.get("class", "").lower())):
            if region >= 0:
                regions[region].landmark = True
        if not inner.rstrip().endswith("/") or tag not in ("svg", "path"):
            opened.push(tag, (node, cut, region, tag == "a", ()))
            links += tag == "a"
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = stop.start() if stop else end
            add(html[at:stop])
            at = stop
    pop(0)
    flush()
    if regions:
        _skip_regions(regions, out)
    kept: list[tuple[int, list[str], int]] = []
    last = -1
    for (node, _, n, own), (count, raw) in zip(out, raws, strict=True):
        if own >= 0 and regions[own].gone:
            continue
        if count == last:
            kept[-1][1].append(raw)
            kept[-1] = (kept[-1][0], kept[-1][1], kept[-1][2] + n)
        else:
            kept.append((node, [raw], n))
        last = count
    texts = ((node, _SPACE.sub(" ", "".join(parts)).strip(), n) for node, parts, n in kept)
    return Page(parents, steps, [(node, t, min(n, len(t))) for node, t, n in texts if t])


def scores(page: Page) -> list[float]:
    """Score of each container's path, 0 for what is none: the share of the page's running text that it holds, times how
    much of its own text is running text; articles and mains count more, and of equals the deeper one. Running
    text is a block that is mostly outside links, weighed by its length; an h1 counts even if it is a link, other
    linked headings count neither as running text nor as links. Elements of ``HOLDERS`` are containers; one
    without blocks inside is only if its path is met once, since else it stands for paragraphs."""
    n = len(page.parents)
    tags = [s.split(".")[0] for s in page.steps]
    heading, article, depth = [""] * n, [False] * n, [1] * n
    for k, up in enumerate(page.parents):
        heading[k] = tags[k] if tags[k] in HEADINGS else (heading[up] if up >= 0 else "")
        article[k] = tags[k] in ("article", "main") or (up >= 0 and article[up])
        depth[k] = depth[up] + 1 if up >= 0 else 1
    met, running, whole, holds = [0] * n, [0] * n, [0] * n, [False] * n
    total = 0
    for k, text, linked in page.blocks:
        met[k] += 1
        good = len(text) if 2 * linked < len(text) or heading[k] == "h1" else 0
        if heading[k] and not good:
            continue
        total += good
        running[k] += good
        whole[k] += len(text)
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        if up >= 0:
            running[up] += running[k]
            whole[up] += whole[k]
            holds[up] = holds[up] or holds[k] or met[k] > 0
    out = [0.0] * n
    for k in range(n):
        if running[k] and tags[k] in HOLDERS and (holds[k] or met[k] <= 1):
            out[k] = (1.3 if article[k] else 1.0) * (running[k] / total) ** 2 * (running[k] / whole[k]) * (1 + 0.001 * min(depth[k], 100))
    return out


def path_ids(page: Page) -> list[int]:
    """A number of 64 bits for each path, from its own step and the number of the path above."""
    out: list[int] = []
    for up, step in zip(page.parents, page.steps, strict=True):
        above = out[up].to_bytes(8, "little", signed=True) if up >= 0 else b""
        out.append(int.from_bytes(blake2b(above + step.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
    return out


_BLOCKS = (
    "page_id long, url string, host string, paths array<long>, parents array<int>, places array<int>, texts array<string>, best long, "
    "candidates array<struct<path:long,depth:int,votes:long>>"
)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of each row (page_id, url, host, html), the paths of their tree, the page's own best container, and its votes:
    each container with more than a quarter of the best score, as parts in a million of the best."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for html in batch.column(3):
            page = parse(html.as_py() or "")
            ids, own = path_ids(page), scores(page)
            most = max(own)
            best = max(range(len(own)), key=lambda k: (own[k], ids[k])) if most else None  # noqa: B023
            depth = [1] * len(ids)
            for k, up in enumerate(page.parents):
                depth[k] = depth[up] + 1 if up >= 0 else 1
            told = [{"path": ids[k], "depth": depth[k], "votes": round(1_000_000 * s / most)} for k, s in enumerate(own) if s > most / 4]
            rows.append((ids, page.parents, [b[0] for b in page.blocks], [b[1] for b in page.blocks], None if best is None else ids[best], told))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64())
        vote = pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("votes", pa.int64())])
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((*kinds, pa.list_(vote)))]
        names = ["page_id", "url", "host", "paths", "parents", "places", "texts", "best", "candidates"]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names)

    return map_batches(pages.select("page_id", "url", "host", "html"), run, _BLOCKS)


def winners(stored: DataFrame) -> DataFrame:
    """(host, winner): the path with the most votes; of equals the one nearest to the root, then the greatest number."""
    each = stored.select("host", F.inline("candidates"))
    counted = each.groupBy("host", "path", "depth").agg(F.sum("votes").alias("votes"))
    best = F.max_by("path", F.struct(F.col("votes"), -F.col("depth"), F.col("path")))
    return counted.groupBy("host").agg(best.alias("winner"))


def inside(paths: list[int], parents: list[int], container: int | None) -> list[bool]:
    """Which paths are the container or below it; all false if it is not there."""
    out: list[bool] = []
    for own, up in zip(paths, parents, strict=True):
        out.append(own == container or (up >= 0 and out[up]))
    return out


def html_extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``; other columns are left out, whatever their names.

    A null or text-free page has an empty text. Null URLs and those without ``://`` share the empty host.
    Repeated rows vote and are read each for itself. Pages are cut into blocks once; the blocks are stored, the
    hosts' winners are sums over their votes, and the blocks meet their host's winner in a join that Spark chooses by the
    size of the table of winners; HTML goes no further than the cutting.
    """
    named = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        host_of(F.col(url)).alias("host"),
        F.col(html).cast("string").alias("html"),
    )
    stored = materialize(page_blocks(named), "blocks")
    chosen = materialize(winners(stored), "winners")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for paths, parents, places, said, best, winner in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            used = set(places)
            within = inside(paths, parents, winner) if winner is not None else []
            if not any(within[k] for k in used if within):
                within = inside(paths, parents, best) if best is not None else [True] * len(paths)
            texts.append("\n".join(t for k, t in zip(places, said, strict=True) if within[k]))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    joined = stored.join(chosen, "host", "left").select("page_id", "url", "paths", "parents", "places", "texts", "best", "winner")
    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")
