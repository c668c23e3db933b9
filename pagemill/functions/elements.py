"""Elements of HTML pages as intervals of their tags.

A page is cut at its tags, in the JVM. One pass over the names of the tags gives, for each element that a selector asks
for, the numbers of the tags where it starts and ends, and its text is what stands between them: so nested elements
have their whole text, one way does for all tags and selectors, and time is linear in the page. Only names of
tags leave the JVM, and whole tags where a selector asks for attributes.
"""

from __future__ import annotations

import html as stdlib_html
import re
import sys
from bisect import bisect_right
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.html import PARAGRAPH_CLOSERS, TAG_PATTERN, decode_entities
from pagemill.functions.text import has_text

_STEP = re.compile(r"(//?)([A-Za-z][\w-]*|\*)((?:\[@[\w-]+(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"))?\])*)")
_TEST = re.compile(r"\[@([\w-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"))?\]")
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PATTERN = r"^</?[a-zA-Z][^\s/>]*"

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset([*PARAGRAPH_CLOSERS, "caption", "menu", "template", "option"])
CELLS = ("table", "td", "th", "caption")
# A start tag ends the open elements of the first list that are inside all of the second.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *CELLS)),
    "dt": (("dt", "dd"), ("dl", *CELLS)),
    "dd": (("dt", "dd"), ("dl", *CELLS)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("td", "th", "tr"), ("table",)),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
# An end tag finds no element outside of these.
END_SCOPE = {
    "li": ("ul", "ol", "menu", *CELLS),
    "dt": ("dl", *CELLS),
    "dd": ("dl", *CELLS),
    **dict.fromkeys("td th tr tbody thead tfoot caption".split(), ("table",)),
    **dict.fromkeys("table body html".split(), ()),
}


class Step(NamedTuple):
    deep: bool
    tag: str
    tests: tuple[tuple[str, str | None], ...]

    def fits(self, name: str, attributes: Mapping[str, str]) -> bool:
        return self.tag in ("*", name) and all(k in attributes and v in (None, attributes[k]) for k, v in self.tests)


def parse_selector(xpath: str) -> list[Step]:
    """Steps of ``//a[@b='c']/d``-like paths."""
    steps, end = [], 0
    for found in _STEP.finditer(xpath.strip()):
        if found.start() != end:
            break
        tests = tuple((t[1].lower(), t[2] if t[2] is not None else t[3]) for t in _TEST.finditer(found[3]))
        steps.append(Step(found[1] == "//", found[2].lower(), tests))
        end = found.end()
    if not steps or end != len(xpath.strip()):
        raise ValueError(f"unsupported selector {xpath!r}")
    return steps


def attributes_of(tag: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case; of equal names the first counts."""
    out: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(tag, re.match(NAME_PATTERN, tag).end()):
        out.setdefault(a[1].lower(), stdlib_html.unescape(a[2] or a[3] or a[4] or ""))
    return out


class OpenElements:
    """The open elements of a page. Places of each tag are kept, so no search walks over them."""

    def __init__(self):
        self.tags: list[str] = []
        self.kept: list[tuple] = []  # what the caller keeps with each; ``cut`` needs rows of its result to end last
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def innermost(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first_above(self, tags: Sequence[str], floor: int) -> int:
        """Place of the outermost of ``tags`` beyond ``floor``, -1: none."""
        found = [p[at] for t in tags if (p := self.places.get(t)) and (at := bisect_right(p, floor)) < len(p)]
        return min(found, default=-1)

    def push(self, tag: str, kept: tuple) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCKS:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.kept.append(kept)

    def cut(self, place: int, number: int, out: list[int]) -> None:
        """End all elements from ``place`` on with the tag ``number``."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            for row in self.kept.pop()[-1]:
                out[row] = number


def ended_by_start(tag: str, opened: OpenElements) -> int:
    """Place from which the start of ``tag`` ends all open elements; as many as are open: none."""
    from_here = len(opened.tags)
    if tag in IMPLIED_ENDS:
        ends, scope = IMPLIED_ENDS[tag]
        place = opened.first_above(ends, opened.innermost(scope))
        from_here = place if place >= 0 else from_here
    if tag in HEADINGS and opened.blocks and opened.tags[opened.blocks[-1]] in HEADINGS:
        from_here = min(from_here, opened.blocks[-1])
    if tag in _P_ENDS and opened.places.get("p"):
        place = opened.first_above(("p",), opened.innermost(CELLS))
        from_here = min(from_here, place) if place >= 0 else from_here
    return from_here


def ended_by_end(tag: str, opened: OpenElements) -> int:
    """The same of an end tag: an unknown one, or one out of its scope, ends nothing."""
    if tag in BLOCKS:
        place, floor = opened.innermost(HEADINGS if tag in HEADINGS else (tag,)), opened.innermost(END_SCOPE.get(tag, CELLS))
    else:
        place, floor = opened.innermost((tag,)), opened.blocks[-1] if opened.blocks else -1
    return place if place > floor else len(opened.tags)


_P_ENDS = frozenset(PARAGRAPH_CLOSERS)


def intervals(tags: Sequence[str | None], selectors: Sequence[Sequence[Step]]) -> list[int]:
    """selector, position, first tag and last tag of each element that a selector finds, one after another, by
    selector and in document order. An open element ends with the page."""
    opened, found = OpenElements(), [[] for _ in selectors]
    ends: list[int] = []  # last tag of each found element
    tested = {s.tag for steps in selectors for s in steps if s.tests}
    asks_all = "*" in tested
    for number, raw in enumerate(tags):
        if not raw or raw[1:2] in "!?":
            continue
        if raw[1] == "/":
            opened.cut(ended_by_end(raw[2:].lower(), opened), number, ends)
            continue
        tag = re.match(NAME_PATTERN, raw)[0][1:].lower()
        opened.cut(ended_by_start(tag, opened), number, ends)
        attributes = attributes_of(raw) if asks_all or tag in tested else {}
        met, around, rows = [], [], []
        for k, steps in enumerate(selectors):
            above, beyond = (opened.kept[-1][0][k], opened.kept[-1][1][k] | opened.kept[-1][0][k]) if opened.tags else (0, 0)
            own = 0
            for j, step in enumerate(steps):
                if step.fits(tag, attributes):
                    before = (step.deep or not opened.tags) if j == 0 else (beyond if step.deep else above) >> (j - 1) & 1
                    own |= bool(before) << j
            met.append(own)
            around.append(beyond)
            if own >> (len(steps) - 1) & 1:
                rows.append(len(ends))
                found[k].append((number, len(ends)))
                ends.append(number)
        if tag not in VOID:
            opened.push(tag, (met, around, rows))
    opened.cut(0, len(tags), ends)
    return [x for k, rows in enumerate(found) for pos, (start, row) in enumerate(rows) for x in (k, pos, start, ends[row])]


def _finder(selectors: Sequence[Sequence[Step]]):
    # The helper travels with the plan, so workers need not have the package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    @F.pandas_udf("array<int>")
    def find(tags: pd.Series) -> pd.Series:
        return tags.map(lambda t: None if t is None else intervals(t, selectors))

    return find


def paragraph_arrays(pages: DataFrame, visible: str, xpaths: Mapping[int, str], kept: Sequence[str]) -> DataFrame:
    """``kept`` columns and ``paragraphs``, an array of (xp_idx, pos, origin, content) in the order of selectors and of the
    document, blanks dropped; an element that two selectors match is there twice. ``visible`` is HTML without hidden parts.
    A null page has no elements."""
    if not xpaths:
        none = F.array().cast("array<struct<xp_idx:int,pos:int,origin:string,content:string>>")
        return pages.select(*kept, none.alias("paragraphs"))
    numbers = list(xpaths)
    selectors = [parse_selector(x) for x in xpaths.values()]
    tested = sorted({s.tag for steps in selectors for s in steps if s.tests})
    name = lambda t: F.regexp_extract(t, NAME_PATTERN, 0)
    whole = "*" in tested

    def thin(tag: Column) -> Column:
        if whole:
            return F.when(tag.startswith("</"), name(tag)).otherwise(tag)
        asked = F.lower(F.substr(name(tag), F.lit(2))).isin(*tested) if tested else F.lit(False)
        return F.when(asked, tag).otherwise(name(tag))

    cut = pages.select(
        *kept,
        F.split(visible, TAG_PATTERN, -1).alias("_pieces"),
        F.regexp_extract_all(F.col(visible), F.lit(TAG_PATTERN), F.lit(0)).alias("_tags"),
    )
    thinned = cut.select(*kept, F.transform("_pieces", decode_entities).alias("_pieces"), F.transform("_tags", thin).alias("_tags"))
    found = thinned.select(*kept, "_pieces", _finder(selectors)(F.col("_tags")).alias("_found"))
    at = F.sequence(F.lit(0), F.expr("size(_found) div 4 - 1"))
    numbered = F.when(F.size("_found") > 0, at).otherwise(F.array().cast("array<int>"))
    places = F.transform(numbered, lambda i: F.slice("_found", i * 4 + 1, F.lit(4)))
    texts = F.transform(
        places,
        lambda p: F.struct(
            F.get(F.array(*[F.lit(n) for n in numbers]), F.get(p, F.lit(0))).alias("xp_idx"),
            F.get(p, F.lit(1)).alias("pos"),
            F.get(F.array(*[F.lit(x) for x in xpaths.values()]), F.get(p, F.lit(0))).alias("origin"),
            F.array_join(F.slice("_pieces", F.get(p, F.lit(2)) + 2, F.get(p, F.lit(3)) - F.get(p, F.lit(2))), "").alias("content"),
        ),
    )
    filled = found.select(*kept, texts.alias("_texts"))
    return filled.select(*kept, F.filter("_texts", lambda t: has_text(t["content"])).alias("paragraphs"))
