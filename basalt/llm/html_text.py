"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Each block of text (a paragraph, heading, list item, cell and so
on) is a line with its characters, its tags and the characters within links. A line's text-to-tag ratio counts characters outside links;
those of navigation, headers, footers, sidebars, notices, adverts, forms and comments, and of lines
that start with a copyright sign, count nothing, and those beside an article or main part
a fiftieth. The logarithms of the ratios are smoothed by a Gaussian over the lines. Two-means clustering of the lines with a ratio finds the threshold; the lines above it are the content region.

Lines with a ratio that the threshold cuts off, such as headings and short items, join the region if they are in its container (the
innermost division that holds most of the region). Where the page has no such division, those join that are directly in a division that
holds lines of the region, at most three lines from one of them. Lines without a ratio never join.

Defined results: null and empty pages give an empty text; if no line has a ratio, class names count nothing, and if none has one then,
the lines outside of boilerplate elements are the text; markup that never ends and is followed by no further `>` is left out, other markup that
never ends is read as far as it goes; pages of one line are that line; very long pages, deep and broken markup take time in proportion to
their length; null ids and repeated rows are kept; empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of HTML by their role.
SILENT = frozenset("script style noscript template head title svg math canvas object iframe audio video select datalist textarea button".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article main section div body td".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph, or an open element of their own kind within the same parent.
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
CLOSES_SELF = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = (CONTAINERS - {"td"}) | frozenset("ul ol dl table tbody thead tfoot".split())
#: Words of class and id values that mark what isn't content.
DISCUSSION = frozenset("comment comments disqus related replies reply respond".split())
MARKS = DISCUSSION | frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright footer header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted share sharing sidebar social sponsor sponsored subscribe subscription tags toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
SPACE = re.compile(r"\s+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Parts of a class that say that something is beside the element, or isn't.
BESIDE = frozenset("with without has no".split())
#: What a character counts for in a ratio if the page has an article or main part, and the line stands beside it.
BESIDE_MAIN = 0.02
#: The clusters must differ so much for the threshold to count: the upper mean over the lower.
APART = 1.5
#: Lines around one of the region that may join it where it has no division of its own.
GAP = 3
TAGGED, MARKED, TALK = 1, 2, 4


class Block:
    """A line: its characters, tags, link characters, innermost container, and what its surroundings say (main part, kinds of boilerplate)."""

    __slots__ = ("beside", "chars", "container", "links", "main", "tags")

    def __init__(self):
        self.chars: list[str] = []
        self.tags = self.links = self.container = self.beside = 0
        self.main = False

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.chars)).strip()

    def boilerplate(self, classes: bool) -> bool:
        """Whether all its characters count as links: by its elements, or also by their class names."""
        return bool(self.beside & TAGGED or (classes and self.beside))


class BlockParser(HTMLParser):
    """Splits a page into blocks. What is never shown, and what is marked within a line, becomes no block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # each open element: tag, whether it hides what is in it, and the state outside of it
        self.open: list[tuple[str, bool, int, int, bool]] = []
        self.counts: Counter[str] = Counter()
        self.block_tags: list[str] = []
        self.parents, self.names = [0], [""]  # containers by number, in order of their start
        self.hidden = self.container = self.beside = 0
        self.main = self.endless = self.endless_section = False
        self.blocks: list[Block] = [Block()]
        self.pending = 0

    def _finished(self, at: int, end: int) -> int:
        """Where parsing goes on after the markup at a place. Without a further `>` no markup ends, so nothing behind it is looked at again."""
        return len(self.rawdata) if end < 0 and self.rawdata.find(">", at) < 0 else end

    def parse_starttag(self, i: int) -> int:
        return self._finished(i, super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._finished(i, super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        # once a comment has no end, neither has any that starts later
        end = -1 if self.endless else super().parse_comment(i, report)
        self.endless = end < 0
        return self._finished(i, end)

    def parse_pi(self, i: int) -> int:
        return self._finished(i, super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        return self._finished(i, super().parse_html_declaration(i))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = -1 if self.endless_section else super().parse_marked_section(i, report)
        self.endless_section = end < 0
        return end

    def _new_block(self) -> None:
        if self.blocks[-1].chars:
            self.blocks.append(Block())

    def _pop(self) -> str:
        tag, hides, self.container, self.beside, self.main = self.open.pop()
        self.hidden -= hides
        self.counts[tag] -= 1
        if tag in BLOCKS:
            self.block_tags.pop()
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.hidden:
            self.pending += 1
        if tag in BLOCKS:
            if tag in CLOSES_P and self.block_tags and self.block_tags[-1] == "p":
                while self._pop() != "p":
                    pass
            self._new_block()
        if also := CLOSES_SELF.get(tag):
            while self.open and self.open[-1][0] not in KEEPS_OPEN and any(t[0] in also for t in self.open[-2:]):
                self._pop()
        if tag == "br" and not self.hidden:
            self.blocks[-1].chars.append(" ")
        if tag in VOID:
            return
        beside = self._beside(tag, attrs)
        hides = tag in SILENT or beside < 0 or (beside > 0 and tag not in BLOCKS)
        self.open.append((tag, hides, self.container, self.beside, self.main))
        self.counts[tag] += 1
        self.hidden += hides
        if tag in BLOCKS:
            self.block_tags.append(tag)
        if tag in CONTAINERS:
            self.parents.append(self.container)
            self.names.append(tag)
            self.container = len(self.names) - 1
        if tag in MAIN and not beside and not self.beside & (TAGGED | TALK):
            self.main, self.beside = True, 0  # the layout around an article says nothing about it
        self.beside |= max(beside, 0)

    def _beside(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """Which kinds of boilerplate the element is; -1 if it is never shown."""
        found = TAGGED if tag in BOILERPLATE else 0
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return -1
            if tag in ("html", "body"):
                continue
            if name in ("class", "id") and value:
                for one in value.split():
                    parts = {p.lower() for p in PART.findall(one)}
                    if not MARKS.isdisjoint(parts) and BESIDE.isdisjoint(parts) and (tag != "main" or not DISCUSSION.isdisjoint(parts)):
                        found |= MARKED if DISCUSSION.isdisjoint(parts) else TALK
            if name == "role" and value and value.lower() in ROLES:
                found |= TAGGED
        return found

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "b", "i", "span"):  # the slash means nothing on HTML's own elements
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.hidden:
            self.pending += 1
        if self.counts[tag]:
            while self._pop() != tag:
                pass
        if tag in BLOCKS:
            self._new_block()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        block = self.blocks[-1]
        block.chars.append(data)
        if not data.isspace():
            block.container, block.beside, block.main = self.container, self.beside, self.main
            block.tags, self.pending = block.tags + self.pending, 0
            block.links += len(data) if self.counts["a"] else 0


def ratios(sizes: np.ndarray, tags: np.ndarray, links: np.ndarray, worth: np.ndarray | float = 1.0) -> np.ndarray:
    """Characters outside links for each tag of the line, times what one is worth where the line stands."""
    return worth * np.maximum(sizes - links, 0) / np.maximum(tags, 1)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Each value as the Gaussian mean of those around it; the ends are repeated outwards."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def clusters(values: np.ndarray, rounds: int = 20) -> tuple[float, float]:
    """The means of the two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        above = values >= (low + high) / 2
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return low, high


def two_means(values: np.ndarray) -> float:
    """The threshold between the two clusters: halfway between their means."""
    return sum(clusters(values)) / 2


def content_region(levels: np.ndarray, floor: float) -> np.ndarray:
    """Which lines are in the upper cluster and above the floor; all above it, if the clusters aren't apart."""
    low, high = clusters(levels)
    return levels >= max((low + high) / 2 if high >= APART * low else low, floor)


def main_text(html: str, sigma: float = 1.0, link_share: float = 0.6) -> str:
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    lines = [(b, t) for b in parser.blocks if (t := b.text())]
    if not lines:
        return ""
    sizes, tags, links = (np.array(x, float) for x in zip(*((len(t), b.tags, b.links) for b, t in lines)))
    main = np.array([b.main for b, _ in lines])
    for classes in (True, False):  # without class names, where these leave nothing
        boilerplate = np.array([b.boilerplate(classes) or (not b.main and t.startswith("©")) for b, t in lines])
        has_main = bool((main & ~boilerplate & (sizes > links)).any())
        ratio = ratios(sizes, tags, links, np.where(boilerplate, 0, np.where(main | (not has_main), 1, BESIDE_MAIN)))
        if ratio.any():
            break
    else:
        return "\n".join(t for (_, t), beside in zip(lines, boilerplate) if not beside)
    levels, has_ratio = smooth(np.log1p(ratio), sigma), ratio > 0
    region = np.zeros(len(lines), bool)
    region[has_ratio] = content_region(levels[has_ratio], 0.0)

    # how much of the region each container holds: a container's number is greater than its parent's
    own = np.array([b.container for b, _ in lines])
    held = np.zeros(len(parser.names))
    np.add.at(held, own, sizes * region)
    total = held.sum()
    for n in range(len(held) - 1, 0, -1):
        held[parser.parents[n]] += held[n]
    content = max((n for n in range(len(held)) if held[n] >= 0.7 * total), default=0)
    if parser.names[content] in ("", "body"):
        joins = _near(own, region)
    else:
        inside = np.zeros(len(held), bool)
        inside[content] = True
        for n in range(content + 1, len(held)):
            inside[n] = inside[parser.parents[n]]
        joins = inside[own]
    joins &= has_ratio & (main | (not has_main)) & (has_main | (links <= link_share * sizes))
    return "\n".join(t for (_, t), keep in zip(lines, region | joins) if keep)


def _near(containers: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Lines that are at most GAP lines from one of the region in the same container."""
    near = np.zeros(len(region), bool)
    for k in range(1, min(GAP, len(region) - 1) + 1):
        same = containers[k:] == containers[:-k]
        near[k:] |= same & region[:-k]
        near[:-k] |= same & region[k:]
    return near


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of keep, text of every row of pages. Kept columns that are named id or text come with an underscore before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html or "") for html in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    kept = [F.col(f"`{c}`").alias(f"_{c}" if c.lower() in ("id", "text") else c) for c in keep]
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), *kept, F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])
    names = schema.names
    return rows.mapInArrow(run, schema)
