"""Main text of web pages: parser events, text-to-tag ratios of lines, Gaussian smoothing and threshold clustering.

The standard library's parser is fed a page and sends its events to a handler that holds the open elements and the lines so far. A
line is the text of one block: block elements begin and end lines, so pages written on one source line have lines too. Menus,
footers, forms, scripts and what a class, id or role names as advert, notice, comment or the like give no lines.

A line's ratio is its text outside links over the tags in it. The ratios are smoothed along the page, so that a short paragraph
among long ones is not lost, and two-means with the lower centre held at zero set the threshold: lines above it are content. The
content lines choose the region: from the page inwards, the element that holds most of their text, as long as one does; an article
or main element met on the way is the region as a whole, and its short lines and headings stay. Elsewhere the region runs over the
content lines, their siblings, and headings before them. Runs of lines that are links alone are menus.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold other blocks, and can be the region.
HOLDERS = frozenset("html body main article section div td th center fieldset details blockquote".split())
BLOCKS = (HOLDERS - {"td", "th"}) | HEADINGS | frozenset(
    "address aside caption dd dialog dl dt figcaption figure footer form header hgroup legend li menu nav ol option p pre search select summary table tbody tfoot thead title tr ul".split())
#: Never part of an article, wherever they stand.
OUT = frozenset("aside audio button canvas datalist dialog footer head iframe label map menu noscript object option picture script select style svg template textarea title video".split())
#: Not part of it, but an article or main element within counts again.
AROUND = frozenset("nav form header search".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Starting one of these ends an open one of the second, unless one of the third lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
        "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Words of class names and ids of what is no article; of the first kind also an article element of just that class.
NAMED_OUT = frozenset("""ad ads adsbygoogle advert advertisement advertising adverts sponsor sponsored promo promotion promoted teaser teasers related recommended recommendations comment comments commentlist
    commentform disqus respond replies popup modal overlay lightbox cookie cookies consent gdpr newsletter subscribe subscription signup login""".split())
NAMED_AROUND = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead toolbar pagination pager share sharing social notice notices alert banner skip copyright search
    widget widgets header""".split())
#: A header so qualified belongs to the article.
OF_ARTICLE = frozenset("article content entry page post section story".split())
ROLES_OUT = frozenset("alert alertdialog complementary contentinfo dialog".split())
ROLES_AROUND = frozenset("banner menu menubar navigation search toolbar".split())
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile("<[A-Za-z/!?]")


def outside(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 for an element that is no part of an article, 1 for one that is not but may hold it, 0 for others."""
    level = 2 if tag in OUT else 1 if tag in AROUND else 0
    if tag in ("html", "body") or level == 2:
        return level
    for name, value in attrs:
        if name == "hidden":
            return 2
        if not value:
            continue
        if name == "style" and _HIDDEN.search(value):
            return 2
        if name == "role":
            role = value.strip().lower()
            level = max(level, 2 if role in ROLES_OUT else 1 if role in ROLES_AROUND else 0)
        elif name in ("class", "id") and tag not in ("main", "h1"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if not words or words[0] in ("has", "no", "is", "with", "without", "js"):
                    continue
                if tag == "article":
                    if one.lower() in NAMED_OUT:
                        return 2
                    continue
                if not NAMED_OUT.isdisjoint(words):
                    return 2
                if not (named := NAMED_AROUND.intersection(words)) <= ({"header"} if OF_ARTICLE.intersection(words) else set()):
                    level = max(level, 1) if named else level
    return level


class Lines(HTMLParser):
    """The lines of a page: texts, tags, characters in links, and the element each stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, level out, node
        self.open: dict[str, int] = {}
        self.parents, self.tags = [0], ["html"]  # nodes: holders and blocks, in page order
        self.texts: list[str] = []
        self.ratios: list[float] = []
        self.linked: list[float] = []
        self.nodes: list[int] = []
        self.parts: list[str] = []
        self.many = self.in_links = 0
        self.level = self.node = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.texts.append(text)
            self.ratios.append(max(0, len(text) - self.in_links) / (self.many + 1))
            self.linked.append(self.in_links / len(text))
            self.nodes.append(self.node)
        self.parts = []
        self.many = self.in_links = 0

    def _pop(self, many: int) -> None:
        for tag, _, _ in self.stack[-many:]:
            self.open[tag] -= 1
        del self.stack[-many:]
        self.level, self.node = self.stack[-1][1:] if self.stack else (0, 0)

    def _end(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """Close the innermost open element of these, if none of ``within`` is open inside it."""
        if any(self.open.get(t) for t in tags):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in tags:
                    if any(t in BLOCKS for t, _, _ in self.stack[k:]):
                        self.flush()
                    return self._pop(len(self.stack) - k)
                if self.stack[k][0] in within:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.many += 1
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if self.open.get("head") and tag not in IN_HEAD and tag != "head":
            self._end({"head"})
        if tag in BLOCKS:
            self._end({"p"}, {"button", "table", "td", "th", "li", "object"} if tag == "p" else {"button", "td", "th", "object"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCKS:
            self.flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        self.many += 1
        level, node = self.level, self.node
        if tag in ("article", "main") and level == 1:
            level = 0
        mine = outside(tag, attrs)
        if mine == 1 and tag == "header" and (self.open.get("article") or self.open.get("main")):
            mine = 0
        level = max(level, mine)
        if tag in BLOCKS or tag in HOLDERS:
            node = len(self.tags)
            self.parents.append(self.node)
            self.tags.append(tag)
        self.stack.append((tag, level, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        if level != self.level:
            self.flush()
        self.level, self.node = level, node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.many += 1
        if tag == "br":
            self.parts.append(" ")
        if not self.open.get(tag):
            return
        if tag in BLOCKS:
            self.flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        before = self.level
        k = len(self.stack) - 1
        if self.stack[k][0] == tag:
            self.open[tag] -= 1
            self.stack.pop()
            level, node = self.stack[-1][1:] if k else (0, 0)
            if level != before:
                self.flush()
            self.level, self.node = level, node
            return
        while self.stack[k][0] != tag:
            k -= 1
        if any(n in BLOCKS and n != "p" for n, _, _ in self.stack[k + 1:]) and tag not in BLOCKS:
            return  # an inline end tag closes no block
        if len({x for _, x, _ in self.stack[k:]}) > 1 or any(n in BLOCKS for n, _, _ in self.stack[k + 1:]):
            self.flush()
        self._pop(len(self.stack) - k)
        if self.level != before:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.level:
            self.parts.append(data)
            if self.open.get("a"):
                self.in_links += len(data.strip())

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def unknown_decl(self, data: str) -> None:
        return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def page(self, html: str) -> None:
        """All of a page. A tag cut off by the end of the page is dropped; of one that a missing quote keeps open to the end, only the tag."""
        self.feed(html)
        while _PART.match(self.rawdata):
            rest, self.rawdata = self.rawdata, ""
            end = -1 if rest.startswith("<!--") else rest.find(">")
            if end < 0:
                break
            self.feed(rest[end + 1:])
        self.close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Each value's Gaussian mean over its neighbours, by the weights that lie on the page."""
    far = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-far, far + 1) / sigma) ** 2) if sigma > 0 else np.array([0.0, 1.0, 0.0])
    both = [np.convolve(x, kernel)[(len(kernel) - 1) // 2:][:len(x)] for x in (ratios, np.ones(len(ratios)))]
    return both[0] / both[1]


def threshold(values: np.ndarray) -> float:
    """Half the upper centre of two-means with the lower centre at zero."""
    centre = float(values.max(initial=0.0))
    while True:
        now = float(values[values >= centre / 2].mean()) if len(values) else 0.0
        if now >= centre:
            return centre / 2
        centre = now


def chosen(page: Lines, sigma: float = 1.0, most: float = 0.7) -> np.ndarray:
    """Which lines are the main text."""
    lines, nodes, tags, parents = len(page.texts), np.array(page.nodes, dtype=np.int64), page.tags, page.parents
    if not lines:
        return np.zeros(0, dtype=bool)
    smooth = smoothed(np.array(page.ratios), sigma)
    content = smooth >= threshold(smooth)
    linked = np.array(page.linked) >= 0.8
    held = np.bincount(nodes[content], np.array([len(t) for t in page.texts], dtype=float)[content], len(tags))
    last = np.arange(len(tags))
    best: dict[int, int] = {}
    for k in range(len(tags) - 1, 0, -1):  # children come after their parents
        p = parents[k]
        held[p] += held[k]
        last[p] = max(last[p], last[k])
        if tags[k] in HOLDERS and (p not in best or held[k] >= held[best[p]]):
            best[p] = k
    at = 0
    while tags[at] not in ("article", "main") and at in best and held[best[at]] >= most * held[at] > 0:
        at = best[at]
    if tags[at] == "main" and at in best and tags[best[at]] == "article" and held[best[at]] >= most * held[at] > 0:
        at = best[at]
    inside = (nodes >= at) & (nodes <= last[at])
    if tags[at] in ("article", "main"):
        keep = inside
    else:
        content &= inside
        where = np.flatnonzero(content)
        around = np.array([n if tags[n] in HOLDERS else parents[n] for n in nodes.tolist()])
        keep = content | inside & ~linked & np.isin(around, around[content])
        if len(where):
            keep[where[0]:where[-1]] |= inside[where[0]:where[-1]] & ~linked[where[0]:where[-1]]
        for k in range(lines - 2, -1, -1):
            keep[k] |= keep[k + 1] and tags[nodes[k]] in HEADINGS and parents[nodes[k]] <= at <= last[parents[nodes[k]]]
    # runs of three or more lines that are links alone
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (linked & keep).astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= 3:
            keep[a:b] = False
    return keep


def main_text(html: str, sigma: float = 1.0) -> str:
    """The blocks of the main text, joined by blank lines."""
    page = Lines()
    page.page(html)
    keep = chosen(page, sigma)
    return "\n\n".join(t for t, k in zip(page.texts, keep.tolist(), strict=True) if k)


def _extract(sigma: float):
    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, sigma) for h in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                          names=["page_id", *b.schema.names[2:], "text", "n_chars"])
    return each


def extract_main(pages: DataFrame, keep: tuple[str, ...] = ("url",), sigma: float = 1.0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id``, the columns to ``keep``, ``text`` and ``n_chars`` (its code points) of each page: blocks in page order joined by an
    empty line, references decoded, white space inside a block one space. ``sigma`` is the width of smoothing in lines.

    A null or empty page, and one without text, gives an empty text. Null ids are kept, repeated rows give a row each. A page may be
    of any length and cut off anywhere; unclosed and wrongly nested elements are closed as browsers do. Columns not kept are ignored;
    a kept one must not be named like a result. No rows give no rows."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), *(F.col(c).cast("string").alias(c) for c in keep))
    return source.mapInArrow(by_batch(_extract, sigma), f"page_id long, {''.join(f'`{c}` string, ' for c in keep)}text string, n_chars long")
