"""Main text of web pages by text-to-tag ratio over parser events (operator 2).

The standard library's parser streams events; they are cut into lines, one per block element, each with its text, the tags
it took and the path of elements around it. The ratio of text to tags of the lines is smoothed with a Gaussian and split into
two clusters; the lines above the split are the content.

1. Scripts, controls and the like never count. Menus, headers, footers, sidebars, forms, dialogs and hidden parts, by element, role
   or style, are left out, unless the page is inside them: they hold all its articles and mains, or all its h1, or, where
   there are none of these outside, half of its prose or more.
2. Parts whose class or id names them adverts, notices, menus and the like go as soon as anything but headings is left; a name
   counts if its first or last word is a mark. If nothing is left, those that hold content lines stay. A mark on what holds
   an h1, main or article is none. Reader comments go in any case, unless they hold the page's h1 or main.
3. Lines with all their letters in links go outside <article> and <main>. On pages without these, the clusters choose the region:
   such lines stay from the first content line or heading to the last. Headings stay. All other blocks are returned, short
   ones too; where nothing else is left, link lines are.

White space (HTML's and other) inside a block becomes one space; character references are decoded; blocks are joined by
an empty line. Null, empty and text-free pages give an empty text. Markup that is broken or nested without end is read
in one pass: end tags without a start are skipped, open elements end with the page.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title button select option textarea input label legend "
    "iframe object embed canvas svg math audio video map noframes datalist output progress meter".split()
)
#: Left out unless the page is inside them.
ASIDE = frozenset("nav header footer aside form fieldset dialog menu search".split())
ENDS_P = BLOCKS - {"body", "caption", "head", "html", "legend", "optgroup", "option", "summary", "tbody", "td", "template", "tfoot", "th", "thead", "title", "tr"}
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]),
    "tfoot": frozenset(["thead", "tbody", "tr", "td", "th"]), "body": frozenset(["head"]),
}
LIMITS = {
    "li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
    "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"]), "tbody": frozenset(["table"]), "tfoot": frozenset(["table"]),
    "body": frozenset(),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert note".split())
# Words of class and id that mark parts outside the article, and words that may stand beside them in one name.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "adsbygoogle consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices "
    "pagination pager popup privacy promo promos promoted promotion recommended related respond replies reply share sharing sidebar sidebars "
    "signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons container content entry form global group holder home icon icons inner item items js left link "
    "links list main page panel post primary right secondary section site slot title top wrap wrapper zone".split()
)
#: Of these, parts that stay out however much of the page they hold.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
KNOWN = MARKS | NEUTRAL
#: Marks that count only beside known words, and words that make a name tell the state of the page instead of a part of it.
TOPICS = frozenset(["social"])
STATES = frozenset("has with without no is not open opened closed enabled disabled allowed off".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W_]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA = 1.0
#: Letters a tag of prose, where a page has no poorer lines to compare with.
PROSE = 10.0
#: Text, tags in it, number of the element around it, whether all its letters are in links.
Line = tuple[str, int, int, bool]


def _mark(names: str) -> str:
    """The mark that a class or id gives: of each of its names the first or last word counts."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and not STATES.intersection(words):
            known = KNOWN.issuperset(words)
            found |= {w for w in (words if known else (words[0], words[-1])) if w in MARKS and (known or w not in TOPICS)}
    return "readers" if found & READERS else "marked" if found else ""


class Lines(HTMLParser):
    """Lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, left out
        self.places: dict[str, list[int]] = {}  # of each element in open
        self.lines: list[Line] = []  # of what is not left out
        self.parts: list[str] = []
        self.linked = True  # no text outside links in parts
        self.tags = 0
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.marks: list[str] = [""]  # class words that may leave the element out
        self.aside: list[bool] = [False]  # whether element, role or style may

    def _flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            _, number, outside = self.open[-1] if self.open else ("", 0, False)
            if not outside:
                self.lines.append((text, self.tags, number, self.linked))
            self.tags = 0
        self.linked = True

    def _push(self, tag, attrs):
        parent = self.open[-1] if self.open else ("", 0, False)
        outside, mark, aside = parent[2], "", False
        if not outside:
            given = {k: v or "" for k, v in attrs}
            outside, aside = tag in DROPPED, self._aside(tag, given)
            if tag not in ("html", "body", "article", "main"):
                mark = _mark(f"{given.get('class', '')} {given.get('id', '')}")
            elif tag == "article" and _mark(given.get("class", "")) == "readers":
                mark = "readers"
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, len(self.names), outside))
        self.parents.append(parent[1])
        self.names.append("link" if tag == "a" and any(k == "href" for k, _ in attrs) else tag)
        self.marks.append(mark)
        self.aside.append(aside)

    def _pop(self):
        tag = self.open.pop()[0]
        self.places[tag].pop()
        if tag in BLOCKS:
            self.tags += 1

    def _aside(self, tag, given) -> bool:
        if tag in ASIDE and not (tag == "header" and (self.places.get("article") or self.places.get("main"))):
            return True
        if given.get("role", "").lower().strip() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
            return True
        return bool(_UNSEEN.search(given.get("style", "")))

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.tags += 1
            if tag == "hr":
                self._flush()
                self._close_p()
            elif tag in ("br", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCKS:
            self._flush()
            if tag in ENDS_P:
                self._close_p()
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag], LIMITS[tag])
        self.tags += 1
        self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.places.get("svg"):  # elsewhere the slash has no meaning
            self.handle_endtag(tag)

    def _close_p(self):
        self._close(("p",), ("table", "td", "th", "button", "object"))

    def _close(self, tags, limits):
        """Closes the innermost open element of ``tags`` that no element of ``limits`` shields."""
        at = self._last(tags)
        if at < 0 or self._last(limits) > at:
            return
        while at and self.open[at - 1][0] in tags:
            at -= 1
        while len(self.open) > at:
            self._pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        self.tags += 1
        if not self.places.get(tag):
            if tag == "p":
                self._flush()
            return
        at = self.places[tag][-1]
        if any(x[0] in BLOCKS for x in self.open[at:]):
            self._flush()
        while len(self.open) > at:
            self._pop()

    def handle_data(self, data):
        if not (self.open and self.open[-1][2]):
            self.parts.append(data)
            if self.linked and _LETTER.search(data):
                link = self.places.get("a")
                self.linked = bool(link) and self.names[self.open[link[-1]][1]] == "link"

    def end(self):
        if self.rawdata.startswith("<!--"):  # a comment without an end takes the rest
            self.rawdata = ""
        self.close()
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def split_level(values: np.ndarray) -> float:
    """Threshold between two clusters of one number (two-means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(100):
        middle = (low + high) / 2
        above = values >= middle
        if above.all() or not above.any():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _sums(page: Lines, weights: list[tuple[int, float]]) -> list[float]:
    """Weight in and below each element; parents have smaller numbers than their children."""
    below = [0.0] * len(page.names)
    for number, weight in weights:
        below[number] += weight
    for i in range(len(below) - 1, 0, -1):
        below[page.parents[i]] += below[i]
    return below


def _beside_removed(page: Lines) -> list[Line]:
    """The lines outside of menus, headers and other parts that element, role or style take out, as long as the page is not in them."""

    def held(names) -> list[float]:
        return _sums(page, [(i, 1) for i, name in enumerate(page.names) if name in names and page.marks[i] != "readers"])

    bodies, titles = held(("article", "main")), held(("h1",))
    prose = _sums(page, [(x[2], len(x[0])) for x in page.lines if not x[3]])
    out = [False] * len(page.names)
    for i in range(1, len(out)):
        whole = bodies[i] == bodies[0] if bodies[0] else titles[i] == titles[0] and 2 * prose[i] >= prose[0]
        out[i] = out[page.parents[i]] or page.aside[i] and not (whole or titles[0] and titles[i] == titles[0])
    return [x for x in page.lines if not out[x[2]]]


def _marked_removed(page: Lines, lines: list[Line]) -> list[Line]:
    """The lines outside parts marked by class."""
    heads = _sums(page, [(i, 1) for i, name in enumerate(page.names) if name in ("h1", "main", "article") and page.marks[i] != "readers"])
    own = _sums(page, [(i, 1) for i, name in enumerate(page.names) if name in ("h1", "main")])
    readers, part = [False] * len(page.names), [0] * len(page.names)  # part: the outermost marked element around
    for i in range(1, len(part)):
        readers[i] = readers[page.parents[i]] or page.marks[i] == "readers" and not own[i]
        part[i] = part[page.parents[i]] or (i if page.marks[i] == "marked" and not heads[i] else 0)
    kept = [x for x in lines if not readers[x[2]]]
    if kept and any(part[x[2]] for x in kept):
        heading = _below(page, HEADINGS)
        rich: set[int] = set()
        if not any(not (part[x[2]] or heading[x[2]] or x[3]) for x in kept):
            rich = {part[x[2]] for x, content in zip(kept, _content(kept, PROSE)) if content}
        kept = [x for x in kept if not part[x[2]] or part[x[2]] in rich]
    return kept if kept or heads[0] else lines


def _below(page: Lines, names) -> list[bool]:
    """Per element whether it is one of ``names`` or inside one."""
    inside = [False] * len(page.names)
    for i in range(1, len(inside)):
        inside[i] = page.names[i] in names or inside[page.parents[i]]
    return inside


def _content(lines: list[Line], alike: float = 0.0) -> np.ndarray:
    """Per line whether its smoothed ratio is above the split; where ratios are all alike, whether it has ``alike`` letters a tag."""
    size = np.array([len(x[0]) for x in lines], float)
    tags = np.array([x[1] for x in lines], float)
    ratio = smoothed(np.log1p(size / np.maximum(tags, 1)))
    return ratio >= split_level(ratio) if ratio.max() - ratio.min() > 0.5 else ratio >= np.log1p(alike)


def main_blocks(html: str | None) -> list[str]:
    """Blocks of the article, in page order."""
    if not html:
        return []
    page = Lines()
    page.feed(html)
    page.end()
    lines = _marked_removed(page, _beside_removed(page))
    if not lines:
        return []
    content, heading = _content(lines), _below(page, HEADINGS)
    inside = _below(page, ("article", "main"))
    stays = [inside[x[2]] for x in lines]
    if not any(stays):
        region = [i for i, (x, rich) in enumerate(zip(lines, content)) if heading[x[2]] or rich and not x[3]]
        stays = [bool(region) and region[0] <= i <= region[-1] for i in range(len(lines))]
    kept = [x[0] for x, stay in zip(lines, stays) if stay or heading[x[2]] or not x[3]]
    return kept or [x[0] for x in lines]


def _extract(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, start = [], 0, 0
            html = batch.column("html")
            for i in range(len(batch)):
                texts.append("\n\n".join(main_blocks(html[i].as_py())))
                size += len(texts[-1])
                if size > 1 << 23 or i + 1 == len(batch):
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in columns] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                        [*columns, "text", "n_chars"],
                    )
                    texts, size, start = [], 0, i + 1

    return run


def extract_text(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row of ``pages`` (html and ``columns``): the columns, text and n_chars (its code points)."""
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return pages.select(*(F.col(f"`{c}`") for c in columns), "html").mapInArrow(_extract(list(columns)), f"{fields}, text string, n_chars long")
