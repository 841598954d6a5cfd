"""Element picking on stored HTML, for selectors that plain patterns cannot express.

The only Python pass of the library: it finds elements and hands over their text or attributes,
once per page for all fields. What the values mean is decided by column expressions afterwards.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the HTML standard, as far as they matter here.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW_TEXT = {t: re.compile(f"</{t}", re.I) for t in ("script", "style", "textarea", "title")}
_BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "tr", "ul",
})

_P_STOP = frozenset({"div", "li", "td", "article", "section", "body"})
_LI_STOP = frozenset({"ul", "ol"})

# A comment or a tag; quoted attribute values may hold ">", stray quotes are let pass.
_ATTRS = r"""(?:[^<>"']*(?:"[^"]*"|'[^']*'))*[^<>"']*|[^<>]*"""
_TAG = re.compile(
    rf"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/<>"']*)(?=[\s/<>"'])({_ATTRS})>|<[!?][^<>]*>""", re.S
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"<(script|style|head|template|noscript)\b.*?(?:</\1\s*>|$)", re.S | re.I)

# Stand-ins for line breaks while text is put together: <br>, edge of a block, edge of a paragraph.
_BR, _EDGE, _PARAGRAPH = "\x01", "\x02", "\x03"
_SPACES = re.compile(r"[\t\n\r\f][ \t\n\r\f]*| [ \t\n\r\f]+")
_MAYBE_HIDDEN = re.compile(r"<[sShHtTnN][cCtTeEoO][rRyYaAmMsS]").search
_BREAKS = re.compile(r" ?[\x01\x02\x03][ \x01\x02\x03]*")


_STANDS_FOR = {**dict.fromkeys(_BLOCK, _EDGE), "br": _BR, "p": _PARAGRAPH}


def _as_break(m: re.Match) -> str:
    tag = m[2]
    return _STANDS_FOR.get(tag.lower(), "") if tag else ""


def _as_newlines(m: re.Match) -> str:
    breaks = 0
    for c in m.group():
        breaks = breaks + 1 if c == _BR else max(breaks, (c == _EDGE) + 2 * (c == _PARAGRAPH))
    return "\n" * breaks


_OUT_ROWS = 256  # rows per output batch


@dataclass(frozen=True)
class Css:
    """One step of a selector: tag, class tokens, and an attribute that is present, equal to a
    value, or contains one of several."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    attr: str = ""
    equals: str | None = None
    contains: tuple[str, ...] = ()

    def matches(self, attrs: Mapping[str, str]) -> bool:
        if self.classes and not set(self.classes) <= set(attrs.get("class", "").split()):
            return False
        if not self.attr:
            return True
        value = attrs.get(self.attr)
        if value is None or (self.equals is not None and value != self.equals):
            return False
        return not self.contains or any(part in value for part in self.contains)


@dataclass(frozen=True)
class First:
    """Text (or attribute) of the first match; null for none. ``within`` narrows the search to
    the first match of another selector. An empty ``path`` is the element itself. The text is
    without that of further matches inside the match."""

    path: tuple[Css, ...] = ()
    attr: str = ""
    within: tuple[Css, ...] = ()
    spark_type = T.StringType()
    arrow_type = pa.string()


@dataclass(frozen=True)
class All:
    """Texts of all matches; of a match that holds others, the text without theirs."""

    path: tuple[Css, ...]
    spark_type = T.ArrayType(T.StringType())
    arrow_type = pa.list_(pa.string())


@dataclass(frozen=True)
class Count:
    """Number of matches inside the first match of ``within``; null if that is missing."""

    path: tuple[Css, ...]
    within: tuple[Css, ...] = ()
    spark_type = T.IntegerType()
    arrow_type = pa.int32()


@dataclass(frozen=True)
class Exists:
    """Whether there is a match, one containing one of ``texts`` if given."""

    path: tuple[Css, ...]
    texts: tuple[str, ...] = ()
    spark_type = T.BooleanType()
    arrow_type = pa.bool_()


@dataclass(frozen=True)
class Each:
    """Several picks inside every match, in page order. A match inside another with the same
    values all over is left out, so that nesting does not multiply text."""

    path: tuple[Css, ...]
    picks: Mapping[str, First | Count] = field(default_factory=dict)

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(T.StructType([T.StructField(n, p.spark_type) for n, p in self.picks.items()]))

    @property
    def arrow_type(self) -> pa.DataType:
        return pa.list_(pa.struct([(n, p.arrow_type) for n, p in self.picks.items()]))


Pick = First | All | Count | Exists | Each


class _Page:
    """Elements of a page in page order: tag, raw attributes, where they and their content start and
    end, and the end of their descendants. Attributes and text are read when a pick asks for them.

    Each selector step is matched once per page; what lies inside an element is then found by
    bisection, so the time of all picks together grows with the page, however it is nested.
    """

    def __init__(self, html: str):
        self.html = html
        self.tags: list[str] = []
        self.raw_attrs: list[str] = []
        self.begin: list[int] = []
        self.content: list[list[int]] = []
        self.end: list[int] = []
        self.by_tag: dict[str, list[int]] = {}
        self._open: list[int] = []
        self._depths: dict[str, list[int]] = {}  # of each tag among the open elements
        self._steps: dict[int, list[int]] = {}  # by identity of the step, which is quicker than by value
        self._texts: dict[tuple[int, int], str] = {}
        at = 0
        while m := _TAG.search(html, at):
            at = m.end()
            slash, name, attrs = m.groups()
            if not name:
                continue
            tag = name.lower()
            if slash:
                # An inline end tag does not reach out of the block it stands in.
                if tag not in _VOID:
                    self._close(tag, m.start(), stop=frozenset() if tag in _BLOCK else _BLOCK)
                continue
            self._start(tag, attrs, m)
            if tag in _RAW_TEXT:
                stop = _RAW_TEXT[tag].search(html, at)
                at = stop.start() if stop else len(html)
        while self._open:
            self._close_top(len(html))

    def _start(self, tag: str, attrs: str, m: re.Match) -> None:
        if tag in _BLOCK:
            self._close("p", m.start(), stop=_P_STOP)
        if tag == "li":
            self._close("li", m.start(), stop=_LI_STOP)
        i = len(self.tags)
        self.tags.append(tag)
        self.raw_attrs.append(attrs)
        self.begin.append(m.start())
        self.content.append([m.end(), m.end()])
        self.end.append(i + 1)
        if tag not in self.by_tag:
            self.by_tag[tag], self._depths[tag] = [], []
        self.by_tag[tag].append(i)
        if tag not in _VOID:
            self._depths[tag].append(len(self._open))
            self._open.append(i)

    def _close_top(self, at: int) -> None:
        i = self._open.pop()
        self._depths[self.tags[i]].pop()
        self.end[i] = len(self.tags)
        self.content[i][1] = at

    def _close(self, tag: str, at: int, stop: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``tag`` and what is open inside, unless ``stop`` is in between."""
        depths = self._depths.get(tag)
        if not depths:
            return
        depth = depths[-1]
        if depth + 1 < len(self._open) and stop and any(d[-1] > depth for t in stop if (d := self._depths.get(t))):
            return
        while len(self._open) > depth:
            self._close_top(at)

    def attrs(self, i: int) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, double, single, bare in _ATTR.findall(self.raw_attrs[i]):
            found.setdefault(name.lower(), unescape(double or single or bare))
        return found

    def text(self, i: int, without: list[int] = ()) -> str:
        """Text much as a browser shows it: spaces squeezed, <br> and blocks as line breaks.
        ``without``: elements inside whose text is left out, in page order."""
        start, stop = self.content[i]
        parts = []
        for k in without:
            parts += [self.html[start : self.begin[k]], "<div>"]
            start = max(start, self.content[k][1])
        inner = "".join([*parts, self.html[start:stop]]) if parts else self.html[start:stop]
        if "<" in inner:
            inner = _TAG.sub(_as_break, _HIDDEN.sub("", inner) if _MAYBE_HIDDEN(inner) else inner)
        shown = _SPACES.sub(" ", inner)
        if _BR in shown or _EDGE in shown or _PARAGRAPH in shown:
            shown = _BREAKS.sub(_as_newlines, shown)
        return unescape(shown.strip(" \n")) if "&" in shown else shown.strip(" \n")

    def _matches(self, step: Css, i: int) -> bool:
        raw = self.raw_attrs[i]
        # Most elements fail here, before their attributes are taken apart.
        if not raw or step.classes and step.classes[0] not in raw or step.attr and step.attr not in raw.lower():
            return False
        return step.matches(self.attrs(i))

    def _step(self, step: Css) -> list[int]:
        """All elements of the page that match a step, in page order."""
        found = self._steps.get(id(step))
        if found is None:
            own = self.by_tag.get(step.tag, []) if step.tag else range(len(self.tags))
            plain = not step.classes and not step.attr
            found = self._steps[id(step)] = own if plain else [i for i in own if self._matches(step, i)]
        return found

    def _outermost(self, hits: list[int]) -> list[int]:
        """Of elements in page order, those that lie in no other of them."""
        out: list[int] = []
        for i in hits:
            if not out or i >= self.end[out[-1]]:
                out.append(i)
        return out

    def find(self, path: tuple[Css, ...], span: tuple[int, int]) -> list[int]:
        """Elements in ``span`` matching a chain of descendant steps, in page order."""
        spans, hits = [span], []
        for n, step in enumerate(path):
            if n:
                spans = [(i + 1, self.end[i]) for i in self._outermost(hits)]
            own = self._step(step)
            hits = [i for a, b in spans for i in own[bisect_left(own, a) : bisect_left(own, b)]]
        return hits

    def first(self, path: tuple[Css, ...], span: tuple[int, int]) -> int | None:
        if len(path) > 1:
            return next(iter(self.find(path, span)), None)
        own = self._step(path[0])
        k = bisect_left(own, span[0])
        return own[k] if k < len(own) and own[k] < span[1] else None

    def _nested(self, hits: list[int]) -> dict[int, list[int]]:
        """For each match, the outermost other matches inside it."""
        inside: dict[int, list[int]] = {i: [] for i in hits}
        above: list[int] = []
        for i in hits:
            while above and i >= self.end[above[-1]]:
                above.pop()
            if above:
                inside[above[-1]].append(i)
            above.append(i)
        return inside

    def _own_text(self, i: int, step: Css | None) -> str:
        """Text of a match without that of the step's further matches inside it, made once."""
        key = (i, id(step))
        if key not in self._texts:
            inner, own = [], self._step(step) if step else []
            k = bisect_left(own, i + 1)
            while k < len(own) and own[k] < self.end[i]:
                inner.append(own[k])
                k = bisect_left(own, self.end[own[k]], k)
            self._texts[key] = self.text(i, inner)
        return self._texts[key]

    def pick(self, p: Pick, root: int | None = None):
        span = (0, len(self.tags)) if root is None else (root + 1, self.end[root])
        if isinstance(p, Exists):
            hits = self.find(p.path, span)
            return bool(hits) if not p.texts else any(t in x for x in map(self.text, self._outermost(hits)) for t in p.texts)
        if isinstance(p, All):
            return [self.text(i, inner) for i, inner in self._nested(self.find(p.path, span)).items()]
        if isinstance(p, Each):
            values: dict[int, dict] = {}
            around = self._nested(self.find(p.path, span))
            outer = {k: i for i, inner in around.items() for k in inner}
            for i in around:
                values[i] = {n: self.pick(q, i) for n, q in p.picks.items()}
            return [v for i, v in values.items() if i not in outer or v != values[outer[i]]]
        if p.within:
            root = self.first(p.within, span)
            if root is None:
                return None
            span = root + 1, self.end[root]
        if isinstance(p, Count):
            if len(p.path) > 1:
                return len(self.find(p.path, span))
            own = self._step(p.path[0])
            return bisect_left(own, span[1]) - bisect_left(own, span[0])
        hit = self.first(p.path, span) if p.path else root
        if hit is None:
            return None
        return self.attrs(hit).get(p.attr) if p.attr else self._own_text(hit, p.path[-1] if p.path else None)


def pick_elements(pages: DataFrame, picks: Mapping[str, Pick], *, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by one column per pick. Narrow: no shuffle, one parse per page."""
    keys = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(keys + [T.StructField(n, p.spark_type) for n, p in picks.items()])
    key_names = [f.name for f in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _OUT_ROWS):
                part = batch.slice(at, _OUT_ROWS)
                parsed = (_Page(x.as_py() or "") for x in part.column(html))
                rows = [{n: page.pick(p) for n, p in picks.items()} for page in parsed]
                columns = [part.column(k) for k in key_names]
                columns += [pa.array([r[n] for r in rows], p.arrow_type) for n, p in picks.items()]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*key_names, html).mapInArrow(run, schema)
