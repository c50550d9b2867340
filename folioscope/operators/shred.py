"""HTML text to a table of nodes: the one place where pages go through Python.

`shred_html` keeps a page in its row and adds `nodes`, an array in document order whose
index is the node's `seq`. All later work is array expressions on that column, so a page
is never spread over rows and joined back. Nothing is shuffled.

Python cuts the text into tags and keeps the stack of open elements, however deep. A node
below another is one whose seq lies in the other's interval (seq, last]; marks that nodes
inherit (the nearest figure, link and so on) are handed down the stack in the same sweep, and
counters give each node its place in the visible text, so that what a node contains is a
difference of two numbers.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.schema import NODES

# Fixed values from the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer header hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 "
    "h6 pre listing form table hr xmp li dd dt".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# Opening the key closes an open element of the value, unless a barrier is in between.
SIBLINGS = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "option": ("option",),
    "optgroup": ("optgroup", "option"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"),
}
BARRIERS = {
    "li": {"ul", "ol", "menu", "dir"},
    "dd": {"dl"},
    "dt": {"dl"},
    "option": {"select"},
    "optgroup": {"select"},
}
SCOPE = frozenset("table td th caption template object applet marquee".split())
INVISIBLE = frozenset("script style title noscript template head textarea".split())
# Nodes know the nearest element of these kinds that encloses them; a link has an address.
ENCLOSING = ("figure", "picture", "link", "table", "svg", "pre", "code", "cell")
_KIND = {t: ENCLOSING.index(t) for t in ENCLOSING if t not in ("link", "cell")}
_KIND |= {"td": ENCLOSING.index("cell"), "th": ENCLOSING.index("cell")}
_LINK = ENCLOSING.index("link")
_MARKS = {"li": "l", "blockquote": "b"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)
      | <[!?][^>]*(?:>|$)
      | </(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)
      | <(?P<open>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|$)
      | (?P<text>[^<]+|<)""",
    re.S | re.X,
)
_ATTR = re.compile(
    r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""
)
_NO_ATTRS: dict[str, str] = {}
#: All that links and their texts need of a node.
LINK_FIELDS = ("seq", "last", "tag", "attrs", "text")


class _Trees:
    """Node columns of many pages; repairs what HTML allows authors to leave out."""

    def __init__(self):
        self.offsets = [0]
        self.parent, self.last, self.nth, self.tag, self.attrs, self.text = [], [], [], [], [], []
        self.start_at, self.stop_at, self.link_start, self.link_stop = [], [], [], []
        self.links, self.images, self.inside, self.marks = [], [], [], []

    def begin(self):
        self.base = len(self.tag)
        self.open = []  # (seq, tag)
        self.place = {}  # seq of an open element -> its index in `open`
        self.count = Counter()  # open elements by tag
        self.formatting = []  # (tag, attrs, seq); None marks a table cell
        self.handed = [((-1,) * len(ENCLOSING), "")]  # what children of each open element inherit
        self.children = [0]  # elements seen so far below each open element
        self.shown = self.shown_links = 0  # visible characters so far, and those in links
        self.hidden = self.in_links = 0  # open elements without visible text, open links
        self.seen_links = self.seen_images = 0
        self._add("#document", _NO_ATTRS)

    def _add(self, tag, attrs, text=None):
        seq = len(self.tag) - self.base
        inside, marks = self.handed[-1]
        self.parent.append(self.open[-1][0] if self.open else -1)
        self.last.append(seq)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.start_at.append(self.shown)
        self.stop_at.append(self.shown)
        self.link_start.append(self.shown_links)
        self.link_stop.append(self.shown_links)
        self.links.append(self.seen_links)
        self.images.append(self.seen_images)
        self.inside.append(inside)
        self.marks.append(marks)
        if text is None:
            self.children[-1] += 1
            self.seen_images += tag == "img"
        self.nth.append(self.children[-1] if text is None else 0)
        if text is None and tag not in VOID:
            self.place[seq] = len(self.open)
            self.open.append((seq, tag))
            self.count[tag] += 1
            self.children.append(0)
            self.hidden += tag in INVISIBLE
            self.in_links += tag == "a"
            kind = _KIND.get(tag)
            if tag == "a" and "href" in attrs:
                kind, self.seen_links = _LINK, self.seen_links + 1
            if kind is not None:
                inside = (*inside[:kind], seq, *inside[kind + 1 :])
            self.handed.append((inside, marks + _MARKS.get(tag, "")))
        return seq

    def _pop(self):
        seq, tag = self.open.pop()
        del self.place[seq]
        self.count[tag] -= 1
        self.handed.pop()
        self.children.pop()
        self.hidden -= tag in INVISIBLE
        self.in_links -= tag == "a"
        at = self.base + seq
        self.last[at] = len(self.tag) - self.base - 1
        self.stop_at[at], self.link_stop[at] = self.shown, self.shown_links
        if tag in ("td", "th", "caption"):
            while self.formatting and self.formatting.pop() is not None:
                pass

    def _pop_to(self, index):
        while len(self.open) > index:
            self._pop()

    def _find(self, tags, barriers):
        if not any(map(self.count.__getitem__, tags)):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i][1]
            if tag in tags:
                return i
            if tag in barriers:
                return None
        return None

    def _reopen_formatting(self):
        """Bold and the like go on after a paragraph that was closed for the author."""
        if not self.formatting or self.formatting[-1] is None:
            return
        i = len(self.formatting)
        while i and self.formatting[i - 1] and self.formatting[i - 1][2] not in self.place:
            i -= 1
        for i in range(i, len(self.formatting)):
            tag, attrs, _ = self.formatting[i]
            self.formatting[i] = (tag, attrs, self._add(tag, attrs))

    def start(self, tag, attrs):
        if tag in ("html", "body") and self.count[tag]:
            return
        if tag == "body":
            head = self._find({"head"}, frozenset())
            if head is not None:
                self._pop_to(head)
        if tag in CLOSES_P:
            p = self._find({"p"}, SCOPE | {"button"})
            if p is not None:
                self._pop_to(p)
        if tag in SIBLINGS:
            while True:
                i = self._find(SIBLINGS[tag], BARRIERS.get(tag, {"table"}))
                if i is None:
                    break
                self._pop_to(i)
        elif tag[0] == "h" and tag[1:] in "123456" and self.open[-1][1][0] == "h":
            if self.open[-1][1][1:] in ("1", "2", "3", "4", "5", "6"):
                self._pop()
        if tag == "tr" and self.open[-1][1] == "table":
            self._add("tbody", _NO_ATTRS)
        if tag in ("td", "th") and self.open[-1][1] in ("tbody", "thead", "tfoot"):
            self._add("tr", _NO_ATTRS)
        block = tag in CLOSES_P or tag in SIBLINGS or tag in ("html", "head", "body", "meta", "link")
        if not block:
            if tag == "a":
                self._end_formatting("a")
            self._reopen_formatting()
        seq = self._add(tag, attrs)
        if tag in FORMATTING:
            alike = [i for i, f in enumerate(self.formatting) if f and f[:2] == (tag, attrs)]
            if len(alike) >= 3:
                del self.formatting[alike[0]]
            self.formatting.append((tag, attrs, seq))
        elif tag in ("td", "th", "caption"):
            self.formatting.append(None)

    def _end_formatting(self, tag):
        for i in range(len(self.formatting) - 1, -1, -1):
            entry = self.formatting[i]
            if entry is None:
                return
            if entry[0] == tag:
                del self.formatting[i]
                at = self.place.get(entry[2])
                if at is not None and not any(t in CLOSES_P for _, t in self.open[at:]):
                    self._pop_to(at)
                return

    def end(self, tag):
        if tag in FORMATTING:
            self._end_formatting(tag)
            return
        if tag == "br":
            self.start("br", _NO_ATTRS)
            return
        headings = {"h1", "h2", "h3", "h4", "h5", "h6"}
        names = headings if tag in headings else {tag}
        barriers = frozenset() if tag in ("table", "html", "body") else SCOPE - {tag}
        if tag in ("tr", "thead", "tbody", "tfoot"):
            barriers = {"table"}
        at = self._find(names, barriers)
        if at is not None:
            self._pop_to(at)
        elif tag == "p":
            self.start("p", _NO_ATTRS)
            self._pop()

    def data(self, text):
        visible = len("".join(text.split()))
        if visible:
            self._reopen_formatting()
        if self.text[-1] is not None and self.parent[-1] == self.open[-1][0]:
            self.text[-1] += text
        else:
            self._add("#text", _NO_ATTRS, text)
        if not self.hidden:
            self.shown += visible
            self.shown_links += visible if self.in_links else 0
        self.stop_at[-1], self.link_stop[-1] = self.shown, self.shown_links

    def finish(self):
        self._pop_to(0)
        self.offsets.append(len(self.tag))

    def to_arrow(self, fields: tuple[str, ...] | None = None) -> pa.Array:
        """array<struct> column, one entry per page, of all or of the given fields."""
        starts = np.array(self.offsets)
        pairs = [(k, v) for a in self.attrs for k, v in a.items()]
        attrs = pa.MapArray.from_arrays(
            pa.array([0, *accumulate(len(a) for a in self.attrs)], pa.int32()),
            pa.array([k for k, _ in pairs], pa.string()),
            pa.array([v for _, v in pairs], pa.string()),
        )
        seq = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))

        def inside() -> pa.Array:
            kinds = np.array(self.inside, dtype=np.int32).reshape(-1, len(ENCLOSING))
            return pa.StructArray.from_arrays(
                [pa.array(kinds[:, k].copy()) for k in range(len(ENCLOSING))], names=ENCLOSING
            )

        columns = {
            "seq": lambda: pa.array(seq, pa.int32()),
            "parent": lambda: pa.array(self.parent, pa.int32()),
            "last": lambda: pa.array(self.last, pa.int32()),
            "nth": lambda: pa.array(self.nth, pa.int32()),
            "tag": lambda: pa.array(self.tag, pa.string()),
            "attrs": lambda: attrs,
            "text": lambda: pa.array(self.text, pa.string()),
            "start": lambda: pa.array(self.start_at, pa.int32()),
            "stop": lambda: pa.array(self.stop_at, pa.int32()),
            "link_start": lambda: pa.array(self.link_start, pa.int32()),
            "link_stop": lambda: pa.array(self.link_stop, pa.int32()),
            "links": lambda: pa.array(self.links, pa.int32()),
            "images": lambda: pa.array(self.images, pa.int32()),
            "inside": inside,
            "marks": lambda: pa.array(self.marks, pa.string()),
        }
        names = [n for n in columns if fields is None or n in fields]
        nodes = pa.StructArray.from_arrays([columns[n]() for n in names], names=names)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), nodes)


def _attributes(raw):
    found = {}
    for name, double, single, bare in _ATTR.findall(raw):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def _read_page(trees: _Trees, source: str) -> None:
    trees.begin()
    at, end = 0, len(source)
    while at < end:
        token = _TOKEN.match(source, at)
        at = token.end()
        if token["text"] is not None:
            trees.data(html.unescape(token["text"]))
        elif token["open"] is not None:
            tag = token["open"].lower()
            if not token[0].endswith(">"):
                break  # the page ends inside a tag
            raw = token["attrs"]
            trees.start(tag, _attributes(raw) if raw else _NO_ATTRS)
            if tag in RAW_TEXT:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                stop = close.start() if close else end
                if stop > at:
                    raw = source[at:stop]
                    trees.data(html.unescape(raw) if tag in ("title", "textarea") else raw)
                at = stop
        elif token["close"] is not None:
            trees.end(token["close"].lower())
    trees.finish()


def pages_to_nodes(
    pages: list[str | None], fields: tuple[str, ...] | None = None
) -> pa.Array:
    """The `nodes` column for a list of pages; a missing page has no nodes."""
    trees = _Trees()
    for page in pages:
        if page is None:
            trees.offsets.append(len(trees.tag))
        else:
            _read_page(trees, page)
    return trees.to_arrow(fields)


def shred_html(
    captures: DataFrame, html_column: str = "html", fields: tuple[str, ...] | None = None
) -> DataFrame:
    """Replace the HTML column by `nodes` (see schema.NODE); other columns are kept.

    `fields` names those of a node that are wanted; the others are not made or sent to the JVM.
    """
    kept = [f for f in captures.schema if f.name != html_column]
    node = [f for f in NODES.elementType if fields is None or f.name in fields]
    schema = T.StructType([*kept, T.StructField("nodes", T.ArrayType(T.StructType(node)))])
    names = [f.name for f in kept]

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small slices out: a page grows several-fold when it becomes nodes.
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                nodes = pages_to_nodes(part.column(html_column).to_pylist(), fields)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [nodes], names=[*names, "nodes"]
                )

    return captures.mapInArrow(shred, schema)


def node_table(shredded: DataFrame) -> DataFrame:
    """One row per node, for ad-hoc queries over the tree."""
    return shredded.select("page_id", F.inline("nodes"))
