"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements and a list of blocks (runs of inline text). Every block
that reads like a paragraph earns a point, one more for each comma and up to three for its
length; the points go to the element that contains the paragraph, half of them to the next
ancestor, a third, a quarter and so on further up. The points of an element are discounted
by the share of its text that lies in links. The best element is the container of the main
text; if it lies inside an ``article`` or ``main`` element, that one is. Its siblings are
kept as well where they score at least a fifth as much, are headings before it, or are
paragraphs free of links.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by element, role and the words of class and id, and lists that
consist of links count as menus. An element that such a word marks stays if it holds the
page's article.

Defined results: null or empty pages, and pages without text, give an empty text; broken or
cut markup is read as far as it goes; repeated rows are read each by itself; an input column
that has the name of the result column is replaced by it. No text is shortened.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

RESULT = "main_text"

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?…](?:\W|$)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead "
    "title tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote li dd dt td th figcaption caption h1 h2 h3 h4 h5 h6 address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - {"option", "optgroup", "noscript", "template", "title", "head", "body", "html"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
    "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"},
    **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), {"table"}),
}
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template iframe object button select textarea "
    "dialog svg canvas audio video map menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead sidebar sidebars aside rail cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended "
    "pagination pager toolbar widget widgets skip form search".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: "with-sidebar" names a page that has a sidebar, not the sidebar
NOT_MARKS = frozenset("has with no without".split())


class Page:
    """Elements as parallel lists, in page order, and blocks of text."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.out = ["#root"], [-1], [False]
        self.soft = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._stack = [0]
        self._links = 0
        self._run: list[tuple[str, bool]] = []
        self._read(markup)
        self._flush()
        for i in range(1, len(self.tag)):
            self.out[i] = self.out[i] or self.out[self.parent[i]]
        marked = [out or soft for out, soft in zip(self.out, self.soft, strict=True)]
        for i in range(1, len(self.tag)):
            marked[i] = marked[i] or marked[self.parent[i]]
        # marks that would leave nothing of the page are no good
        if any(not marked[i] for i, _, _ in self.blocks):
            self.out = marked

    def _read(self, markup: str) -> None:
        at, size = 0, len(markup)
        while at < size:
            m = _TAG.search(markup, at)
            if m is None:
                self._text(markup[at:])
                return
            if m.start() > at:
                self._text(markup[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self._text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(markup, at)
                at = end.start() if end else size

    def _text(self, text: str) -> None:
        self._run.append((text, self._links > 0))

    def _flush(self) -> None:
        if not self._run:
            return
        run, self._run = self._run, []
        text = " ".join(html.unescape("".join(t for t, _ in run)).split())
        if text:
            linked = sum(len(" ".join(t.split())) for t, inside in run if inside)
            node = next((i for i in reversed(self._stack) if self.tag[i] in BLOCK), 0)
            if any(self.out[i] and self.tag[i] not in BLOCK for i in self._stack):
                node = self._stack[-1]
            self.blocks.append((node, text, linked))

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text(" ")
            return
        if name in BLOCK:
            self._flush()
        if name in ENDS_P:
            self._pop_to({"p"}, BLOCK - PARAGRAPH)
        if name in CLOSES:
            self._pop_to(CLOSES[name], SCOPE[name])
        if name in VOID:
            return
        out, soft = name in LEFT_OUT, False
        if attributes and name not in ("html", "body"):
            words: set[str] = set()
            for a in _ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id"):
                    words.update(_WORDS.findall(value))
                elif key == "role":
                    soft = soft or value in ROLES
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    out = True
                elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    out = True
            if words & MARKS and not words & NOT_MARKS and name != "main":
                if name == "article" or words & COMMENTS:
                    out = out or bool(words & COMMENTS)
                else:
                    soft = True
        inside = any(self.tag[i] == "article" for i in self._stack)
        if name == "header" and not inside:
            soft = True
        if name in ("article", "main") and not out:
            for i in self._stack:
                self.soft[i] = False
        if name not in BLOCK and (out or soft):
            self._flush_inline()
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.out.append(out or (name not in BLOCK and soft))
        self.soft.append(soft)
        self._stack.append(len(self.tag) - 1)
        self._links += name == "a"

    def _flush_inline(self) -> None:
        """Inline elements that are left out take their text from the run."""
        self._run.append(("\0(", False))

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        if name in VOID or not any(self.tag[i] == name for i in self._stack):
            return
        while True:
            if self._end(self._stack.pop()) == name:
                return

    def _end(self, i: int) -> str:
        name = self.tag[i]
        self._links -= name == "a"
        if name not in BLOCK and self.out[i]:
            while self._run and self._run[-1][0] != "\0(":
                self._run.pop()
            if self._run:
                self._run.pop()
        return name

    def _pop_to(self, names: set[str], scope: set[str]) -> None:
        for at in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[at]]
            if tag in names:
                self._flush()
                while len(self._stack) > at:
                    self._end(self._stack.pop())
                return
            if tag in scope:
                return

    def up(self, i: int) -> Iterator[int]:
        while i > 0:
            yield i
            i = self.parent[i]
        yield 0


def _menus(page: Page) -> set[int]:
    """Lists of three or more items that consist of links."""
    size: dict[int, list[int]] = {}
    for node, text, linked in page.blocks:
        for i in page.up(node):
            if page.tag[i] in ("ul", "ol"):
                s = size.setdefault(i, [0, 0, 0])
                s[0], s[1], s[2] = s[0] + len(text), s[1] + linked, s[2] + 1
    return {i for i, (chars, linked, items) in size.items() if items >= 3 and linked > 0.6 * chars}


def main_text(markup: str | None) -> str:
    """The blocks of the main text, joined by newlines."""
    if not markup:
        return ""
    page = Page(markup)
    menus = _menus(page)
    kept: list[tuple[int, str, int, list[int]]] = []
    for node, text, linked in page.blocks:
        path = list(page.up(node))
        if page.out[node] or any(i in menus for i in path):
            continue
        tags = [page.tag[i] for i in path]
        if "header" in tags and tags[0] not in HEADING:
            continue
        kept.append((node, text, linked, path))
    if not kept:
        return ""
    points: dict[int, float] = {}
    chars: dict[int, int] = {}
    in_links: dict[int, int] = {}
    for node, text, linked, path in kept:
        for i in path:
            chars[i] = chars.get(i, 0) + len(text)
            in_links[i] = in_links.get(i, 0) + linked
        if page.tag[node] in HEADING:
            continue
        worth = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        owners = path[1:] if page.tag[node] in PARAGRAPH else path
        for depth, i in enumerate(owners, 1):
            points[i] = points.get(i, 0.0) + worth / depth
    score = {i: p * (1 - min(1.0, in_links[i] / max(1, chars[i]))) for i, p in points.items()}
    if not score:  # headings only
        return "\n".join(text for _, text, _, _ in kept)
    best = max(score, key=lambda i: (score[i], -i))
    top = score[best]
    named = [i for i in page.up(best) if page.tag[i] in ("article", "main")]
    best = named[0] if named else best
    parent = page.parent[best]
    lines = []
    for node, text, linked, path in kept:
        if best in path:
            lines.append(text)
            continue
        if parent < 0 or parent not in path or node == parent:
            continue
        sibling = path[path.index(parent) - 1]
        density = linked / len(text)
        tag = page.tag[sibling]
        if tag in HEADING:
            good = sibling < best
        elif tag in ("p", "pre", "blockquote"):
            good = density < 0.25 if len(text) > 80 else linked == 0 and bool(_SENTENCE_END.search(text))
        else:
            good = score.get(sibling, 0.0) >= max(10.0, 0.2 * top)
        if good:
            lines.append(text)
    return "\n".join(lines)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, and ``main_text``."""
    rest = [f for f in pages.schema.fields if f.name not in (markup, RESULT)]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(markup))
            texts = pa.array([main_text(x.as_py()) for x in raw], pa.string())
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*names, RESULT])

    schema = StructType([*rest, StructField(RESULT, StringType(), False)])
    return pages.drop(RESULT).mapInArrow(run, schema)
