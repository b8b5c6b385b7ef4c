"""HTML to title, main text and links.

Nested markup is the one place where built-in expressions do not reach, so pages pass through
an Arrow-batched UDF each. The scanner behind them makes one regex-driven pass over a page and
keeps only the open-element stack and the text pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from newsloom.functions.strings import ascii_lower

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_ENTITY = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*);)")
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = " \t\n\x0b\f\r"

# Which elements hold content, hide it, break lines, or never have children.
CONTENT_TAGS = frozenset(["article", "div", "main", "section"])
BOILERPLATE_TAGS = frozenset(["aside", "footer", "header", "nav"])
DROPPED_TAGS = frozenset(["iframe", "noscript", "script", "style", "svg"])
LINE_TAGS = frozenset(["br", "div", "li", "p", "section"])
VOID_TAGS = frozenset(
    ["area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
)
HEAD_TAGS = frozenset(["base", "head", "html", "link", "meta", "noscript", "script", "style", "title"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BLOCK_TAGS = HEADINGS | frozenset(
    ["address", "blockquote", "center", "div", "dl", "form", "hr", "ol", "p", "pre", "table", "ul"]
)
# What holds what by the content model of HTML, from the outside in; all other elements come last.
NESTING = [["html"], ["body"], ["table"], ["tbody", "tfoot", "thead"], ["tr"], ["td", "th"], ["div"]]
# An end tag never closes an open element that stands further outside than its own.
CLOSE_RANK = {tag: len(NESTING) - depth for depth, tags in enumerate(NESTING) for tag in tags}


def _decode(text: str) -> str:
    def one(m: re.Match) -> str:
        dec, hexa, name = m.groups()
        if name:
            code = 39 if name == "apos" else name2codepoint.get(name)
        else:
            code = int(dec) if dec else int(hexa, 16)
        if not code or code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return m.group(0) if name else ""
        return chr(code)

    return _ENTITY.sub(one, text) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        found.setdefault(name.lower(), _decode(double or single or bare))
    return found


def _events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, payload) with kind `text`, `open` or `close`."""
    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            yield "text", "", _decode(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name:
            closing = m["end"] or m["end2"]
            yield ("close" if closing else "open"), name.lower(), m["attrs"] or m["attrs2"] or ""
    if at < len(html):
        yield "text", "", _decode(html[at:])


def _implied_close(open_tag: str, new_tag: str) -> bool:
    """Whether `new_tag` ends the element on top of the stack."""
    if open_tag == "p":
        return new_tag in BLOCK_TAGS or new_tag == "li"
    if open_tag in HEADINGS:
        return new_tag in HEADINGS or new_tag in ("p", "li")
    return open_tag == new_tag and new_tag in ("a", "li", "option", "td", "tr")


class _Break(str):
    """A line break the page does not contain itself."""


_BREAK = _Break("\n")


class _Node:
    __slots__ = ("tag", "piece", "bytes_before", "in_boilerplate", "children")

    def __init__(self, tag: str, piece: int, bytes_before: int, in_boilerplate: bool):
        self.tag, self.piece, self.bytes_before, self.in_boilerplate = tag, piece, bytes_before, in_boilerplate
        self.children: list[dict] = []


class _Page:
    """One pass over a page: text pieces, content candidates and title sources."""

    def __init__(self, html: str):
        self.pieces: list[str] = []
        self.text_bytes = 0
        self.candidates: list[dict] = []
        self.head_title = ""
        self.first_h1: str | None = None
        self._stack = [_Node("html", 0, 0, False)]
        self._in_head = True
        self._skip: list[str] = []
        for kind, name, payload in _events(html):
            if self._skip:
                self._skipping(kind, name)
            elif kind == "text":
                self._text(payload)
            elif kind == "open":
                self._open(name, payload)
            else:
                self._close(name)
        while self._stack:
            self._pop()

    def _skipping(self, kind: str, name: str) -> None:
        if name == self._skip[-1]:
            if kind == "open":
                self._skip.append(name)
            elif kind == "close":
                self._skip.pop()

    def _text(self, text: str) -> None:
        if self._in_head and self._stack[-1].tag != "title":
            if not text.strip(_SPACE):
                return
            self._in_head = False
        self.pieces.append(text)
        self.text_bytes += len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))

    def _open(self, name: str, attrs: str) -> None:
        if name in DROPPED_TAGS:
            if not attrs.rstrip().endswith("/"):
                self._skip.append(name)
            return
        if name in ("html", "head"):
            return
        if name not in HEAD_TAGS:
            self._in_head = False
            if name == "body":
                return
        while len(self._stack) > 1 and _implied_close(self._stack[-1].tag, name):
            self._pop()
        if name in LINE_TAGS:
            self.pieces.append(_BREAK)
        if name == "meta" and self._in_head:
            self._meta(_attributes(attrs))
        if name not in VOID_TAGS:
            top = self._stack[-1]
            hidden = top.in_boilerplate or top.tag in BOILERPLATE_TAGS
            self._stack.append(_Node(name, len(self.pieces), self.text_bytes, hidden))

    def _meta(self, attrs: dict[str, str]) -> None:
        keys = (attrs.get("property", "").lower(), attrs.get("name", "").lower())
        if "content" in attrs and ("og:title" in keys or "twitter:title" in keys):
            self.head_title = attrs["content"].strip(_SPACE)

    def _close(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "head":
            self._in_head = False
            return
        rank = CLOSE_RANK.get(name, 0)
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[depth].tag
            if tag == name:
                while len(self._stack) > depth:
                    self._pop()
                return
            if CLOSE_RANK.get(tag, 0) > rank:
                return
        if name == "p":
            self.pieces.append(_BREAK)

    def _pop(self) -> None:
        node = self._stack.pop()
        for child in node.children:
            child["tail_bytes"] = self.text_bytes - child["bytes_before"]
        if node.tag == "title" and self._in_head:
            self.head_title = self._own_text(node.piece)
        elif node.tag == "h1" and self.first_h1 is None:
            self.first_h1 = self._own_text(node.piece)
        elif node.tag in CONTENT_TAGS and not node.in_boilerplate and self._stack:
            found = {
                "tag": node.tag,
                "start": node.piece,
                "end": len(self.pieces),
                "bytes_before": node.bytes_before,
                "bytes": self.text_bytes - node.bytes_before,
            }
            self.candidates.append(found)
            self._stack[-1].children.append(found)

    def _own_text(self, start: int) -> str:
        return "".join(p for p in self.pieces[start:] if p is not _BREAK).strip(_SPACE)

    def text(self, start: int = 0, end: int | None = None) -> str:
        return "".join(self.pieces[start:end])

    def title(self) -> str:
        return self.head_title or self.first_h1 or ""

    def main_text(self, mode: str) -> str:
        """`intent`: articles before other containers, by their own text. `sibling_tail`: any
        container, by its text and that of everything after it in the same parent."""
        measure = "bytes" if mode == "intent" else "tail_bytes"
        pool = [c for c in self.candidates if c["tag"] == "article"] if mode == "intent" else self.candidates
        for choices in (pool, self.candidates):
            # Longest wins; among equals the one that starts first, the outer before the inner.
            best = max(choices, key=lambda c: (c[measure], -c["start"], c["end"]), default=None)
            if best and best[measure] > 0:
                return self.text(best["start"], best["end"]).strip(_SPACE)
        return self.text().strip(_SPACE)


PAGE_TYPE = StructType([StructField("title", StringType()), StructField("body", StringType())])


def _parse_pages(pages: pd.Series, mode: str) -> pd.DataFrame:
    rows = []
    for html in pages:
        page = _Page(html or "")
        rows.append((page.title(), page.main_text(mode)))
    return pd.DataFrame(rows, columns=PAGE_TYPE.names)


def parse_html(html: Column, mode: str = "intent") -> Column:
    """Struct of `title` and `body` (the text of the main content node)."""
    if mode not in ("intent", "sibling_tail"):
        raise ValueError("mode must be 'intent' or 'sibling_tail'")

    @F.pandas_udf(PAGE_TYPE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return _parse_pages(pages, mode)

    # Marked so that a filter on the result runs after the one parse and does not repeat it.
    return parse.asNondeterministic()(html)


def extract_title(html: Column) -> Column:
    """Last of `<title>`, `og:title`, `twitter:title` in the head, else the first `<h1>`, else ''."""
    return parse_html(html)["title"]


def main_content(html: Column, mode: str = "intent") -> Column:
    return parse_html(html, mode)["body"]


def node_text(html: Column) -> Column:
    """Trimmed text of a whole fragment, a line break before each p, div, section, br and li."""

    @F.pandas_udf(StringType())
    def text(fragments: pd.Series) -> pd.Series:
        return fragments.map(lambda h: _Page(h or "").text().strip(_SPACE))

    return text(html)


def strip_nontext(html: Column) -> Column:
    """Markup without its script, style, noscript, svg and iframe elements, by regex alone."""
    names = "|".join(sorted(DROPPED_TAGS))
    return F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", "")


def _anchors(html: str) -> list[tuple[str, str]]:
    """(href, text) of every anchor in document order; a nested anchor ends the open one."""
    found: list[tuple[str, list[str]]] = []
    current: list[str] | None = None
    for kind, name, payload in _events(html):
        if kind == "text" and current is not None:
            current.append(payload)
        elif name == "a":
            current = None
            if kind == "open":
                href = _attributes(payload).get("href", "")
                current = []
                found.append((href, current))
    return [(href, "".join(text).strip(_SPACE)) for href, text in found]


_ANCHOR_TYPE = ArrayType(StructType([StructField("href", StringType()), StructField("text", StringType())]))


@F.pandas_udf(_ANCHOR_TYPE)
def _anchor_list(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: [{"href": u, "text": t} for u, t in _anchors(h or "")])


def extract_links(
    pages: DataFrame,
    domain: str = "finance.yahoo.com",
    path_token: str = "/news/",
    max_links: int = 30,
    order: str = "document",
    html: str = "html",
) -> DataFrame:
    """News links of listing pages: the input columns without the markup, plus `title, link, pos`.

    A link counts once per page, by its first anchor in the chosen order; if that anchor has no
    text the link is lost. `order='reverse_dfs'` walks the page from its end. Everything after
    the anchor scan is array work on one page, so no page or site can make a heavy group.
    """
    if order not in ("document", "reverse_dfs"):
        raise ValueError("order must be 'document' or 'reverse_dfs'")
    anchors = _anchor_list(F.col(html))
    if order == "reverse_dfs":
        anchors = F.reverse(anchors)
    kept = [c for c in pages.columns if c != html]

    relative = F.lit("//" + domain)
    absolute = F.transform(
        F.col("_anchors"),
        lambda a: F.struct(
            F.when(F.startswith(a["href"], relative), F.concat(F.lit("https:"), a["href"])).otherwise(a["href"]).alias("link"),
            a["text"].alias("title"),
        ),
    )
    # The domain is matched as given, the link in lower case.
    wanted = F.filter(
        absolute,
        lambda a: F.contains(ascii_lower(a["link"]), F.lit(domain)) & F.contains(ascii_lower(a["link"]), F.lit(path_token)),
    )
    links = F.transform(F.col("_wanted"), lambda a: a["link"])
    first_seen = F.filter(
        F.col("_wanted"),
        lambda a, i: (F.array_position(F.col("_links"), a["link"]) == i + 1) & (a["title"] != ""),
    )
    return (
        pages.select(*kept, anchors.alias("_anchors"))
        .select(*kept, wanted.alias("_wanted"))
        .select(*kept, "_wanted", links.alias("_links"))
        .select(*kept, F.posexplode(F.slice(first_seen, 1, max_links)).alias("pos", "_link"))
        .select(*kept, F.col("_link.title").alias("title"), F.col("_link.link").alias("link"), "pos")
    )
