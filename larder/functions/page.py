"""Main text of an HTML page by fallback tiers, with the standard library's tolerant parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is noise, elements without an end tag, elements that may hold a captured page source.
NOISE = {"script", "style", "noscript", "iframe", "header", "footer", "nav", "form", "button", "svg", "meta", "link", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CAPTURES = {"pre", "xmp", "textarea"}
#: Containers by preference, and the characters from which their text is enough.
CONTAINERS = ("article", "main", "body")
ENOUGH = 100
#: What running text is not sought in, elements inside a line of text, and headings.
APART = NOISE - VOID | {"table", "aside", "pre", "xmp", "textarea", "title", "select", "template", "figure"}
INLINE = {"a", "abbr", "b", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "wbr", "br"}
HEADINGS = {"h1", "h2", "h3", "h4"}
#: Characters from which a block is running text, and the most of it that may stand in links.
BLOCK, LINKED = 60, 0.3


class _Texts(HTMLParser):
    """Collects stripped text nodes by the open elements around them; unclosed and stray tags do no harm."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.all: list[str] = []
        self.first: dict[str, list[str] | None] = {}
        self.inside: dict[str, int] = {}
        self.captures: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        self.open.append(tag)
        if tag in CONTAINERS and tag not in self.first:
            self.first[tag] = []
            self.inside[tag] = len(self.open)
        if tag in CAPTURES:
            self.captures.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            closed = self.open.pop()
            if self.inside.get(closed, 0) > len(self.open):
                self.inside[closed] = 0
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.captures and any(t in CAPTURES for t in self.open):
            self.captures[-1].append(data)
        text = " ".join(data.split()) if data.isspace() else data.strip()
        if not text or any(t in NOISE for t in self.open):
            return
        self.all.append(text)
        for tag, depth in self.inside.items():
            if depth:
                self.first[tag].append(text)


def _parsed(source: str) -> _Texts:
    parser = _Texts()
    parser.feed(source)
    parser.close()
    return parser


class _Blocks(HTMLParser):
    """The text of a page as blocks, each with the share of it that stands in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped: list[str] = []
        self.links = 0
        self.blocks: list[list] = [["", 0, False]]

    def _new(self, heading: bool) -> None:
        if self.blocks[-1][0].strip():
            self.blocks.append(["", 0, heading])
        else:
            self.blocks[-1][:] = ["", 0, heading]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            return
        if tag in APART:
            self.skipped.append(tag)
        elif tag == "a":
            self.links += 1
        elif tag not in INLINE:
            self._new(tag in HEADINGS)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE:
            self.links = 0
            self._new(False)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.blocks[-1][0] += data
            self.blocks[-1][1] += len("".join(data.split())) if self.links else 0


def dense_text(source: str | None) -> str:
    """The running text of a page, one block a line: blocks long enough with few links, shorter ones between them, and the
    headings right above them. Comments, tables and noise are left out. Null and empty pages give an empty text."""
    reader = _Blocks()
    reader.feed(source or "")
    reader.close()
    blocks = [(" ".join(text.split()), linked, heading) for text, linked, heading in reader.blocks if text.strip()]
    running = [len(text) >= BLOCK and linked <= LINKED * len(text) for text, linked, _ in blocks]
    kept = list(running)
    for i, (text, linked, heading) in enumerate(blocks):
        if heading and any(running[i + 1 : i + 2]) or not linked and any(running[max(0, i - 1) : i]) and any(running[i + 1 : i + 2]):
            kept[i] = True
    return "\n".join(text for (text, *_), k in zip(blocks, kept) if k)


def densest_text(source: str | None) -> str:
    """The running text of a page if it is enough, else its text by the other tiers."""
    dense = dense_text(source)
    return dense if len(dense) >= ENOUGH else main_text(source)


def main_text(source: str | None) -> str:
    """Text of a page: a captured page source first, then the first sufficient container, the last existing one if none
    suffices, then the whole page; text nodes are joined by blanks. Null and empty pages give an empty text."""
    if not source:
        return ""
    page = _parsed(source)
    for pieces in page.captures:
        capture = "".join(pieces)
        if "<!doctype" in capture.lower() and "<html" in capture.lower():
            nested = " ".join(_parsed(capture).all)
            if len(nested) >= ENOUGH:
                return nested
    content = ""
    for tag in CONTAINERS:
        if page.first.get(tag) is not None:
            content = " ".join(page.first[tag])
            if len(content) >= ENOUGH:
                break
    return content or " ".join(page.all)


page_text_by_density = F.pandas_udf(lambda pages: pages.map(densest_text), T.StringType())
page_text = F.pandas_udf(lambda pages: pages.map(main_text), T.StringType())


@F.pandas_udf(T.StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Bytes as UTF-8 text; invalid bytes are dropped."""
    return contents.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))
