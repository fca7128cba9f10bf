"""Plain text of HTML pages, with blocks on lines of their own."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import LINE_ENDS

# Elements that are left out, that are blocks, and that are paragraphs.
LEFT_OUT = frozenset("script style noscript template head svg iframe object embed canvas button select textarea".split())
BLOCKS = frozenset("address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 section article blockquote table ul ol".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}


class _Text(HTMLParser):
    """Collects text; an unclosed paragraph ends where the next block starts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def _break(self, tag: str) -> None:
        if not self.hidden:
            self.out.append("\n\n" if tag in PARAGRAPHS else "\n" if tag in BLOCKS or tag == "br" else "")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and "p" in self.open:
            self.handle_endtag("p")
        if tag == "body":
            self.hidden, self.open = 0, []
        self._break(tag)
        if tag in VOID:
            if tag == "hr":
                self._break(tag)
            return
        self.open.append(tag)
        self.hidden += tag in LEFT_OUT

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.hidden -= last in LEFT_OUT
                self._break(last)
                if last == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def page_text(html: str) -> str:
    reader = _Text()
    reader.feed(html)
    reader.close()
    while reader.open:
        reader.handle_endtag(reader.open[-1])
    text = "".join(reader.out)
    text = re.sub(r"\n[ \t]+", "\n", re.sub(r"(?<![ \t])[ \t]+\n", "\n", text))
    for old, new in LINE_ENDS:
        text = text.replace(old, new)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def texts_of_pages(pages: pa.Array) -> pa.Array:
    return pa.array([None if x is None else page_text(x) for x in pages.to_pylist()], pa.string())


def html_text(html: Column) -> Column:
    return F.arrow_udf(texts_of_pages, "string")(html)
