"""HTML to text, as Arrow-batched functions on the standard library's parser."""

from __future__ import annotations

from html import unescape as _unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAKS = frozenset(("br", "p", "li", "pre"))
_SILENT = frozenset(("script", "style", "template"))
_DROPPED = frozenset("script style noscript nav header footer svg form iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Flat(HTMLParser):
    """All text, with a line feed before each line-breaking element; content of script, style and template is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKS:
            self.parts.append("\n")
        self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


class _Page(HTMLParser):
    """The title, and the texts inside ``main``, or else inside ``body``, outside of dropped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: list[str] = []
        self.all: list[str] = []
        self.main: list[str] = []
        self.has_main = False

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)
        self.has_main |= tag == "main"

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.open:
            if "svg" not in self.open:
                self.title.append(data)
            return
        if _DROPPED.intersection(self.open) or "head" in self.open:
            return
        self.all.append(data)
        if "main" in self.open:
            self.main.append(data)


def flat_text(html: str | None) -> str:
    if not html:
        return ""
    p = _Flat()
    p.feed(html)
    p.close()
    return _unescape("".join(p.parts)).strip()


def page_text(html: str | None) -> tuple[str | None, str]:
    p = _Page()
    p.feed(html or "")
    p.close()
    lines = [x for part in (p.main if p.has_main else p.all) for x in map(str.strip, part.splitlines()) if x]
    return "".join(p.title).strip() or None, "\n".join(lines)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Text of a fragment; references are decoded twice, as sources escape them once more. Null is empty."""
    return html.map(flat_text)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def extract_text(html: pd.Series) -> pd.DataFrame:
    """(title, text) of a page without its navigation, forms and scripts; non-blank lines, trimmed."""
    return pd.DataFrame([page_text(h) for h in html], columns=["title", "text"])


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _unescape(t))
