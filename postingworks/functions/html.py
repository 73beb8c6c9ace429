"""Plain text of HTML fragments: entities are unescaped once, then the result is parsed and its text taken."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# Elements that start a new line of text, and those whose content is no text.
BLOCKS = set("address article aside blockquote body br center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = {"script", "style", "template", "noscript"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in SILENT))
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def plain_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    parser = _Text()
    parser.feed(entities.unescape(html))
    parser.close()
    return re.sub(r"[ \t\n\f\r]+", " ", "".join(parser.parts)).strip()


def _plain(html: pd.Series) -> pd.Series:
    return html.map(plain_text)


def _each_plain(htmls: pd.Series) -> pd.Series:
    return htmls.map(lambda parts: None if parts is None else [plain_text(x) for x in parts])


def to_text(html: Column) -> Column:
    """Arrow-batched; null gives ''. This and `to_texts` are the only functions here that need Python."""
    return F.pandas_udf(_plain, "string")(html)


def to_texts(htmls: Column) -> Column:
    """`to_text` of each element of an array, so that a row's texts need not be parted and gathered again; null gives null."""
    return F.pandas_udf(_each_plain, "array<string>")(htmls)
