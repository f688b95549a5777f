"""Readable text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without readable content, the length limit and its notice.
SKIPPED = {"script", "style", "ix:header", "ix:nonfraction", "ix:nonnumeric", "head"}
MAX_CHARS = 25_000
CUT_NOTICE = "\n\n[... filing text truncated to fit context window ...]"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.buffer: list[str] = []
        self.hidden: list[str] = []

    def flush(self):
        text = "".join(self.buffer).strip()
        if text:
            self.pieces.append(text)
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag == "body" and "head" in self.hidden:
            self.hidden = []
        if tag in SKIPPED:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag):]

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)


def page_text(html: str) -> str:
    """Visible text, one stripped non-blank line per piece."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = (line.strip() for line in "\n".join(parser.pieces).splitlines())
    return "\n".join(line for line in lines if line)


def html_text(html: Column) -> Column:
    """Whole-page text of every row, a batch at a time."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else page_text(h))

    return extract(html)


def with_notice(text: Column, limit: int = MAX_CHARS, notice: str = CUT_NOTICE) -> Column:
    """Text cut at ``limit`` characters with a notice where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(notice))).otherwise(text)
