"""HTML tables and fragments inside documents."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

_VOID = frozenset("br hr img input meta link col area base wbr source embed track param".split())
_OPTIONAL = frozenset("li p tr td th dt dd thead tbody tfoot option colgroup html head body".split())


class _Flat(HTMLParser):
    """Text with a line for each row or block, cells apart by one space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.skipped = [[]], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skipped += 1
        elif tag in ("tr", "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.lines.append([])
        elif tag in ("br", "td", "th"):
            self.lines[-1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)

    def handle_data(self, data):
        if not self.skipped:
            self.lines[-1].append(data)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.good = [], True

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        while self.open and self.open[-1] != tag and self.open[-1] in _OPTIONAL:
            self.open.pop()
        if self.open and self.open[-1] == tag:
            self.open.pop()
        elif tag not in _VOID:
            self.good = False


def flattened(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Flat()
    parser.feed(html)
    parser.close()
    lines = (" ".join("".join(x).split()) for x in parser.lines)
    return "\n".join(x for x in lines if x)


def is_well_formed(html: str | None) -> bool | None:
    if html is None:
        return None
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.good and all(t in _OPTIONAL for t in parser.open)


@F.pandas_udf(StringType())
def flatten(s: pd.Series) -> pd.Series:
    return s.map(flattened)


@F.pandas_udf(BooleanType())
def well_formed(s: pd.Series) -> pd.Series:
    return s.map(is_well_formed)
