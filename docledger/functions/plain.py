"""The plain text of blocks, by type, as Spark columns; only HTML tables need a UDF."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.html import flatten

#: An anchor at the end of a heading line or on a line of its own.
ANCHOR = r"<!--\s*id:[^>]*-->"


def without_links(text: Column) -> Column:
    """Each wikilink reduced to its display text, or to its target if it has none."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]\[|]*\|([^\]\[]*)\]\]", "$1"), r"\[\[([^\]\[|]*)\]\]", "$1")


def without_emphasis(text: Column) -> Column:
    """Bold, italic and code markers removed, unless they are escaped."""
    inner = lambda c: rf"(?=[^{c}\n])([^{c}\n\\]*+(?:\\.[^{c}\n\\]*+)*+)"
    for pattern in (rf"(?<!\\)\*\*{inner('*')}\*\*", rf"(?<!\\)__{inner('_')}__", rf"(?<!\\)\*{inner('*')}\*", rf"(?<![A-Za-z0-9\\])_{inner('_')}_(?![A-Za-z0-9])", r"(?<!\\)`([^`\n]+)`"):
        text = F.regexp_replace(text, pattern, "$1")
    return text


def unescaped(text: Column) -> Column:
    """Backslashes before punctuation removed: the characters that they stand for are text."""
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def pipe_rows(text: Column) -> Column:
    """The rows of a pipe table as arrays of trimmed cells, without the separator row."""
    lines = F.filter(F.split(text, "\n"), lambda line: (F.trim(line) != "") & ~line.rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"))
    inner = lambda line: F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(lines, lambda line: F.transform(F.split(inner(line), r"(?<!\\)\|"), lambda cell: F.trim(cell)))


def html_rows(text: Column) -> Column:
    """One line for each row of an HTML table, cells joined by bars."""
    cells = F.regexp_replace(F.regexp_replace(text, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | "), r"(?i)<br\s*/?>", " ")
    return flatten(cells)


def to_plain_text(kind: Column, content: Column, form: Column) -> Column:
    """The plain text of a block of type `kind`; form is the anchor's format attribute."""
    caption = F.regexp_extract(content, r"(?m)^\*([^*\n]+)\*\s*$", 1)
    alt = F.regexp_extract(content, r"!\[([^\]]*)\]", 1)
    heading = unescaped(F.trim(F.regexp_replace(F.regexp_replace(content, ANCHOR, ""), r"^#{1,6} ", "")))
    table = F.array_join(F.transform(pipe_rows(content), lambda cells: F.array_join(F.transform(cells, unescaped), " | ")), "\n")
    return (
        F.when(kind == "heading", heading)
        .when((kind == "table") & (form == "html"), html_rows(content))
        .when(kind == "table", table)
        .when(kind == "figure", F.concat(F.lit("[FIGURE] "), unescaped(F.when(caption != "", caption).otherwise(alt))))
        .when((kind == "formula") & (form == "image"), F.concat(F.lit("[FORMULA] "), unescaped(alt)))
        .when(kind == "formula", F.trim(F.regexp_replace(content, r"^\s*\$\$?|\$\$?\s*$", "")))
        .when(kind == "code", F.regexp_replace(content, r"\A```[^\n]*\n|\n```\s*\z", ""))
        .when(kind == "raw", content)
        .otherwise(unescaped(without_emphasis(without_links(content))))
    )
