"""From Word packages to a vault: one plan from the items of packages to blocks with IDs, stored elements, issues and counts.

Every construct of a package becomes a block or is skipped by name. What has no form of its own becomes a raw, locked block that
carries its text; its element is stored under the block's ID, and an issue says why. accounts() checks that nothing is missing.
Positions, IDs, sections and lists follow a document's order by carried(), so a long document is split over tasks.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import block_id
from docledger.operators import structure as S
from docledger.operators.reingest import FRONT
from docledger.sources import docx, scratch

#: Positions of a part's paragraphs, and of a paragraph's items.
_PARTS, _ITEMS = 1 << 40, 1 << 10
#: Positions of a document that one task takes at once: 16,384 paragraphs.
STRETCH = _ITEMS << 14


@dataclass
class Vault:
    """blocks: doc, at, id, section_id, type, level, content, attrs; assets: asset, bytes; issues: doc, severity, code, paragraph, detail;
    skipped: doc, code, paragraphs, chars; items: what was read, with what became of it."""

    blocks: DataFrame
    assets: DataFrame
    issues: DataFrame
    skipped: DataFrame
    items: DataFrame


def _escaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))


def _rows_of(cells: Column) -> Column:
    """A table's cells as arrays of a row each."""
    rows = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["row"])))
    return F.transform(rows, lambda r: F.filter(cells, lambda c: c["row"] == r))


def pipe_table(cells: Column) -> Column:
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: _escaped(c["text"])), " | "), F.lit(" |"))
    rows = F.transform(_rows_of(cells), line)
    marks = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(_rows_of(cells)[0])))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(marks), F.slice(rows, F.lit(2), F.size(rows))), "\n")


def html_table(cells: Column) -> Column:
    """Merged cells span: a cell that goes on with the one above it is left out, and that one has a rowspan."""
    safe = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    goes_on = lambda c: F.coalesce(c["v_merge"] == "continue", F.lit(False))

    def cell(c: Column) -> Column:
        stop = F.array_min(F.transform(F.filter(cells, lambda o: (o["col"] == c["col"]) & (o["row"] > c["row"]) & ~goes_on(o)), lambda o: o["row"]))
        below = F.size(F.filter(cells, lambda o: (o["col"] == c["col"]) & (o["row"] > c["row"]) & goes_on(o) & (stop.isNull() | (o["row"] < stop))))
        rows = F.when((c["v_merge"] == "restart") & (below > 0), F.concat(F.lit(' rowspan="'), (below + 1).cast("string"), F.lit('"'))).otherwise("")
        columns = F.when(c["grid_span"] > 1, F.concat(F.lit(' colspan="'), c["grid_span"].cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<td"), columns, rows, F.lit(">"), safe(c["text"]), F.lit("</td>"))

    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(r, lambda c: ~goes_on(c)), cell), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(_rows_of(cells), row), ""), F.lit("</table>"))


def linked_text(text: Column, links: Column) -> Column:
    """text with its links (start, length, link; by start) in place of what they cover."""
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(links, i - 1)["start"] + F.get(links, i - 1)["length"])
    upto = lambda i: F.when(i < F.size(links), F.get(links, i)["start"]).otherwise(F.length(text))
    piece = lambda i: F.concat(F.substring(text, end(i) + 1, upto(i) - end(i)), F.coalesce(F.get(links, i)["link"], F.lit("")))
    return F.when(F.size(links) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(links)), piece), "")).otherwise(text)


def _numbered(items: DataFrame, levels: DataFrame, styles: DataFrame) -> DataFrame:
    """items with number: direct or by style; what can't be computed is null."""
    with_lists = S.effective_numbering(items, styles, "doc")
    known = with_lists.where("num_id is not null")
    rest = with_lists.where("num_id is null").withColumn("number", F.lit(None).cast("string"))
    found = S.numbered(known, levels, "doc", ["at"])
    return found.withColumn("number", F.when(F.col("number") != "", F.col("number"))).unionByName(rest)


def ingest(packages: DataFrame, doc_of: Column, titles: DataFrame | None = None, split_level: int = 2, first: int = 1) -> Vault:
    """The vault of packages (path, content), with IDs from `first` on in each document. doc_of: the document's key, from file.

    titles: (doc, title) names the section before a document's first heading.
    """
    read = scratch.written(docx.read_package(packages).withColumn("doc", doc_of))
    part = lambda name: read.where(F.col(name).isNotNull()).select("doc", f"{name}.*")
    at = F.when(F.col("part") == "footnotes", _PARTS).when(F.col("part") == "endnotes", 2 * _PARTS).otherwise(0) + F.col("para_idx").cast("long") * _ITEMS + F.col("item_seq")
    every = part("item").withColumn("at", at)
    skipped = every.where("skip is not null").groupBy("doc", F.col("skip").alias("code")).agg(F.count("*").alias("paragraphs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    kept = every.where("skip is null and not coalesce(revision = 'del', false) and kind <> 'broken'")
    items = scratch.written(_numbered(kept, part("level"), part("style")).withColumnRenamed("outline_level", "level"))

    # The section before the first heading, then what begins a section, a block, a list.
    begins = items.groupBy("doc").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("at")).where("kind <> 'heading'").select("doc", "at")
    named = begins.withColumn("title", F.lit(None).cast("string")) if titles is None else begins.join(titles.select("doc", "title"), "doc", "left")
    front = named.select("doc", (F.col("at") - 1).alias("at"), F.lit("heading").alias("kind"), F.lit(0).alias("level"), F.when(F.trim("title") != "", F.col("title")).otherwise(F.lit(FRONT)).alias("text"))
    rows = items.unionByName(front, allowMissingColumns=True)
    rows = S.carried(rows, "doc", "at", {"nth": F.lit(1)}, {}, STRETCH)
    previous = rows.select("doc", (F.col("nth") + 1).alias("nth"), (F.col("kind") == "list").alias("_after_list"))
    rows = rows.join(previous, ["doc", "nth"], "left")
    goes_on = (F.col("kind") == "list") & F.coalesce("_after_list", F.lit(False))
    starts = (F.col("kind") == "heading") & (F.col("level") <= split_level)
    rows = S.carried(rows.withColumn("_new", (~goes_on).cast("int")).drop("_after_list"), "doc", "at", {"block": F.col("_new")}, {"section_block": F.when(starts, F.col("at"))}, STRETCH)
    rows = rows.withColumn("id", block_id(F.col("doc"), F.col("block") + (first - 1)))
    rows = scratch.written(rows)

    # Links: bookmarks stand for the block of their paragraph.
    links = part("link")
    heads = rows.where(starts).select("doc", F.col("at").alias("section_block"), F.col("id").alias("section_id"))
    body = rows.where(F.col("at") >= 0).where(F.col("at") < _PARTS)
    homes = body.where("para_idx is not null").groupBy("doc", "para_idx").agg(F.min_by(F.struct("id", "kind", "level", "section_block"), "at").alias("b"))
    marks = links.where("kind = 'bookmark'").groupBy("doc", "target").agg(F.min("para_idx").alias("para_idx"))
    marks = marks.join(homes, ["doc", "para_idx"]).select("doc", "target", "b.*").join(heads, ["doc", "section_block"])
    whole = (F.col("kind") == "heading") & (F.col("level") <= split_level)
    marks = marks.select("doc", "target", F.concat("section_id", F.when(whole, "").otherwise(F.concat(F.lit("#^"), F.lower("id")))).alias("place"), F.when(~whole, F.col("id")).alias("marked"))
    asked = scratch.written(links.where("kind in ('internal', 'external')").join(marks, ["doc", "target"], "left"))
    link = F.when(F.col("kind") == "external", F.concat(F.lit("["), "display", F.lit("]("), "target", F.lit(")"))).otherwise(F.concat(F.lit("[["), "place", F.lit("|"), "display", F.lit("]]")))
    spans = asked.where("at is not null and display <> '' and (kind = 'external' or place is not null)").groupBy("doc", "para_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), F.length("display").alias("length"), link.alias("link")))).alias("links"))
    rows = rows.join(spans, ["doc", "para_idx"], "left").join(heads, ["doc", "section_block"], "left")
    has_links = F.col("kind").isin("paragraph", "heading", "list") & F.col("links").isNotNull() & (F.col("at") < _PARTS)
    text = F.when(has_links, linked_text(F.col("text"), F.coalesce("links", F.array().cast("array<struct<start:int,length:int,link:string>>")))).otherwise(F.col("text"))

    # Forms: what can't be read is raw, as is a figure without an image.
    images = part("image").select("doc", "embed", "name", "bytes")
    rows = rows.join(images, ["doc", "embed"], "left")
    readable = F.when(F.col("kind") == "table", F.col("cells").isNotNull()).when(F.col("kind") == "figure", F.col("name").isNotNull()).otherwise(F.lit(True))
    rows = rows.withColumn("form", S.representation(F.col("kind"), F.col("cells"), readable))
    kind = F.split_part("form", F.lit(" "), F.lit(1))
    line = (
        F.when(kind == "heading", F.concat_ws(" ", F.repeat(F.lit("#"), F.greatest("level", F.lit(1))), "number", text))
        .when(kind == "list", F.concat(F.repeat(F.lit("  "), F.coalesce("ilvl", F.lit(0))), F.coalesce(F.nullif("number", F.lit("")), F.lit("-")), F.lit(" "), text))
        .when(F.col("form") == "table pipe", pipe_table(F.col("cells")))
        .when(F.col("form") == "table html", html_table(F.col("cells")))
        .when(kind == "figure", F.concat(F.lit("![Figure](../assets/"), "id", F.lit("."), F.substring_index("name", ".", -1), F.lit(")")))
        .when(kind == "formula", F.concat(F.lit("$$"), text, F.lit("$$")))
        .otherwise(F.coalesce(text, F.lit("")))
    )
    reason = F.when(F.col("form") != "raw", None).when(F.col("kind") == "table", "table_parse_failed").otherwise("shape_unrenderable")
    asset = F.when(reason.isNotNull(), F.concat("id", F.lit(".xml"))).when(kind == "figure", F.concat("id", F.lit("."), F.substring_index("name", ".", -1)))
    rows = scratch.written(rows.withColumns({"type": kind, "line": line, "reason": reason, "asset": asset}).drop("links", "cells"))
    blocks = rows.groupBy("doc", "id").agg(
        F.min("at").alias("at"),
        F.min("section_id").alias("section_id"),
        F.min("type").alias("type"),
        F.min(F.split_part("form", F.lit(" "), F.lit(2))).alias("format"),
        F.min("level").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("content"),
        F.min("reason").alias("reason"),
        F.min("asset").alias("asset"),
    )
    blocks = blocks.join(asked.where("marked is not null").select("doc", F.col("marked").alias("id"), F.lower("marked").alias("marker")).distinct(), ["doc", "id"], "left")
    stored = rows.where("asset is not null").select("asset", F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(F.encode(F.coalesce("xml", F.lit("")), "UTF-8")).alias("bytes"))
    issue = lambda t, code, paragraph, detail: t.select("doc", code.alias("code"), paragraph.alias("paragraph"), detail.alias("detail"))
    found = issue(rows.where("reason is not null"), F.col("reason"), F.col("para_idx"), F.concat(F.lit("degraded to "), "id"))
    found = found.unionByName(issue(asked.where("kind = 'internal' and place is null"), F.lit("unresolved_ref"), F.col("para_idx"), F.concat(F.coalesce("target", F.lit("(none)")), F.lit(" not found"))))
    found = found.unionByName(issue(rows.where("kind = 'heading' and level > 0 and number is null and num_id is not null"), F.lit("numbering_unresolved"), F.col("para_idx"), F.col("text")))
    found = found.unionByName(issue(S.textual_references(rows.where("kind in ('paragraph', 'list', 'footnote')").select("doc", "para_idx", "line").withColumnRenamed("line", "text")), F.lit("textual_ref_candidate"), F.col("para_idx"), F.col("reference")))
    return Vault(blocks, stored, S.issues(found), skipped, rows.select("doc", "at", "kind", "id", "reason"))


def accounts(vault: Vault) -> DataFrame:
    """(doc, constructs, captured, with_fallback, without_block, unstored, unreported, balanced) of each document.

    constructs are the items that weren't skipped, a document's synthetic heading included. Each must have a block; each that was degraded also its
    stored element and its issue. balanced says that the three outputs of the one pass add up.
    """
    n = lambda what: F.count_if(what)
    have = vault.blocks.select("doc", "id", F.lit(True).alias("_block"))
    kept = vault.assets.where("asset like '%.xml'").select(F.regexp_replace("asset", r"\.xml$", "").alias("id"), F.lit(True).alias("_stored"))
    told = vault.issues.where("detail like 'degraded to %'").select("doc", F.substring_index("detail", " ", -1).alias("id"), F.lit(True).alias("_told"))
    rows = vault.items.join(have, ["doc", "id"], "left").join(kept, "id", "left").join(told, ["doc", "id"], "left")
    degraded = F.col("reason").isNotNull()
    out = rows.groupBy("doc").agg(F.count("*").alias("constructs"), n(F.col("_block").isNotNull() & ~degraded).alias("captured"), n(F.col("_block").isNotNull() & degraded).alias("with_fallback"), n(F.col("_block").isNull()).alias("without_block"), n(degraded & F.col("_stored").isNull()).alias("unstored"), n(degraded & F.col("_told").isNull()).alias("unreported"))
    return out.withColumn("balanced", (F.col("constructs") == F.col("captured") + F.col("with_fallback")) & (F.col("unstored") == 0) & (F.col("unreported") == 0))
