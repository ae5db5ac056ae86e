"""Derived data of a vault's sections: tree, front matter, index and backlinks.

blocks: as sources.sections.blocks() gives them; stored: (file, fields) of sources.sections.front_matter().
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.plain import to_plain_text
from docledger.functions.text import breadcrumb, links_of, words
from docledger.operators import structure as S
from docledger.sources.sections import KEYS, rendered

#: Fixed value: bytes from which an index is too large.
INDEX_BYTES = 40 * 1024
#: The front-matter keys that are derived.
DERIVED = ("number", "title", "level", "parent", "order", "path", "path_ids", "breadcrumb", "refs_out", "blocks", "words")


def plain_of() -> Column:
    return to_plain_text(F.col("type"), F.col("content"), F.col("attrs")["format"])


def document_of(file: str = "file") -> Column:
    return F.regexp_extract(file, r"^(.*)-\d+$", 1)


def heading_parts(content: Column) -> tuple[Column, Column, Column]:
    """Level, number and title of a heading line."""
    line = F.split_part(content, F.lit("\n"), F.lit(1))
    level = F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1))
    number = F.regexp_extract(line, r"^#{1,6} (\d+(?:\.\d+)*)(?: |$)", 1)
    return level, number, F.trim(F.regexp_replace(line, r"^#{1,6} (?:\d+(?:\.\d+)*(?: |$))?", ""))


def link_rows(blocks: DataFrame) -> DataFrame:
    """(file, id, section, block, target) of every wikilink; block is null in links to sections, target as it is written."""
    rows = blocks.select("file", "id", F.explode(links_of(F.col("content"))).alias("l"))
    return rows.select("file", "id", "l.section", "l.block", F.concat_ws("#^", "l.section", "l.block").alias("target"))


def sections(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """file, doc and the derived keys of each section; every document is ordered by its stored order, then by file name."""
    level, number, title = heading_parts(F.col("content"))
    heads = blocks.where("block_index = 0 and type = 'heading'").select("file", level.alias("level"), number.alias("number"), title.alias("title"))
    counts = blocks.groupBy("file").agg(F.count("id").alias("blocks"), F.sum(words(plain_of())).alias("words"))
    refs = link_rows(blocks).groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("refs_out"))
    asked = F.coalesce(stored["fields"]["order"].try_cast("int"), F.lit((1 << 31) - 1)).alias("_asked")
    rows = heads.join(stored.select("file", asked), "file", "left").withColumn("doc", document_of())
    rows = rows.withColumn("order", F.row_number().over(Window.partitionBy("doc").orderBy("_asked", "file")) - 1)
    own = F.struct(F.col("file").alias("id"), "number", "title")
    tree = S.paths(rows.withColumn("id", own), "doc", ["order"])
    whole = F.concat("path_ids", F.array("id"))
    named = lambda x: F.trim(F.concat_ws(" ", x["number"], x["title"]))
    tree = tree.select(
        "file",
        "doc",
        "number",
        "title",
        "level",
        F.col("parent.id").alias("parent"),
        "order",
        F.transform(whole, lambda x: x["number"]).alias("path"),
        F.transform(whole, lambda x: x["id"]).alias("path_ids"),
        breadcrumb("doc", F.array_join(F.transform(whole, named), " > ")).alias("breadcrumb"),
    )
    return tree.join(counts, "file").join(refs, "file", "left").withColumn("refs_out", F.coalesce("refs_out", F.array().cast("array<string>")))


def doubtful_order(stored: DataFrame) -> DataFrame:
    """Files whose stored order is absent, or another file's of the document too."""
    rows = stored.select("file", document_of().alias("doc"), stored["fields"]["order"].try_cast("int").alias("order"))
    n = F.count("order").over(Window.partitionBy("doc", "order"))
    return rows.withColumn("n", n).where("order is null or n > 1").select("file")


def drift(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, key, stored, derived) of each derived key that the front matter states otherwise or not at all."""
    whole = {k: F.to_json(F.struct(F.col(k).alias("v"))) for k in DERIVED}
    own = F.create_map(*[x for k, v in whole.items() for x in (F.lit(k), F.when(v != "{}", F.substring(v, F.lit(6), F.length(v) - 6)))])
    rows = derived.select("file", F.explode(own).alias("key", "derived"))
    both = rows.join(stored.select("file", "fields"), "file").withColumn("stored", F.col("fields")[F.col("key")])
    return both.where(~F.col("stored").eqNullSafe(F.col("derived"))).select("file", "key", "stored", "derived")


def index_lines(derived: DataFrame) -> DataFrame:
    """(doc, order, line): the index of a document, a line for each section."""
    named = F.trim(F.concat_ws(" ", "number", "title"))
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)))
    line = F.concat(indent, F.lit("- "), named, F.lit(" — [["), "file", F.lit("]] · `"), "file", F.lit("` · "), F.col("blocks").cast("string"), F.lit(" blocks · "), F.col("words").cast("string"), F.lit(" words"))
    return derived.select("doc", "order", line.alias("line"))


def index_sizes(lines: DataFrame) -> DataFrame:
    """(doc, bytes, too_large) of each document's index."""
    return lines.groupBy("doc").agg(F.sum(F.octet_length("line") + 1).alias("bytes")).withColumn("too_large", F.col("bytes") > INDEX_BYTES)


def backlink_rows(blocks: DataFrame) -> DataFrame:
    """(target, section, source): for every link target the section that owns it and the blocks that refer to it, a row each.

    A target is a section, or a block of it; targets that don't exist have no owner. Rows, not lists: a hub may have very many.
    """
    links = link_rows(blocks).where("id is not null").select(F.coalesce(F.upper("block"), "section").alias("target"), F.col("id").alias("source")).distinct()
    owners = blocks.where("id is not null").select(F.col("id").alias("target"), F.col("file").alias("section"))
    return links.join(owners, "target", "left").select("target", "section", "source")


def stale(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines of a generated document that it lacks, or has without need: what a check before writing reports."""
    return fresh.exceptAll(kept).withColumn("side", F.lit("missing")).unionByName(kept.exceptAll(fresh).withColumn("side", F.lit("surplus")))


def inbound_impact(base: DataFrame, work: DataFrame) -> DataFrame:
    """(source, target): blocks of unchanged files that link to a block whose bytes changed or that is new."""
    known = base.where("id is not null").select("id", F.col("raw_sha").alias("was"))
    now = work.where("id is not null").join(known, "id", "left").select("file", "id", (~F.col("raw_sha").eqNullSafe(F.col("was"))).alias("changed"))
    changed = now.where("changed")
    links = link_rows(work).where("id is not null").select("file", F.col("id").alias("source"), F.coalesce(F.upper("block"), "section").alias("target"))
    met = links.join(changed.select(F.col("id").alias("target")), "target", "left_semi")
    return met.join(changed.select("file").distinct(), "file", "left_anti").select("source", "target").distinct()


def impacted_files(base: DataFrame, work: DataFrame) -> DataFrame:
    """(file, source, target): inbound_impact() with the changed file that has the target."""
    owners = work.where("id is not null").groupBy(F.col("id").alias("target")).agg(F.min("file").alias("file"))
    return inbound_impact(base, work).join(owners, "target").select("file", "source", "target")


def with_markers(blocks: DataFrame) -> DataFrame:
    """blocks with the markers that they must have: those of link targets that aren't headings, named by their anchor.

    Others lose theirs.
    """
    asked = link_rows(blocks).where("block is not null").select(F.upper("block").alias("id")).distinct().withColumn("_asked", F.lit(True))
    rows = blocks.join(asked, "id", "left")
    return rows.withColumn("marker", F.when(F.col("_asked") & (F.col("type") != "heading"), F.lower("id"))).drop("_asked").select(*blocks.columns)


def front_texts(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, front): front matter with the keys in their fixed order, derived ones anew and the others as they are stored.

    Values are written as JSON, which YAML reads; source alone is a flow mapping in any case.
    """
    both = derived.join(stored.select("file", "fields"), "file", "left")
    lines = []
    for key in KEYS:
        value = F.col("fields")[key]
        if key in DERIVED:
            whole = F.to_json(F.struct(F.col(key).alias("v")))
            value = F.when(whole != "{}", F.substring(whole, F.lit(6), F.length(whole) - 6))
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value)))
    return both.select("file", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("front"))


def formatted_files(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, text) of every section file in the fixed format, with markers and derived keys as they must be."""
    marked = with_markers(blocks)
    return rendered(marked, front_texts(sections(marked, stored), stored))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Those rows (file, text) of after that before has otherwise or not at all: what has to be written."""
    return after.join(before.select("file", F.col("text").alias("_was")), "file", "left").where(~F.col("text").eqNullSafe(F.col("_was"))).drop("_was")
