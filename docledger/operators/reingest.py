"""Reading a document again: sections keep their IDs from the top down, and blocks within them.

A new reading is a stream of items (doc, at, kind, level, text); at is their order. Its sections and blocks get the IDs of the last
reading (doc, id, section, parent, depth, type, ordinal, hash, norm) where they match, and new ones else. A block's path
is the IDs of its section and what is above it, never numbers, so a section's ID must be known before what is below it can be
matched: one round for each depth of headings, whose matches are written before the next. A section's heading stands
among those of its siblings; all other blocks stand in their section. Documents are independent, so rounds depend on
the depth of headings (six levels at most), not on the number of documents or blocks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import block_id, normalize
from docledger.operators.structure import ordinals, paths, segment
from docledger.operators.versions import rematch
from docledger.sources import scratch

#: What the section before a document's first heading is called unless the document has a title.
FRONT = "Front matter"


def with_front_matter(items: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """items, and for each document that doesn't begin with a heading one of level 0 before its first item.

    titles: (doc, title) of documents that have a title property.
    """
    first = items.groupBy("doc").agg(F.min(F.struct("at", "kind")).alias("x")).where("x.kind <> 'heading'")
    if titles is None:
        named = first.withColumn("title", F.lit(None).cast("string"))
    else:
        named = first.join(titles.select("doc", "title"), "doc", "left")
    title = F.when(F.trim("title") != "", F.col("title")).otherwise(F.lit(FRONT))
    at = (F.col("x.at") - 1).cast(items.schema["at"].dataType)
    return items.select("doc", "at", "kind", "level", "text").unionByName(named.select("doc", at.alias("at"), F.lit("heading").alias("kind"), F.lit(0).cast(items.schema["level"].dataType).alias("level"), title.alias("text")))


def structured(items: DataFrame, split_level: int = 2) -> DataFrame:
    """(doc, row, section, parent, depth, type, ordinal, hash, norm) of a reading; rows are named by their `at`.

    section and parent are rows too. The heading of a section has itself as section; its ordinal counts the sections under the same
    parent. Items that come before any heading need with_front_matter().
    """
    rows = segment(items, "doc", ["at"], split_level).where("section_no > 0").withColumn("norm", normalize("text"))
    rows = rows.withColumn("hash", F.substring(F.sha2("norm", 256), 1, 8))
    heads = rows.where(f"kind = 'heading' and level <= {split_level}").select("doc", F.col("at").alias("id"), "level", "section_no", "norm", "hash")
    tree = paths(heads, "doc", ["id"], split_level).select("doc", F.col("id").alias("section"), "parent", (F.size("path_ids") + F.when(F.col("level") > 0, 1).otherwise(0)).alias("depth"), "section_no", "norm", "hash")
    tree = tree.withColumn("_order", F.col("section"))
    tops = ordinals(tree, ["doc", "parent", "depth"], "depth", ["_order"])
    sections = tops.select("doc", F.col("section").alias("row"), "section", "parent", "depth", F.lit("heading").alias("type"), "ordinal", "hash", "norm")
    inner = rows.where(f"not (kind = 'heading' and level <= {split_level})").join(tree.select("doc", "section_no", "section", "parent", "depth"), ["doc", "section_no"])
    inner = ordinals(inner, ["doc", "section"], "kind", ["at"])
    return sections.unionByName(inner.select("doc", F.col("at").alias("row"), "section", "parent", "depth", F.col("kind").alias("type"), "ordinal", "hash", "norm"))


def _round(old: DataFrame, new: DataFrame, by_place: bool) -> DataFrame:
    """(doc, id, row, tier) of one depth's blocks; path is the ID that both stand under.

    by_place: what is left matches at the same place among its siblings however its text changed, so that a renamed heading
    keeps its section.
    """
    key = F.concat_ws("/", F.col("doc").cast("string"), F.coalesce("above", F.lit("")))
    a = old.select(F.struct("doc", "id").alias("id"), key.alias("path"), "type", "ordinal", "hash", "norm")
    b = new.select(F.struct("doc", "row").alias("row"), key.alias("path"), "type", "ordinal", "hash", "norm")
    found = rematch(a, b)
    if by_place:
        found = scratch.written(found)
        left = a.join(found.select(F.col("old_id").alias("id")), "id", "left_anti").select("path", "ordinal", F.col("id").alias("old_id"))
        right = b.join(found.select(F.col("new_row").alias("row")), "row", "left_anti").select("path", "ordinal", F.col("row").alias("new_row"))
        found = found.unionByName(left.join(right, ["path", "ordinal"]).select("old_id", "new_row", F.lit(3).alias("tier")))
    return found.select(F.col("old_id.doc").alias("doc"), F.col("old_id.id").alias("id"), F.col("new_row.row").alias("row"), "tier")


def assigned(old: DataFrame, new: DataFrame, next_of: DataFrame, depths: int = 6) -> DataFrame:
    """(doc, row, section, id, section_id, tier) of every row of a new reading, as structured() gives it; tier 0 has a new ID.

    old has ids where new has rows; next_of: (doc, next), the first number that a document hasn't used yet. Every old ID and
    every new row is used once at most. New IDs follow the order of rows.
    """
    is_section = F.col("type").eqNullSafe("heading") & (F.col("row") == F.col("section"))
    was_section = F.col("type").eqNullSafe("heading") & (F.col("id") == F.col("section"))
    old_heads, new_heads = scratch.written(old.where(was_section)), scratch.written(new.where(is_section))
    known = None
    for depth in range(depths + 1):
        a = old_heads.where(F.col("depth") == depth).withColumn("above", F.col("parent"))
        b = new_heads.where(F.col("depth") == depth)
        if depth < 2:
            b = b.withColumn("above", F.lit(None).cast("string"))
        else:
            if b.isEmpty():
                break
            # Under a section that is new there is nothing to match.
            b = b.join(known.select("doc", F.col("row").alias("parent"), F.col("id").alias("above")), ["doc", "parent"])
        met = scratch.written(_round(a, b, True))
        known = met if known is None else known.unionByName(met)
    heads = scratch.written(known)
    old_blocks = old.where(~was_section).withColumn("above", F.col("section"))
    new_blocks = new.where(~is_section).join(heads.select("doc", F.col("row").alias("section"), F.col("id").alias("above")), ["doc", "section"])
    met = scratch.written(heads.unionByName(_round(old_blocks, new_blocks, False)))
    rows = new.select("doc", "row", "section").join(met, ["doc", "row"], "left")
    fresh = rows.where("id is null").join(next_of, "doc", "left")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("row")) + F.coalesce("next", F.lit(1)) - 1
    fresh = scratch.written(fresh.select("doc", "row", "section", block_id(F.col("doc").cast("string"), number).alias("id"), F.lit(0).alias("tier")))
    every = rows.where("id is not null").select("doc", "row", "section", "id", "tier").unionByName(fresh)
    names = heads.select("doc", F.col("row").alias("section"), F.col("id").alias("section_id")).unionByName(fresh.where("row = section").select("doc", "section", F.col("id").alias("section_id")))
    return every.join(names, ["doc", "section"]).select("doc", "row", "section", "id", "section_id", "tier")


def gone(old: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, id) of the last reading that no row of the new one has: they are deleted."""
    return old.select("doc", "id").join(found.select("doc", "id"), ["doc", "id"], "left_anti")


def summary(old: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, matched, new, deleted, moved) of each document; blocks are matched within sections, so none has moved."""
    both = found.select("doc", "id", "tier").join(old.select("doc", "id", F.lit(True).alias("_was")), ["doc", "id"], "full_outer")
    return both.groupBy("doc").agg(F.count_if(F.col("tier") > 0).alias("matched"), F.count_if(F.col("tier") == 0).alias("new"), F.count_if(F.col("tier").isNull()).alias("deleted"), F.lit(0).cast("long").alias("moved"))
