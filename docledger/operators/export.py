"""The export of a vault: a row for each block with its change against a base, and the rationale of the log.

blocks: as sources.sections.blocks() gives them; derived: operators.vault.sections().
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.numeric import numeric_changes
from docledger.functions.text import normalize
from docledger.operators import versions as V
from docledger.operators.vault import plain_of
from docledger.sources import scratch, workbook


def _texts(blocks: DataFrame) -> DataFrame:
    rows = blocks.where("id is not null").select("id", "file", "block_index", "type", plain_of().alias("content"))
    return rows.withColumn("norm", normalize("content"))


def changes(base: DataFrame, work: DataFrame) -> DataFrame:
    """(id, file, block_index, type, content, change, old) in six kinds, by id and by lineage that base doesn't have yet.

    New lineage comes first: a part of a block is split, a survivor is merged, whether base has its id or not; then presence decides, and
    normalized plain text between unchanged and modified. old is the text of what a part was split from, the texts of a survivor
    and of all that it took in, in the order that base has them, or the block's own. Ids that only base has and that lineage claims
    have no row; the others are deleted.
    """
    old, new = _texts(base), _texts(work)
    claims = scratch.written(V.fresh_claims(base, work))
    of = claims.groupBy("id").agg(F.bool_or(F.col("kind") == "split_from").alias("_split"))
    took = claims.join(of, "id").where("kind = 'split_from' or not _split").select("id", "claimed").unionByName(of.where("not _split").select("id", F.col("id").alias("claimed"))).distinct()
    place = F.struct("file", "block_index", "claimed", F.col("content").alias("text"))
    sources = old.select(F.col("id").alias("claimed"), "file", "block_index", "content")
    texts = took.join(sources, "claimed").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), "\n").alias("_took"))
    known = old.select("id", F.col("content").alias("_was"), F.col("norm").alias("_norm"))
    rows = new.join(known, "id", "left").join(scratch.sized(scratch.written(of.join(texts, "id", "left")), 256), "id", "left")
    change = F.when(F.col("_split"), "split").when(~F.col("_split"), "merged").when(F.col("_was").isNull(), "new").when(F.col("norm") == F.col("_norm"), "unchanged").otherwise("modified")
    rows = rows.withColumn("change", change)
    text = F.when(F.col("change").isin("split", "merged"), F.coalesce("_took", F.lit(""))).when(F.col("change") == "modified", F.col("_was")).when(F.col("change") == "new", "")
    kept = rows.select("id", "file", "block_index", "type", "content", "change", text.alias("old"))
    gone = old.join(new.select("id"), "id", "left_anti").join(V.claims(work).select(F.col("claimed").alias("id")), "id", "left_anti")
    lost = gone.select("id", "file", "block_index", "type", F.lit(None).cast("string").alias("content"), F.lit("deleted").alias("change"), F.col("content").alias("old"))
    return kept.unionByName(lost)


def change_counts(rows: DataFrame) -> DataFrame:
    """(change, n) of changes()."""
    return rows.groupBy("change").agg(F.count("*").alias("n"))


def rationale_of(log: DataFrame, ancestors: DataFrame, last_commits: DataFrame) -> DataFrame:
    """(file, rationale, commit): the latest log row of a section whose commit is an ancestor of the exported state.

    log: ts, sha, section_id, rationale; ancestors: sha; last_commits: (file, sha) stands in, without a rationale, for
    sections that have no such row.
    """
    rows = log.join(ancestors.select("sha").distinct(), "sha", "left_semi")
    latest = rows.groupBy(F.col("section_id").alias("file")).agg(F.max_by(F.struct("rationale", "sha"), F.struct("ts", "sha")).alias("last"))
    both = last_commits.withColumnRenamed("sha", "_sha").join(latest, "file", "full_outer")
    return both.select("file", F.coalesce("last.rationale", F.lit("")).alias("rationale"), F.coalesce("last.sha", "_sha").alias("commit"))


def spec_sheet(changed: DataFrame, derived: DataFrame, reasons: DataFrame) -> DataFrame:
    """The eleven columns of the sheet of all blocks, with doc; order counts a document's blocks from 0 in their order.

    Deleted blocks stand where base has them, without an order. Rows are to be sorted by doc and order when they are written.
    """
    place = derived.select("file", "doc", F.col("number").alias("section"), "breadcrumb", "level", F.col("order").alias("_section"))
    rows = changed.join(place, "file", "left").join(reasons, "file", "left")
    here = Window.partitionBy("doc", F.col("change") == "deleted").orderBy("_section", "block_index", "id")
    order = F.when(F.col("change") != "deleted", F.row_number().over(here) - 1)
    return rows.select("doc", "id", "section", "breadcrumb", "level", order.alias("order"), "type", "content", "change", F.col("old").alias("old_content"), "rationale", "commit")


def changes_sheet(sheet: DataFrame, base: DataFrame, work: DataFrame) -> DataFrame:
    """Rows of the sheet that changed, with numeric_change by the same routine as the validation."""
    groups = scratch.sized(scratch.written(V.lineage_groups(base, work)), 64)
    numbers = numeric_changes(base, work, groups=groups).select("id", F.col("message").alias("numeric_change"))
    return sheet.where("change <> 'unchanged'").join(numbers, "id", "left")


def write_sheets(sheet: DataFrame, changed: DataFrame, folder: str) -> None:
    """Both sheets as CSV below folder, each document's rows together and in order."""
    for name, rows in (("Spec", sheet), ("Changes", changed)):
        rows.repartitionByRange("doc", "order").sortWithinPartitions("doc", "order", "id").write.option("header", "true").csv(f"{folder}/{name}")


#: The columns of the two sheets.
SPEC = ["id", "section", "breadcrumb", "level", "order", "type", "content", "change", "old_content", "rationale", "commit"]
CHANGES = [*SPEC, "numeric_change"]
NOTE = "Rationale and commit are those of the section, not of the block."


def write_workbooks(sheet: DataFrame, changed: DataFrame, folder: str) -> DataFrame:
    """A workbook with both sheets for each document, below folder (a URI that all executors share); returns (doc, bytes)."""
    order = ["order", "id"]
    return workbook.write_workbooks({"Spec": (sheet, SPEC, order), "Changes": (changed, CHANGES, order)}, folder, {"Spec": NOTE, "Changes": NOTE})
