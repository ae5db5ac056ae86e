"""Two snapshots of the same blocks: what vanished, what is new, what changed, and which lineage explains it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import SIMILAR, may_be_similar, similarity
from docledger.operators.graph import connected


def compare(base: DataFrame, work: DataFrame, key: str, same: Column) -> DataFrame:
    """key and change of a full outer join: new, deleted, modified or unchanged. same compares b.* with w.*."""
    both = base.alias("b").join(work.alias("w"), F.col(f"b.{key}") == F.col(f"w.{key}"), "full_outer")
    change = F.when(F.col(f"b.{key}").isNull(), "new").when(F.col(f"w.{key}").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return both.select(F.coalesce(f"b.{key}", f"w.{key}").alias(key), change.alias("change"))


def claims(work: DataFrame) -> DataFrame:
    """(id, claimed, kind) of lineage attributes."""
    merged = work.select("id", F.explode("supersedes").alias("claimed"), F.lit("supersedes").alias("kind"))
    split = work.where("split_from is not null").select("id", F.col("split_from").alias("claimed"), F.lit("split_from").alias("kind"))
    return merged.unionByName(split)


def vanished(base: DataFrame, work: DataFrame) -> DataFrame:
    """ids of base that work neither has nor claims."""
    return base.select("id").join(work.select("id"), "id", "left_anti").join(claims(work).select(F.col("claimed").alias("id")), "id", "left_anti")


def fresh_claims(base: DataFrame, work: DataFrame) -> DataFrame:
    """Claims that base doesn't have yet. Lineage is permanent, so only these say what happened between the two."""
    return claims(work).join(claims(base), ["id", "claimed", "kind"], "left_anti")


def unknown_claims(base: DataFrame, work: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """New claims that name no block of base, nor one that the registry (id) knows from before."""
    unknown = fresh_claims(base, work).join(base.select(F.col("id").alias("claimed")), "claimed", "left_anti")
    if registered is not None:
        unknown = unknown.join(registered.select(F.col("id").alias("claimed")), "claimed", "left_anti")
    return unknown.select("id", "claimed", "kind")


def lineage_groups(base: DataFrame, work: DataFrame) -> DataFrame:
    """(id, root) of blocks that new lineage ties together, directly or over others; root is the smallest id of the group."""
    edges = fresh_claims(base, work).join(base.where("id is not null").select(F.col("id").alias("claimed")), "claimed", "left_semi")
    return connected(edges.select(F.col("id").alias("a"), F.col("claimed").alias("b"))).select(F.col("node").alias("id"), "root")


def double_claims(work: DataFrame) -> DataFrame:
    """Superseded ids with more than one survivor."""
    return claims(work).where("kind = 'supersedes'").groupBy("claimed").agg(F.count("*").alias("n")).where("n > 1")


def rematch(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_row, tier) for blocks (id or row, type, path, ordinal, hash, norm) of two readings of a document.

    Tier 1: type, path, ordinal and hash; tier 2: type, path and hash, in order; tier 3: type, path and ordinal,
    if the texts are similar enough. What a tier matches is out of the next.
    """
    place = ["type", "path"]
    exact = [*place, "ordinal", "hash"]
    first = old.select(*exact, F.col("id").alias("old_id")).join(new.select(*exact, F.col("row").alias("new_row")), exact).select("old_id", "new_row", F.lit(1).alias("tier"))
    old2 = old.join(first.select(F.col("old_id").alias("id")), "id", "left_anti")
    new2 = new.join(first.select(F.col("new_row").alias("row")), "row", "left_anti")
    rank = F.row_number().over(Window.partitionBy(*place, "hash").orderBy("ordinal"))
    a = old2.withColumn("rank", rank).select(*place, "hash", "rank", F.col("id").alias("old_id"))
    b = new2.withColumn("rank", rank).select(*place, "hash", "rank", F.col("row").alias("new_row"))
    second = a.join(b, [*place, "hash", "rank"]).select("old_id", "new_row", F.lit(2).alias("tier"))
    a = old2.select(*place, "ordinal", F.col("id").alias("old_id"), F.col("norm").alias("was")).join(second.select("old_id"), "old_id", "left_anti")
    b = new2.select(*place, "ordinal", F.col("row").alias("new_row"), F.col("norm").alias("now")).join(second.select("new_row"), "new_row", "left_anti")
    third = a.join(b, [*place, "ordinal"]).where(may_be_similar(F.col("was"), F.col("now"))).where(similarity("was", "now") >= SIMILAR).select("old_id", "new_row", F.lit(3).alias("tier"))
    return first.unionByName(second).unionByName(third)


def rematch_summary(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: matched, new, deleted, and matched blocks whose path changed. old: id, path; new: row, path."""
    both = old.select("id", F.col("path").alias("was")).join(matches.select(F.col("old_id").alias("id"), F.col("new_row").alias("row")), "id", "full_outer")
    both = both.join(new.select("row", F.col("path").alias("now")), "row", "full_outer")
    met = F.col("id").isNotNull() & F.col("row").isNotNull()
    return both.agg(F.count_if(met).alias("matched"), F.count_if(F.col("id").isNull()).alias("new"), F.count_if(F.col("row").isNull()).alias("deleted"), F.count_if(met & (F.col("was") != F.col("now"))).alias("moved"))
