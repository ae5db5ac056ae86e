"""The registry of block IDs: reading, assigning, lineage, and its states, which never leave a terminal one.

registry: id, key, status, merged_into, split_into (array), type, section, text_hash, first_seen, last_seen.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.functions.text import match_key, text_hash
from docledger.operators.structure import ordinals
from docledger.operators.vault import document_of, plain_of
from docledger.sources import scratch

ENTRY = "key string, status string, merged_into string, split_into array<string>, type string, section string, text_hash string, first_seen string, last_seen string"
#: The states that no block leaves.
TERMINAL = ("deleted", "merged", "split")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries of registry files (JSON documents of one registry each), with doc_key and next."""
    raw = spark.read.schema(f"version int, doc_key string, next long, blocks map<string, struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY.split(', '))}>>").json(path, multiLine=True)
    return raw.select("doc_key", "next", F.explode("blocks").alias("id", "entry")).select("doc_key", "next", "id", "entry.*")


def registry_text(entries: DataFrame) -> DataFrame:
    """(doc_key, text): each document's entries as JSON, keys sorted and indented by two, the same bytes each time."""
    fields = sorted(f.split(" ")[0] for f in ENTRY.split(", "))
    indent = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f'      "{name}": '), F.expr(f"substring(to_json(struct({name} as v)), 6, length(to_json(struct({name} as v))) - 6)")))
    entry = F.concat(F.lit("    "), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(": {\n"), F.array_join(F.array_compact(F.array(*[indent(f) for f in fields])), ",\n"), F.lit("\n    }"))
    rows = entries.groupBy("doc_key", "next").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("t")))), lambda x: x["t"]), ",\n").alias("body"))
    text = F.concat(F.lit('{\n  "blocks": {\n'), "body", F.lit('\n  },\n  "doc_key": "'), "doc_key", F.lit('",\n  "next": '), F.col("next").cast("string"), F.lit(',\n  "version": 1\n}\n'))
    return rows.select("doc_key", text.alias("text"))


def entries_of(blocks: DataFrame, derived: DataFrame, label: str) -> DataFrame:
    """Active entries of all blocks with an id, as first and last seen in label. The key is built from section IDs."""
    rows = ordinals(blocks.where("id is not null").withColumn("section", F.col("file")), ["section"], "type", ["block_index"])
    rows = rows.withColumn("text_hash", text_hash(plain_of())).join(derived.select("file", "path_ids"), "file")
    key = match_key(F.array_join("path_ids", "/"), F.col("type"), F.col("ordinal"), F.col("text_hash"))
    none = F.lit(None)
    return rows.select("id", key.alias("key"), F.lit("active").alias("status"), none.cast("string").alias("merged_into"), none.cast("array<string>").alias("split_into"), "type", "section", "text_hash", F.lit(label).alias("first_seen"), F.lit(label).alias("last_seen"))


def assign_ids(blocks: DataFrame, next_of: DataFrame) -> DataFrame:
    """blocks, in which those without an id get one: numbers of their document from its `next` on (next_of: doc, next).

    Numbers follow the order of files and blocks; ids that are there stay.
    """
    rows = blocks.withColumn("doc", document_of())
    fresh = rows.where("id is null").select("doc", "file", "block_index")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("file", "block_index"))
    fresh = fresh.withColumn("_n", place).join(next_of, "doc", "left").select("doc", "file", "block_index", F.concat("doc", F.lit("-"), F.lpad((F.coalesce("next", F.lit(1)) + F.col("_n") - 1).cast("string"), 6, "0")).alias("_new"))
    return rows.join(fresh, ["doc", "file", "block_index"], "left").withColumn("id", F.coalesce("id", "_new")).drop("_new", "doc")


def updated(registry: DataFrame, work: DataFrame, label: str, allow_delete: bool = False) -> DataFrame:
    """The registry after a clean run over work: every entry stays, terminal ones as they are.

    What a block supersedes is merged into it, what blocks are split from is split into all of them; other active ids
    that work lacks are deleted if that is allowed; those that work has were last seen in label.
    """
    merged = work.where("id is not null").select(F.explode("supersedes").alias("id"), F.col("id").alias("by")).groupBy("id").agg(F.min("by").alias("_into"))
    split = work.where("id is not null and split_from is not null").groupBy(F.col("split_from").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("_parts"))
    here = work.where("id is not null").select("id").distinct().withColumn("_here", F.lit(True))
    rows = registry.join(merged, "id", "left").join(split, "id", "left").join(here, "id", "left")
    active, lost = F.col("status") == "active", F.col("_here").isNull()
    into, parts = active & F.col("_into").isNotNull(), active & F.col("_into").isNull() & F.col("_parts").isNotNull() & lost
    status = F.when(into, "merged").when(parts, "split").when(active & lost & F.lit(allow_delete), "deleted").otherwise(F.col("status"))
    return rows.select(
        "id",
        "key",
        status.alias("status"),
        F.when(into, F.col("_into")).otherwise(F.col("merged_into")).alias("merged_into"),
        F.when(parts, F.col("_parts")).otherwise(F.col("split_into")).alias("split_into"),
        "type",
        "section",
        "text_hash",
        "first_seen",
        F.when(active & ~lost, label).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def broken_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, was, now) of entries that left a terminal state, were removed, or lack what their state needs."""
    both = before.select("id", F.col("status").alias("was")).join(after.select("id", F.col("status").alias("now"), "merged_into", "split_into"), "id", "full_outer")
    left = F.col("was").isin(*TERMINAL) & ~F.col("was").eqNullSafe(F.col("now"))
    removed = F.col("was").isNotNull() & F.col("now").isNull()
    lacking = ((F.col("now") == "merged") & F.col("merged_into").isNull()) | ((F.col("now") == "split") & F.col("split_into").isNull())
    return both.where(left | removed | lacking).select("id", "was", "now")


def replayed(runs: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry after a log of runs, and the forbidden moves in it: one pass, however many runs.

    runs: (doc, n, label, allow_delete), n grows; seen: (doc, n, id, supersedes, split_from), a row for each block of each run. Returns
    (id, status, merged_into, split_into, first_seen, last_seen) and (id, n, was, move):
    a block is merged in the first run in which another supersedes it, else, in the first run that lacks it, split if it is what
    others are split from by then, deleted if that run allows it, and otherwise vanished, which leaves it active. What comes after a
    terminal state is forbidden: back (seen again), merged or split (newly claimed). unknown is a claim of what no run before had.
    Labels are those of the runs in which a block was active.
    """
    order = Window.partitionBy("doc").orderBy("n")
    steps = runs.withColumn("step", F.row_number().over(order))
    here = seen.join(steps.select("doc", "n", "step", "label"), ["doc", "n"])
    last_step = steps.groupBy("doc").agg(F.max("step").alias("final"))
    claims = here.select("doc", "step", F.explode(F.concat(F.transform(F.coalesce("supersedes", F.array().cast("array<string>")), lambda x: F.struct(F.lit("merged").alias("kind"), x.alias("id"))), F.filter(F.array(F.struct(F.lit("split").alias("kind"), F.col("split_from").alias("id"))), lambda x: x["id"].isNotNull()))).alias("c"), F.col("id").alias("by"))
    claims = claims.groupBy("doc", "c.id", "c.kind", "by").agg(F.min("step").alias("step"))
    # The first run that lacks a block, by gaps between the runs that have it.
    own = Window.partitionBy("doc", "id").orderBy("step")
    gaps = here.select("doc", "id", "step", "label").distinct().withColumn("next", F.lead("step").over(own)).join(last_step, "doc")
    gap = F.when(F.coalesce("next", F.col("final") + 1) > F.col("step") + 1, F.col("step") + 1)
    blocks = gaps.groupBy("doc", "id").agg(F.min("step").alias("first"), F.min(gap).alias("lost"), F.array_sort(F.collect_list(F.struct("step", "label"))).alias("_seen"))
    first_of = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("step", "by")))
    claimed = claims.groupBy("doc", "id").agg(first_of("merged").alias("_merged"), F.array_sort(F.collect_list(F.when(F.col("kind") == "split", F.struct("step", "by")))).alias("_split"))
    rows = blocks.join(claimed, ["doc", "id"], "full_outer")
    parts = F.filter("_split", lambda x: x["step"] <= F.col("lost"))
    rows = rows.join(steps.select("doc", F.col("step").alias("lost"), F.col("allow_delete").alias("_allowed")), ["doc", "lost"], "left").withColumn("_parts", parts)
    merged = F.col("_merged").isNotNull() & (F.col("lost").isNull() | (F.col("_merged.step") <= F.col("lost")))
    status = F.when(merged, "merged").when(F.size("_parts") > 0, "split").when(F.col("lost").isNotNull() & F.col("_allowed"), "deleted").otherwise("active")
    ended = F.when(merged, F.col("_merged.step")).when(status != "active", F.col("lost"))
    rows = scratch.written(rows.withColumns({"status": status, "ended": ended}))
    active = F.filter("_seen", lambda x: F.col("ended").isNull() | (x["step"] < F.col("ended")))
    known = rows.where("first is not null")
    registry = known.select("id", "status", F.when(F.col("status") == "merged", F.col("_merged.by")).alias("merged_into"), F.when(F.col("status") == "split", F.array_sort(F.array_distinct(F.transform("_parts", lambda x: x["by"])))).alias("split_into"), F.get("_seen", F.lit(0))["label"].alias("first_seen"), F.element_at(F.when(F.size(active) > 0, active).otherwise(F.col("_seen")), -1)["label"].alias("last_seen"))
    back = known.select("doc", "id", F.col("status").alias("was"), F.explode("_seen").alias("x"), "ended").where("x.step >= ended").groupBy("doc", "id", "was").agg(F.min("x.step").alias("step")).withColumn("move", F.lit("back"))
    late = claims.join(rows.select("doc", "id", "status", "ended", "first"), ["doc", "id"])
    again = late.where((F.col("step") > F.col("ended")) | ((F.col("kind") == "split") & (F.col("status") == "merged"))).groupBy("doc", "id", F.col("status").alias("was"), "kind").agg(F.min("step").alias("step")).withColumnRenamed("kind", "move")
    unknown = late.where(F.col("first").isNull() | (F.col("first") >= F.col("step"))).groupBy("doc", "id").agg(F.min("step").alias("step")).withColumns({"was": F.lit("none"), "move": F.lit("unknown")})
    vanished = known.where("lost is not null and ended is null").select("doc", "id", F.lit("active").alias("was"), F.col("lost").alias("step"), F.lit("vanished").alias("move"))
    moves = back.unionByName(again).unionByName(unknown).unionByName(vanished).join(steps.select("doc", "step", "n"), ["doc", "step"])
    return registry, moves.select("id", "n", "was", "move")
