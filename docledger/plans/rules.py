"""Validation rules over blocks of a base and a working snapshot; each gives findings.

blocks: as sources.sections.blocks() gives them. Findings: file, rule, severity, block_id, message, old, new; old and new are null unless
the rule compares a pair.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.html import well_formed
from docledger.functions.numeric import numeric_changes
from docledger.functions.schema import ID, faults
from docledger.functions.text import links_of, words
from docledger.operators import vault
from docledger.operators import versions as V
from docledger.sources import scratch

LARGE = 1500
#: Block types.
TYPES = ("heading", "paragraph", "list", "table", "figure", "formula", "code", "raw")


def _finding(rows: DataFrame, rule: str, severity: str, message, old=None, new=None) -> DataFrame:
    block = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
    file = F.col("file") if "file" in rows.columns else F.lit(None).cast("string")
    return rows.select(file.alias("file"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), block.alias("block_id"), message.alias("message"), *[(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in (("old", old), ("new", new))])


def locked() -> F.Column:
    """Whether a block is locked: by its attribute, or by its type if it has none."""
    by_type = F.col("type").isin("figure", "raw") | ((F.col("type") == "formula") & F.coalesce(F.col("attrs")["format"] == "image", F.lit(False)))
    return F.when(F.col("attrs")["locked"].isNotNull(), F.col("attrs")["locked"] == "true").otherwise(by_type)


def schema_faults(front: DataFrame) -> DataFrame:
    """(file, key, path, fault) of front matter (file, valid, fields) against the schema of sections."""
    name = lambda k: F.to_json(F.struct(k.alias("v")))
    pair = lambda e: F.concat(F.substring(name(e["key"]), F.lit(6), F.length(name(e["key"])) - 6), F.lit(":"), e["value"])
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("fields"), pair), ","), F.lit("}"))
    rows = front.where("valid").select("file", F.explode_outer(faults(text, "section")).alias("x")).where("x is not null")
    return rows.select("file", F.regexp_extract("x.path", r"^\$\.([^.\[]+)", 1).alias("key"), "x.path", "x.fault")


def v01(base, work, ctx):
    front = ctx["front"]
    broken = _finding(front.where(~F.col("valid")), "V01", "error", F.lit("front matter can't be read"))
    other = front.where(F.col("valid") & F.col("fields")["id"].isNotNull() & (F.col("fields")["id"] != F.concat(F.lit('"'), "file", F.lit('"'))))
    wrong = _finding(schema_faults(front), "V01", "error", F.concat(F.lit("front matter breaks its schema: "), "path", F.lit(" "), "fault"))
    return broken.unionByName(_finding(other, "V01", "error", F.lit("id differs from the file name"))).unionByName(wrong)


def v02(base, work, ctx):
    a = F.col("attrs")
    flag = lambda k: a[k].isNotNull() & ~a[k].isin("true", "false")
    fault = (
        F.when(F.col("n_anchors") > 1, "more than one anchor")
        .when(F.col("id").isNull() | ~F.col("id").rlike(ID), "anchor without a valid id")
        .when(~F.coalesce(a["type"].isin(*TYPES), F.lit(False)), "unknown block type")
        .when((F.col("type") == "table") & ~F.coalesce(a["format"].isin("pipe", "html"), F.lit(False)), "table without its format")
        .when((F.col("type") == "figure") & a["asset"].isNull(), "figure without an asset")
        .when((F.col("type") == "formula") & ~F.coalesce((a["format"] == "latex") | ((a["format"] == "image") & a["asset"].isNotNull()), F.lit(False)), "formula without its format or asset")
        .when((F.col("type") == "raw") & ~F.coalesce((a["fallback"] == "true") & a["asset"].isNotNull(), F.lit(False)), "raw block without fallback and asset")
        .when(flag("locked") | flag("ordered"), "attribute that must be true or false")
    )
    rows = work.where("n_anchors > 0").withColumn("fault", fault).where("fault is not null")
    return _finding(rows, "V02", "error", F.col("fault"))


def v03(base, work, ctx):
    return _finding(work.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1"), "V03", "error", F.concat(F.lit("id used "), F.col("n").cast("string"), F.lit(" times")))


def v04(base, work, ctx):
    gone = V.vanished(base.where("id is not null"), work)
    return _finding(gone.join(base.select("id", "file"), "id"), "V04", "info" if ctx.get("allow_delete") else "error", F.lit("id of base vanished without lineage"))


def v04a(base, work, ctx):
    unknown = V.unknown_claims(base, work, ctx.get("registry")).join(work.select("id", "file").dropDuplicates(["id"]), "id", "left")
    return _finding(unknown, "V04a", "error", F.concat(F.lit("lineage names unknown "), "claimed"))


def v04b(base, work, ctx):
    return _finding(V.double_claims(work).withColumnRenamed("claimed", "id"), "V04b", "error", F.lit("superseded by more than one block"))


def v05(base, work, ctx):
    kept = base.where("id is not null").where(locked()).select("id", F.col("raw_sha").alias("was"))
    changed = work.join(kept, "id").where("raw_sha <> was")
    return _finding(changed, "V05", "error", F.concat(F.lit("locked "), "type", F.lit(" block modified")))


def v06(base, work, ctx):
    lines = work.where("type = 'table'").select("file", "id", F.col("attrs")["format"].alias("format"), "content")
    widths = lines.where("format = 'pipe'").select("file", "id", F.explode(F.split("content", "\n")).alias("line")).groupBy("file", "id").agg(F.min(F.size(F.split("line", r"(?<!\\)\|"))).alias("a"), F.max(F.size(F.split("line", r"(?<!\\)\|"))).alias("b"))
    ragged = _finding(widths.where("a <> b"), "V06", "error", F.lit("rows of a pipe table differ in width"))
    return ragged.unionByName(_finding(lines.where("format = 'html'").where(~well_formed("content")), "V06", "error", F.lit("HTML table is malformed")))


def v07(base, work, ctx):
    links = work.select("file", "id", F.explode(links_of(F.col("content"))).alias("l")).select("file", "id", "l.section", F.lower("l.block").alias("marker"))
    sections = work.select(F.col("file").alias("section")).distinct()
    marks = work.where("marker is not null").select(F.col("file").alias("section"), F.lower("marker").alias("marker")).distinct()
    lost = links.join(sections, "section", "left_anti").unionByName(links.where("marker is not null").join(sections, "section", "left_semi").join(marks, ["section", "marker"], "left_anti").select("section", "file", "id", "marker"))
    return _finding(lost, "V07", "error", F.concat(F.lit("wikilink target "), F.concat_ws("#^", "section", "marker"), F.lit(" does not exist")))


def v08(base, work, ctx):
    rows = work.where(F.col("type").isin("figure", "formula", "raw")).withColumn("asset", F.col("attrs")["asset"]).where("asset is not null")
    return _finding(rows.join(ctx["assets"], "asset", "left_anti"), "V08", "error", F.concat(F.lit("missing asset "), "asset"))


def v09(base, work, ctx):
    counted = work.groupBy("file").agg(F.count("id").alias("n"))
    rows = ctx["front"].select("file", F.col("fields")["blocks"].alias("said")).join(counted, "file").where(~F.col("said").eqNullSafe(F.col("n").cast("string")))
    message = F.concat(F.lit("front matter counts "), F.coalesce("said", F.lit("no")), F.lit(" blocks, the file has "), F.col("n").cast("string"))
    return _finding(rows, "V09", "warn", message, F.col("said"), F.col("n"))


def v10(base, work, ctx):
    groups = scratch.sized(scratch.written(V.lineage_groups(base, work)), 64)
    rows = numeric_changes(base, work, tuple(ctx.get("extra_units", ())), groups)
    rows = rows.join(work.where("id is not null").groupBy("id").agg(F.min("file").alias("file")), "id")
    one = lambda side: F.when(F.col("message").startswith("number changed"), F.col(side)[0])
    return _finding(rows, "V10", "warn", F.col("message"), one("removed"), one("added"))


def v11(base, work, ctx):
    return _finding(work.where("n_anchors = 0"), "V11", "warn", F.lit("block without an anchor"))


def v12(base, work, ctx):
    level, number, _ = vault.heading_parts(F.col("content"))
    parts = lambda t, p: t.where("type = 'heading' and id is not null").select("id", "file", F.trim(F.concat_ws(" ", F.repeat(F.lit("#"), level), number)).alias(p))
    rows = parts(work, "now").join(parts(base, "was").drop("file"), "id").where("now <> was")
    return _finding(rows, "V12", "warn", F.lit("level or number of a heading changed"), F.col("was"), F.col("now"))


def v13(base, work, ctx):
    asked = work.select(F.explode(links_of(F.col("content"))).alias("l")).where("l.block is not null").select(F.upper("l.block").alias("id")).distinct()
    lacking = work.join(asked, "id", "left_semi").where("marker is null and type <> 'heading'")
    wrong = work.where(F.col("marker").isNotNull() & ~F.coalesce(F.upper("marker") == F.col("id"), F.lit(False)))
    return _finding(lacking, "V13", "error", F.lit("link target without a marker")).unionByName(_finding(wrong, "V13", "warn", F.lit("marker that differs from its anchor")))


def v14(base, work, ctx):
    sizes = work.groupBy("file").agg(F.sum(words(vault.plain_of())).alias("n")).where(F.col("n") > ctx.get("large", LARGE))
    return _finding(sizes, "V14", "info", F.concat(F.lit("section has "), F.col("n").cast("string"), F.lit(" words")))


def v15(base, work, ctx):
    rows = vault.drift(vault.sections(work, ctx["front"]), ctx["front"]).where("key <> 'blocks'")
    doubtful = _finding(vault.doubtful_order(ctx["front"]), "V15", "info", F.lit("order is absent or another file's too"))
    return _finding(rows, "V15", "warn", F.concat("key", F.lit(" differs from what the vault says")), F.col("stored"), F.col("derived")).unionByName(doubtful)


#: Byte order mark, carriage returns, trailing spaces, more than one blank line, tabs outside of fences, no single line feed at the end.
FAULTS = r"\A\x{FEFF}|\r|[ \t]+\n|\n\n\n"


def v16(base, work, ctx):
    text = F.col("text")
    outside = F.regexp_replace(text, r"(?ms)^```.*?^```[^\n]*$", "")
    rows = ctx["files"].where(text.rlike(FAULTS) | outside.contains("\t") | ~text.rlike(r"[^\n]\n\z"))
    return _finding(rows, "V16", "warn", F.lit("file isn't in the fixed format"))


def v17(base, work, ctx):
    rows = ctx["front"].where(F.coalesce(F.col("fields")["ingest_version"].try_cast("int"), F.lit(0)) < ctx["version"])
    return _finding(rows, "V17", "error", F.concat(F.lit("file is of an older ingest; migrate it to version "), F.lit(str(ctx["version"]))))


RULES = {f.__name__.replace("v", "V", 1): f for f in (v01, v02, v03, v04, v04a, v04b, v05, v06, v07, v08, v09, v10, v11, v12, v13, v14, v15, v16, v17)}
#: What a rule needs beyond the two snapshots.
NEEDS = {"V01": ("front",), "V08": ("assets",), "V09": ("front",), "V15": ("front",), "V16": ("files",), "V17": ("front", "version")}


def validate(base: DataFrame, work: DataFrame, ctx: dict | None = None) -> DataFrame:
    """Findings of all rules whose inputs ctx has: front, files, assets (a column asset), version, allow_delete, large, extra_units."""
    ctx = ctx or {}
    found = None
    for name, rule in RULES.items():
        if all(k in ctx for k in NEEDS.get(name, ())):
            rows = rule(base, work, ctx)
            found = rows if found is None else found.unionByName(rows)
    return found


def summary(findings: DataFrame) -> DataFrame:
    """(severity, n, files) of findings."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def listing(findings: DataFrame) -> DataFrame:
    """(file, block_id, rule, line): findings as lines of text, to be sorted by these columns when they are shown."""
    line = F.concat_ws("  ", F.rpad("rule", 4, " "), F.rpad("severity", 5, " "), F.coalesce("block_id", F.lit("-")), "message")
    return findings.select("file", "block_id", "rule", line.alias("line"))


def report(findings: DataFrame, files_checked: int, impact: DataFrame, against: str) -> DataFrame:
    """(part, file, block_id, rule, line): the whole report; sorted by its columns, nulls first, it reads from top to bottom.

    Part 0 has a line for each file with findings and theirs below it, part 1 the summary, part 2 what inbound links affect: a line for
    each changed file, with the blocks (impact: file, source, target) that link into it from files that didn't change.
    """
    lines = listing(findings).select(F.lit(0).alias("part"), "file", "block_id", "rule", F.concat(F.lit("  "), "line").alias("line"))
    heads = findings.select("file").distinct().select(F.lit(0).alias("part"), "file", F.lit(None).cast("string").alias("block_id"), F.lit("").alias("rule"), F.concat(F.coalesce("file", F.lit("(vault)")), F.when(F.col("file").isNotNull(), ".md").otherwise("")).alias("line"))
    n = lambda severity: F.count_if(F.col("severity") == severity).cast("string")
    total = findings.agg(F.concat(F.lit("Summary: "), n("error"), F.lit(" errors, "), n("warn"), F.lit(f" warnings, {files_checked} files checked, base={against}")).alias("line"))
    none = F.lit(None).cast("string")
    total = total.select(F.lit(1).alias("part"), none.alias("file"), none.alias("block_id"), none.alias("rule"), "line")
    met = impact.groupBy("file").agg(F.concat(F.lit("Affected by inbound references: "), F.array_join(F.array_sort(F.collect_set("source")), ", ")).alias("line"))
    met = met.select(F.lit(2).alias("part"), "file", none.alias("block_id"), none.alias("rule"), "line")
    return heads.unionByName(lines).unionByName(total).unionByName(met)


def in_order(report_rows: DataFrame) -> DataFrame:
    """The lines of a report in their order, which is total."""
    return report_rows.orderBy(*[F.asc_nulls_first(c) for c in ("part", "file", "block_id", "rule", "line")])


def as_json(findings: DataFrame) -> DataFrame:
    """(file, json): an object for each finding, with nulls for what it lacks."""
    parts = [F.concat(F.lit(f'"{k}":'), F.when(F.col(k).isNull(), "null").otherwise(F.substring(F.to_json(F.struct(F.col(k).alias("v"))), F.lit(6), F.length(F.to_json(F.struct(F.col(k).alias("v")))) - 6))) for k in ("file", "rule", "severity", "block_id", "message", "old", "new")]
    return findings.select("file", F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")).alias("json"))


def exit_code(findings: DataFrame | None = None, unreadable: bool = False, usage: bool = False) -> int:
    """0 clean, 1 warnings, 2 errors, 3 if files could not be read, 4 if the call was wrong."""
    if usage or unreadable:
        return 4 if usage else 3
    worst = findings.agg(F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warn", 1).otherwise(0))).first()[0]
    return int(worst or 0)
