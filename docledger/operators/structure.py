"""Order and place in a document: blocks, IDs, sections, ordinals, paths and list numbers. All windows are per document."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import block_id
from docledger.operators import graph


def block_stream(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, block_index and content of every line that isn't blank, with its type."""
    rows = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("block_index", "content")).where(F.trim("content") != "")
    kind = F.when(F.col("content").rlike("^#{1,6} "), "heading").when(F.col("content").rlike(r"^(?:[-*+]|\d+\.) "), "list").when(F.col("content").contains(" | "), "table").otherwise("paragraph")
    return rows.select(doc, F.col("block_index").cast("long").alias("block_index"), kind.alias("type"), "content")


def allocate_ids(blocks: DataFrame, doc: str, order: list, first: Column) -> DataFrame:
    """blocks with id: numbers in document order, from `first` on, never reused."""
    number = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) + first - 1
    return blocks.withColumn("id", block_id(F.col(doc).cast("string"), number))


#: Positions of a document that one task takes in carried().
STRETCH = 1 << 14


def carried(rows: DataFrame, doc: str, at: str, sums: dict[str, Column], lasts: dict[str, Column], stretch: int = STRETCH) -> DataFrame:
    """rows with running sums and last values that aren't null, both up to and with each row, in the order of `at` (a number).

    A document isn't one window: its rows are dealt by stretches of so many positions; what a stretch ends with is one small row,
    and only those rows are summed up along the document and handed on to the next stretch.
    """
    part = rows.withColumn("_stretch", F.floor(F.col(at) / stretch))
    here = Window.partitionBy(doc, "_stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = part.groupBy(doc, "_stretch").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), F.col(at))).alias(n) for n, c in lasts.items()])
    before = Window.partitionBy(doc).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(doc, "_stretch", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts])
    local = part.withColumns({n: F.sum(c).over(here) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(here) for n, c in lasts.items()})
    both = local.join(handed, [doc, "_stretch"])
    return both.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums} | {n: F.coalesce(n, f"_b_{n}") for n in lasts}).drop("_stretch", *[f"_b_{n}" for n in (*sums, *lasts)])


def segment(items: DataFrame, doc: str, order: list, split_level: int = 2) -> DataFrame:
    """items with section_no: headings up to split_level begin a section, 0 is what stands before the first."""
    starts = (F.col("kind") == "heading") & (F.col("level") <= split_level)
    return items.withColumn("section_no", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def ordinals(blocks: DataFrame, section: list, kind: str, order: list) -> DataFrame:
    """blocks with ordinal: from 0 within section and type."""
    return blocks.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*section, kind).orderBy(*order)) - 1).cast("long"))


def paths(sections: DataFrame, doc: str, order: list, deepest: int = 6) -> DataFrame:
    """Headings (id, level) with path_ids, the ancestors from the top, and parent.

    For each level the last heading of that level counts unless a shallower one came after it.
    """
    so_far = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    rows = sections.withColumn("_at", place)
    for k in range(1, deepest + 1):
        rows = rows.withColumn(f"_l{k}", F.last(F.when(F.col("level") == k, F.struct(F.col("_at").alias("at"), F.col("id").alias("id"))), ignorenulls=True).over(so_far))
        rows = rows.withColumn(f"_s{k}", F.max(F.when(F.col("level") < k, F.col("_at"))).over(so_far))
    live = [F.when((F.col("level") > k) & (F.col(f"_l{k}.at") > F.coalesce(f"_s{k}", F.lit(0))), F.col(f"_l{k}.id")) for k in range(1, deepest + 1)]
    rows = rows.withColumn("path_ids", F.array_compact(F.array(*live)))
    dropped = [c for k in range(1, deepest + 1) for c in (f"_l{k}", f"_s{k}")]
    return rows.withColumn("parent", F.when(F.size("path_ids") > 0, F.element_at("path_ids", -1))).drop("_at", *dropped)


def list_numbers(items: DataFrame, group: list, order: list, deepest: int = 9, start: Column | None = None, restart: Column | None = None) -> DataFrame:
    """items (ilvl) with counters: a level counts on until an item of a level that restarts it, then begins anew.

    start and restart: arrays with an entry for each level, from 0: its first number (1 without them), and how many of the
    levels above restart it (all of them; 0: none). A level that no item has had yet stands before its first number.
    """
    rows = items
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = lambda k: F.coalesce(F.get(start, F.lit(k)), F.lit(1)) if start is not None else F.lit(1)
    above = lambda k: F.coalesce(F.get(restart, F.lit(k)), F.lit(k)) if restart is not None else F.lit(k)
    for k in range(deepest):
        rows = rows.withColumn(f"_g{k}", F.count(F.when(F.col("ilvl") < above(k), 1)).over(so_far))
        within = Window.partitionBy(*group, f"_g{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"_n{k}", F.count(F.when(F.col("ilvl") == k, 1)).over(within) + first(k) - 1)
    counters = F.slice(F.array(*[F.col(f"_n{k}") for k in range(deepest)]), F.lit(1), F.col("ilvl") + 1)
    return rows.withColumn("counters", counters).drop(*[f"_{p}{k}" for k in range(deepest) for p in "gn"])


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999; others as decimals."""
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    place = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.floor(n / by) % 10).cast("int"))
    parts = [place(["", "M", "MM", "MMM", "", "", "", "", "", ""], 1000), place(digits("C", "D", "M"), 100), place(digits("X", "L", "C"), 10), place(digits("I", "V", "X"), 1)]
    return F.when((n >= 1) & (n < 4000), F.concat(*parts)).otherwise(n.cast("string"))


def formatted(n: Column, form: Column) -> Column:
    """A counter in a level's number format; letters repeat after z, bullets have no number."""
    letter = F.when(n < 1, n.cast("string")).otherwise(F.repeat(F.chr((n - 1) % 26 + 97), F.ceil(n / 26).cast("int")))
    return (
        F.when(form == "lowerLetter", letter)
        .when(form == "upperLetter", F.upper(letter))
        .when(form == "lowerRoman", F.lower(roman(n)))
        .when(form == "upperRoman", roman(n))
        .when(form == "decimalZero", F.lpad(n.cast("string"), 2, "0"))
        .when(form.isin("bullet", "none"), "")
        .otherwise(n.cast("string"))
    )


def rendered_number(text: Column, counters: Column, forms: Column) -> Column:
    """lvlText with %1 to %9 replaced by the counters of levels 0 to 8, each in its level's format."""
    for k in range(9):
        value = F.coalesce(formatted(F.get(counters, F.lit(k)), F.coalesce(F.get(forms, F.lit(k)), F.lit("decimal"))), F.lit(""))
        text = F.replace(text, F.lit(f"%{k + 1}"), value)
    return text


def numbered(items: DataFrame, definitions: DataFrame, doc: str, order: list) -> DataFrame:
    """items (doc, num_id, ilvl) with number: rendered by definitions (doc, num_id, ilvl, num_fmt, lvl_text, start, lvl_restart, start_override).

    Items without a definition, or of the format none, get an empty number and count for nothing.
    """
    level = F.struct("ilvl", "num_fmt", "lvl_text", F.coalesce("start_override", "start").alias("start"), F.coalesce("lvl_restart", "ilvl").alias("restart"))
    # A list definition has at most nine levels.
    lists = definitions.groupBy(doc, "num_id").agg(F.array_sort(F.collect_list(level)).alias("_levels"))
    at = lambda name: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.get(F.filter(F.col("_levels"), lambda x: x["ilvl"] == k), F.lit(0))[name])
    rows = items.join(lists, [doc, "num_id"], "left").withColumns({"_fmt": at("num_fmt"), "_text": at("lvl_text"), "_start": at("start"), "_restart": at("restart")})
    own = F.get(F.col("_fmt"), F.col("ilvl"))
    counts = rows.where(own.isNotNull() & (own != "none"))
    rest = rows.where(own.isNull() | (own == "none")).withColumn("number", F.lit(""))
    counts = list_numbers(counts, [doc, "num_id"], order, 9, F.col("_start"), F.col("_restart"))
    counts = counts.withColumn("number", rendered_number(F.get("_text", F.col("ilvl")), F.col("counters"), F.col("_fmt")))
    return counts.select(*items.columns, "number").unionByName(rest.select(*items.columns, "number"))


def unresolved_rate(items: DataFrame, doc: str, most: float = 0.10) -> DataFrame:
    """(doc, headings, unresolved, advised) of headings without a number; over `most` another way of reading is advised."""
    rows = items.where("kind = 'heading'").groupBy(doc).agg(F.count("*").alias("headings"), F.count_if(F.coalesce("number", F.lit("")) == "").alias("unresolved"))
    return rows.withColumn("advised", F.col("unresolved") > most * F.col("headings"))


def style_numbering(styles: DataFrame, doc: str) -> DataFrame:
    """(doc, style_id, num_id, ilvl, circular) of styles (doc, style_id, based_on, num_id, ilvl): the numbering of the nearest style up the
    chain that has one, however long the chain; circular styles have none, as their chain never ends."""
    own = styles.withColumn("_own", F.when(F.col("num_id").isNotNull(), F.struct("num_id", "ilvl")))
    found = graph.nearest_up(own, doc, "style_id", "based_on", "_own")
    return found.select(doc, "style_id", "_own.num_id", "_own.ilvl", "circular")


def effective_numbering(items: DataFrame, styles: DataFrame, doc: str) -> DataFrame:
    """items (doc, style_id, num_id, ilvl) whose missing num_id and ilvl are those of their style, or of what it is based on."""
    found = style_numbering(styles, doc).select(doc, "style_id", F.col("num_id").alias("_num"), F.col("ilvl").alias("_lvl"))
    rows = items.join(found, [doc, "style_id"], "left")
    direct = F.col("num_id").isNotNull()
    return rows.withColumns({"ilvl": F.when(direct, F.col("ilvl")).otherwise(F.when(F.col("_num").isNotNull(), F.coalesce("_lvl", F.lit(0)))), "num_id": F.coalesce("num_id", "_num")}).drop("_num", "_lvl")


def simple_table(cells: Column) -> Column:
    """Whether a table can be a pipe table: no merged cells, one paragraph in each, nothing nested, equal rows."""
    plain = F.forall(cells, lambda c: (c["grid_span"] == 1) & c["v_merge"].isNull() & (c["n_paras"] == 1) & ~c["nested"] & ~F.contains(c["text"], F.lit("\n")))
    widths = F.transform(F.array_distinct(F.transform(cells, lambda c: c["row"])), lambda r: F.size(F.filter(cells, lambda c: c["row"] == r)))
    return plain & (F.size(F.array_distinct(widths)) == 1)


def representation(kind: Column, cells: Column, readable: Column) -> Column:
    """The form in which an item is kept: nothing is dropped, what has no form of its own is raw."""
    table = F.when(~readable, "raw").when(simple_table(cells), "table pipe").otherwise("table html")
    forms = {"heading": "heading", "paragraph": "paragraph", "list": "list", "figure": "figure", "formula": "formula", "footnote": "paragraph", "code": "code"}
    out = F.when(kind == "table", table)
    for name, form in forms.items():
        out = out.when(kind == name, F.when(readable, form).otherwise("raw"))
    return out.otherwise("raw")


def not_captured(items: DataFrame, blocks: DataFrame, key: list) -> DataFrame:
    """Items that no block stands for; of a complete vault there are none."""
    return items.join(blocks.select(*key).distinct(), key, "left_anti")


def paired_by_order(objects: DataFrame, images: DataFrame, doc: str, order: list, image: str) -> DataFrame:
    """objects with the image at the same place in their document's order, null where the numbers of both differ."""
    place = lambda t: t.withColumns({"_n": F.row_number().over(Window.partitionBy(doc).orderBy(*order)), "_all": F.count("*").over(Window.partitionBy(doc))})
    return place(objects).join(place(images).select(doc, "_n", "_all", image), [doc, "_n", "_all"], "left").drop("_n", "_all")


def textual_references(items: DataFrame) -> DataFrame:
    """(columns of items but text, reference): mentions of sections in prose, which are recorded and never resolved."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)\b((?:section|clause|chapter)\s+\d+(?:\.\d+)*)"), F.lit(1))
    return items.withColumn("reference", F.explode(found)).drop("text")


#: Codes of issues with their severities; skips have none.
ISSUES = {
    "unresolved_ref": "warn",
    "textual_ref_candidate": "info",
    "numbering_unresolved": "warn",
    "table_parse_failed": "error",
    "formula_conversion_failed": "warn",
    "shape_unrenderable": "warn",
    "style_dropped": "info",
    "unknown_container": "info",
    "source_has_unresolved_revisions": "warn",
    "index_too_large": "warn",
}


def issues(rows: DataFrame) -> DataFrame:
    """(doc, severity, code, paragraph, detail) of rows (doc, code, paragraph, detail); codes that aren't registered are left out.

    Their order is that of doc, paragraph, code and detail.
    """
    severity = F.create_map(*[F.lit(x) for pair in ISSUES.items() for x in pair])[F.col("code")]
    return rows.withColumn("severity", severity).where("severity is not null").select("doc", "severity", "code", "paragraph", "detail")
