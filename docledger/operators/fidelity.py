"""How much of a source's text a vault holds: directional containment, counters, skips and gates."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from docledger.functions.text import normalize
from docledger.operators.references import contained
from docledger.sources import scratch

#: The least rates of the gates.
LEAST = {"links": 0.95, "tables": 0.90, "fidelity": 0.99}
#: What may be skipped on purpose.
SKIPS = ("toc", "header_footer")


def segments(items: DataFrame) -> DataFrame:
    """(doc, file, paragraph, segment) of source paragraphs (doc, file, paragraph, text) that have text."""
    rows = items.withColumn("segment", normalize("text"))
    return rows.where("segment <> ''").select("doc", "file", "paragraph", "segment")


def haystacks(texts: DataFrame) -> DataFrame:
    """(doc, file, haystack): the normalized plain text of each section; texts: doc, file, block_index, plain."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "plain"))), lambda x: x["plain"]), " ")
    return texts.groupBy("doc", "file").agg(joined.alias("text")).select("doc", "file", normalize("text").alias("haystack"))


#: Pairs of a document's sections and of its segments that its sections lack, up to which they are met one by one.
PAIRS = 1 << 20


def coverage(source: DataFrame, emitted: DataFrame) -> DataFrame:
    """source with covered and place: own if the segment stands in its own section, elsewhere if in another of its document.

    The first test is an equality join on the section. Only what it leaves is looked for in the document's sections: in a document of
    up to PAIRS of both by a join on the document, in larger ones over their vocabulary, so that no text meets all texts.
    """
    emitted = scratch.written(emitted.select("doc", "file", "haystack"))
    own = source.join(emitted, ["doc", "file"], "left").withColumn("_own", F.coalesce(F.contains("haystack", "segment"), F.lit(False))).drop("haystack")
    own = scratch.written(own)
    left = own.where("not _own").select("doc", "segment").distinct()
    n = left.groupBy("doc").agg(F.count("*").alias("_n")).join(emitted.groupBy("doc").agg(F.count("*").alias("_m")), "doc")
    large = scratch.written(n.where(F.col("_n") * F.col("_m") > PAIRS).select("doc"))
    lacks = left
    if not large.isEmpty():
        lacks = left.join(scratch.sized_by(large, "doc", 32), "doc", "left_anti")
    found = lacks.join(emitted, "doc").where(F.contains("haystack", "segment")).select("doc", "segment").distinct()
    if not large.isEmpty():
        of_large = lambda t: t.join(scratch.sized_by(large, "doc", 32), "doc", "left_semi")
        passages = of_large(left).select("doc", F.struct("doc", "segment").alias("of"), F.col("segment").alias("text"))
        met = contained(passages, "of", of_large(emitted).select("doc", F.struct("doc", "file").alias("at"), F.col("haystack").alias("text")), "at", "doc")
        found = found.unionByName(met.select("of.doc", "of.segment").distinct())
    found = scratch.written(found.withColumn("_elsewhere", F.lit(True)))
    scratch.drop(emitted, large)
    rows = own.join(found, ["doc", "segment"], "left").withColumn("place", F.when(F.col("_own"), "own").when(F.col("_elsewhere"), "elsewhere"))
    return rows.withColumn("covered", F.col("place").isNotNull()).drop("_own", "_elsewhere")


#: What the writer adds on purpose, as the report names it.
ADDED = ("heading_numbers", "list_numbers", "captions")


def pieces(blocks: DataFrame) -> DataFrame:
    """(doc, file, block_index, piece, kind, ink) of blocks (doc, file, block_index, type, plain): the parts of their plain texts.

    A heading's number, a list item's marker and a figure's caption are parts of their own, of the kinds in ADDED; the rest is text.
    ink is the normalized part without white space.
    """
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    number = F.regexp_extract("plain", r"^(\d+(?:\.\d+)*)(?:\s|$)", 1)
    marker = lambda line: F.regexp_extract(line, r"^\s*([-*+]|[0-9A-Za-z]{1,8}[.)])\s", 1)
    rest = lambda text, start: F.substring(text, F.length(start) + 1, F.length(text))
    items = F.flatten(F.transform(F.split("plain", "\n"), lambda line: F.array(part("list_numbers", marker(line)), part("text", rest(F.ltrim(line), marker(line))))))
    parts = F.when(F.col("type") == "heading", F.array(part("heading_numbers", number), part("text", rest(F.col("plain"), number)))).when(F.col("type") == "list", items).when(F.col("type") == "figure", F.array(part("captions", F.col("plain")))).otherwise(F.array(part("text", F.col("plain"))))
    rows = blocks.select("doc", "file", "block_index", F.posexplode(parts).alias("piece", "x")).select("doc", "file", "block_index", "piece", "x.kind", F.replace(normalize("x.text"), F.lit(" "), F.lit("")).alias("ink"))
    return rows.where("ink <> ''")


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])))
def _aligned(texts: pd.Series, segments: pd.Series) -> pd.Series:
    """Where a section's segments stand in its text: each behind the one before it, or else wherever it is first."""

    def one(text: str, parts) -> list[tuple]:
        at, out = 0, []
        for part in parts if text is not None and parts is not None else ():
            start = text.find(part, at)
            if start < 0:
                start = text.find(part)
            else:
                at = start + len(part)
            if start >= 0:
                out.append({"start": start, "stop": start + len(part)})
        return out

    return pd.Series([one(t, p) for t, p in zip(texts, segments, strict=True)], dtype=object)


def additions(source: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, heading_numbers, list_numbers, captions, other, added_chars): characters of the vault that no source segment accounts for.

    source: segments(); parts: pieces(). It is the other direction of coverage() and never set off against it. The segments of a section
    are laid along its text in order; what their spans leave open is added. The spans' ends and the pieces' starts are
    events on one line for each section, and a running count tells which stretches are open: no spans meet all pieces.
    """
    order = Window.partitionBy("doc", "file").orderBy("block_index", "piece")
    placed = parts.withColumn("at", F.sum(F.length("ink")).over(order) - F.length("ink"))
    whole = parts.groupBy("doc", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "piece", "ink"))), lambda x: x["ink"]), "").alias("text"))
    ink = source.select("doc", "file", "paragraph", F.replace("segment", F.lit(" "), F.lit("")).alias("ink"))
    laid = ink.groupBy("doc", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "ink"))), lambda x: x["ink"]).alias("segments"))
    spans = whole.join(laid, ["doc", "file"]).select("doc", "file", F.explode(_aligned("text", "segments")).alias("s"))
    event = lambda rows, at, step, kind: rows.select("doc", "file", at.cast("long").alias("at"), F.lit(step).alias("step"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    ends = whole.select("doc", "file", F.length("text").alias("at"))
    events = event(spans, F.col("s.start"), 1, none).unionByName(event(spans, F.col("s.stop"), -1, none)).unionByName(event(placed, F.col("at"), 0, F.col("kind"))).unionByName(event(ends, F.col("at"), 0, none))
    along = Window.partitionBy("doc", "file").orderBy("at", F.desc_nulls_last("kind"))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"n": F.lead("at").over(along) - F.col("at"), "over": F.sum("step").over(so_far), "of": F.last("kind", ignorenulls=True).over(so_far)})
    open_of = lambda *kinds: F.coalesce(F.sum(F.when((F.col("over") == 0) & F.col("of").isin(*kinds), F.col("n"))), F.lit(0)).cast("long")
    out = rows.groupBy("doc").agg(*[open_of(k).alias(k) for k in ADDED], open_of("text").alias("other"))
    return out.withColumn("added_chars", sum((F.col(k) for k in ADDED), F.col("other")))


def uncovered(rows: DataFrame) -> DataFrame:
    """(doc, paragraph, chars, reason) of every segment that isn't covered."""
    return rows.where("not covered").select("doc", "paragraph", F.length("segment").alias("chars"), F.lit("not_found").alias("reason"))


def text_counts(rows: DataFrame) -> DataFrame:
    """doc, source_segments, segments_covered, those of them that stand elsewhere, and coverage of coverage()."""
    out = rows.groupBy("doc").agg(F.count("*").alias("source_segments"), F.count_if("covered").alias("segments_covered"), F.count_if(F.col("place").eqNullSafe("elsewhere")).alias("covered_elsewhere"))
    return out.withColumn("coverage", F.col("segments_covered") / F.col("source_segments"))


def block_counts(blocks: DataFrame) -> DataFrame:
    """Counters of blocks (doc, file, id, type, attrs) for each document, in one pass."""
    kind = lambda k: F.col("type") == k
    form = F.col("attrs")["format"]
    n = {
        "blocks": F.col("id").isNotNull(),
        "paragraphs": kind("paragraph"),
        "lists": kind("list"),
        "tables": kind("table") | (kind("raw") & (F.col("attrs")["reason"] == "table_parse_failed")),
        "tables_pipe": kind("table") & (form == "pipe"),
        "tables_html": kind("table") & (form == "html"),
        "tables_degraded": kind("raw") & (F.col("attrs")["reason"] == "table_parse_failed"),
        "figures": kind("figure"),
        "formulas": kind("formula"),
        "formulas_latex": kind("formula") & (form == "latex"),
        "formulas_image": kind("formula") & (form == "image"),
    }
    return blocks.groupBy("doc").agg(F.countDistinct("file").alias("sections"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in n.items()])


def link_counts(links: DataFrame) -> DataFrame:
    """Counters of links (doc, kind, in_toc, resolved, to_block) for each document; those of contents lists count nowhere."""
    internal = F.col("kind") == "internal"
    rows = links.where("not in_toc").groupBy("doc").agg(
        F.count_if(internal).alias("found"),
        F.count_if(internal & F.col("resolved") & ~F.col("to_block")).alias("resolved_section"),
        F.count_if(internal & F.col("resolved") & F.col("to_block")).alias("resolved_block"),
        F.count_if(internal & ~F.col("resolved")).alias("unresolved"),
        F.count_if(F.col("kind") == "external").alias("external"),
    )
    return rows


def skip_counts(items: DataFrame) -> DataFrame:
    """(doc, code, paragraphs, chars) of items (doc, skip, text) that were skipped on purpose."""
    return items.where(F.col("skip").isin(*SKIPS)).groupBy("doc", F.col("skip").alias("code")).agg(F.count("*").alias("paragraphs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def gates(texts: DataFrame, counts: DataFrame, links: DataFrame, least: dict | None = None) -> DataFrame:
    """(doc, links, tables, fidelity, published): whether each rate reaches its gate; nothing to count passes."""
    least = LEAST | (least or {})
    rows = texts.select("doc", "coverage").join(counts, "doc", "full_outer").join(links, "doc", "full_outer")
    rate = lambda part, whole: F.when(F.coalesce(whole, F.lit(0)) == 0, 1.0).otherwise(part / whole)
    passed = {
        "links": rate(F.col("resolved_section") + F.col("resolved_block"), F.col("found")) >= least["links"],
        "tables": rate(F.col("tables_pipe") + F.col("tables_html"), F.col("tables")) >= least["tables"],
        "fidelity": F.coalesce("coverage", F.lit(1.0)) >= least["fidelity"],
    }
    rows = rows.select("doc", *[test.alias(name) for name, test in passed.items()])
    return rows.withColumn("published", F.col("links") & F.col("tables") & F.col("fidelity"))


def coverage_documents(texts: DataFrame, counts: DataFrame, links: DataFrame, gated: DataFrame) -> DataFrame:
    """(doc, json, markdown): each document's coverage report in both forms, from one row of numbers."""
    rows = texts.join(counts, "doc", "full_outer").join(links.withColumnsRenamed({c: f"links_{c}" for c in links.columns if c != "doc"}), "doc", "full_outer").join(gated.withColumnsRenamed({c: f"gate_{c}" for c in gated.columns if c != "doc"}), "doc", "left")
    names = [c for c in rows.columns if c != "doc"]
    table = F.array_join(F.array(*[F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(" |")) for c in names]), "\n")
    front = F.concat(F.lit("---\ngenerated: true\ndoc: "), "doc", F.lit("\nkind: coverage\n---\n\n| what | value |\n| --- | --- |\n"))
    return rows.select("doc", F.to_json(F.struct("doc", *names)).alias("json"), F.concat(front, table, F.lit("\n")).alias("markdown"))
