"""Queries over second readings of documents, each with the DuckDB SQL that must give the same rows.

What is read again is the derivation of vault_queries with edits: renamed headings, new and lost sections, new, lost, changed and
doubled paragraphs.
"""

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.operators import reingest as RI
from docledger.plans import ingest as I
from docledger.plans.vault_queries import _SOURCE, _base_blocks, _kept

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _readings(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items (doc, at, kind, level, text) of the first and of the second reading. A section's lines are edited by its e."""
    rows = _base_blocks(spark, sf_dir).withColumn("e", (F.col("doc_id") + F.col("s")) % 8)
    title = F.concat_ws(" ", "w1", "w2")
    item = lambda t, at, kind, text: t.select(F.col("doc_id").alias("doc"), at.alias("at"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.when((F.col("t") == 0) if not isinstance(kind, str) else F.lit(kind == "heading"), F.col("level")).alias("level"), text.alias("text"))
    at = F.col("k") * 10
    first = item(rows, at, F.col("type"), F.when(F.col("t") == 0, title).otherwise(F.col("c")))
    left = rows.where("not (e = 3 and t = 1) and not (e = 5 and s % 3 <> 0)")
    text = F.when((F.col("t") == 0) & (F.col("e") == 0), F.concat(F.lit("renamed "), "s")).when(F.col("t") == 0, title).when((F.col("t") == 5) & (F.col("e") == 2), F.concat("c", F.lit(" ed"))).otherwise(F.col("c"))
    second = item(left, at, F.col("type"), text)
    before = rows.where("e = 1 and t = 0")
    second = second.unionByName(item(before, at - 2, "heading", F.lit("inserted section"))).unionByName(item(before, at - 1, "paragraph", F.lit("inserted text")))
    return first, second.unionByName(item(rows.where("e = 4 and t = 1"), at + 5, "paragraph", F.concat("c", F.lit(" twin"))))


def _named(rows: DataFrame) -> DataFrame:
    """A first reading with the IDs that its rows stand for."""
    number = lambda c: F.concat(F.col("doc").cast("string"), F.lit("-"), F.lpad(F.col(c).cast("string"), 6, "0"))
    return rows.select("doc", number("row").alias("id"), number("section").alias("section"), F.when(F.col("parent").isNotNull(), number("parent")).alias("parent"), "depth", "type", "ordinal", "hash", "norm")


def _tiers(old: str, new: str, name: str, by_place: bool) -> str:
    """CTEs that match rows (doc_id, path, type, ordinal, norm, place) of two tables; what only grew by ' ed' is similar enough if it is long enough."""
    key = "doc_id, path, type"
    rank = "row_number() OVER (PARTITION BY doc_id, path, type, norm ORDER BY ordinal) AS r"
    rest = lambda side, *done: f"SELECT * FROM {side} x WHERE NOT EXISTS (SELECT 1 FROM (" + " UNION ALL ".join(f"FROM {name}{d}" for d in done) + f") m WHERE m.doc_id = x.doc_id AND m.{'old_at' if side == old else 'new_at'} = x.place)"
    similar = "TRUE" if by_place else "(o.norm = n.norm OR (n.norm = o.norm || ' ed' AND 2.0 * length(o.norm) / (2 * length(o.norm) + 3) >= 0.85))"
    return f"""{name}1 AS (SELECT o.doc_id, o.place AS old_at, n.place AS new_at, 1 AS tier FROM {old} o JOIN {new} n USING ({key}, ordinal, norm)),
    {name}2 AS (SELECT o.doc_id, o.place AS old_at, n.place AS new_at, 2 AS tier FROM (SELECT *, {rank} FROM ({rest(old, 1)})) o JOIN (SELECT *, {rank} FROM ({rest(new, 1)})) n USING ({key}, norm, r)),
    {name}3 AS (SELECT o.doc_id, o.place AS old_at, n.place AS new_at, 3 AS tier FROM ({rest(old, 1, 2)}) o JOIN ({rest(new, 1, 2)}) n USING ({key}, ordinal) WHERE {similar}),
    {name} AS (FROM {name}1 UNION ALL FROM {name}2 UNION ALL FROM {name}3)"""


_READ = f"""WITH {_SOURCE},
edited AS (SELECT *, (doc_id + s) % 8 AS ed FROM typed),
first AS (SELECT doc_id, k * 10 AS place, type, CASE WHEN t = 0 THEN level END AS level, CASE WHEN t = 0 THEN w1 || ' ' || w2 ELSE c END AS text FROM edited),
second AS (
  SELECT doc_id, k * 10 AS place, type, CASE WHEN t = 0 THEN level END AS level, CASE WHEN t = 0 AND ed = 0 THEN 'renamed ' || s WHEN t = 0 THEN w1 || ' ' || w2 WHEN t = 5 AND ed = 2 THEN c || ' ed' ELSE c END AS text FROM edited WHERE NOT (ed = 3 AND t = 1) AND NOT (ed = 5 AND s % 3 <> 0)
  UNION ALL SELECT doc_id, k * 10 - 2, 'heading', level, 'inserted section' FROM edited WHERE ed = 1 AND t = 0
  UNION ALL SELECT doc_id, k * 10 - 1, 'paragraph', NULL, 'inserted text' FROM edited WHERE ed = 1 AND t = 0
  UNION ALL SELECT doc_id, k * 10 + 5, 'paragraph', NULL, c || ' twin' FROM edited WHERE ed = 4 AND t = 1)""" + "".join(
    f""",
{x}_in AS (SELECT *, lower(text) AS norm, max(CASE WHEN level IS NOT NULL THEN place END) OVER w AS section, max(CASE WHEN level = 1 THEN place END) OVER w AS top FROM {x} WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
{x}_tops AS (SELECT doc_id, place, '' AS path, type, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ordinal, norm FROM {x}_in WHERE level = 1),
{x}_subs AS (SELECT doc_id, place, top, type, row_number() OVER (PARTITION BY doc_id, top ORDER BY place) - 1 AS ordinal, norm FROM {x}_in WHERE level = 2),
{x}_rest AS (SELECT doc_id, place, section, type, row_number() OVER (PARTITION BY doc_id, section, type ORDER BY place) - 1 AS ordinal, norm FROM {x}_in WHERE level IS NULL)"""
    for x in ("first", "second")
) + f""",
{_tiers('first_tops', 'second_tops', 'mt', True)},
old_subs AS (SELECT doc_id, place, top::VARCHAR AS path, type, ordinal, norm FROM first_subs),
new_subs AS (SELECT s.doc_id, s.place, m.old_at::VARCHAR AS path, s.type, s.ordinal, s.norm FROM second_subs s JOIN mt m ON m.doc_id = s.doc_id AND m.new_at = s.top),
{_tiers('old_subs', 'new_subs', 'ms', True)},
heads AS (FROM mt UNION ALL FROM ms),
old_rest AS (SELECT doc_id, place, section::VARCHAR AS path, type, ordinal, norm FROM first_rest),
new_rest AS (SELECT r.doc_id, r.place, m.old_at::VARCHAR AS path, r.type, r.ordinal, r.norm FROM second_rest r JOIN heads m ON m.doc_id = r.doc_id AND m.new_at = r.section),
{_tiers('old_rest', 'new_rest', 'mr', False)},
met AS (FROM heads UNION ALL FROM mr),
given AS (
  SELECT s.doc_id, s.place, s.section, m.tier, CASE WHEN m.tier IS NULL THEN s.doc_id || '-' || lpad(CAST(899999 + row_number() OVER (PARTITION BY s.doc_id, m.tier IS NULL ORDER BY s.place) AS VARCHAR), 6, '0') ELSE s.doc_id || '-' || lpad(CAST(m.old_at AS VARCHAR), 6, '0') END AS id
  FROM second_in s LEFT JOIN met m ON m.doc_id = s.doc_id AND m.new_at = s.place)"""


def _assigned(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    first, second = _readings(spark, sf_dir)
    old = RI.scratch.written(_named(RI.structured(first)))
    new = RI.scratch.written(RI.structured(second))
    return old, RI.assigned(old, new, old.groupBy("doc").agg(F.lit(900_000).alias("next")))


@_query(f"{_READ} SELECT g.doc_id AS doc, g.place AS row, g.id, h.id AS section_id, coalesce(g.tier, 0) AS tier FROM given g JOIN given h ON h.doc_id = g.doc_id AND h.place = g.section")
def reingest_levels(spark, sf_dir):
    """Every row of the second reading with its ID, that of its section, and the tier by which it was matched."""
    return _assigned(spark, sf_dir)[1].select("doc", "row", "id", "section_id", "tier")


@_query(f"{_READ} SELECT g.doc_id AS doc, count(g.tier) AS matched, count(*) - count(g.tier) AS new, (SELECT count(*) FROM first f WHERE f.doc_id = g.doc_id) - count(g.tier) AS deleted, CAST(0 AS BIGINT) AS moved FROM given g GROUP BY g.doc_id")
def reingest_summary(spark, sf_dir):
    return RI.summary(*_assigned(spark, sf_dir))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NAMES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_LEVELS = {"numbering": f'{_HEAD}<w:numbering {_NAMES}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num></w:numbering>',
    "styles": f'{_HEAD}<w:styles {_NAMES}><w:style w:styleId="Numbered"><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="Heading1"><w:basedOn w:val="Numbered"/></w:style><w:style w:styleId="Heading2"><w:basedOn w:val="Heading1"/><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>',
    "_rels/document.xml": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="image" Target="media/one.png"/></Relationships>'}


def _package(doc: int, lines: list[str]) -> bytes:
    """A Word package of a document's lines: six at a time are a heading, a paragraph with a link, a table, two list items and a paragraph."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    para = lambda inner, style="": f"<w:p>{f'<w:pPr>{style}</w:pPr>' if style else ''}{inner}</w:p>"
    out = [para(run(f"Revision of {doc}"))] if doc % 3 == 0 else []
    for k, c in enumerate(lines):
        s, t, (w1, _, w2) = k // 6, k % 6, c.partition(" ")
        w2 = w2.split(" ")[0] or c
        if t == 0:
            out.append(para(f'<w:bookmarkStart w:name="S{s}"/>' + run(c), f'<w:pStyle w:val="Heading{1 if s % 3 == 0 else 2}"/>'))
        elif t == 1:
            out.append(para(run(f"{c} ") + f'<w:hyperlink w:anchor="S{s + 1}">{run(w1)}</w:hyperlink>' + run(" end")))
        elif t == 2:
            rows = [[w1, w2], [w2, str(doc % 50 + k), *(["extra"] if s % 5 == 4 else [])]]
            cell = lambda x: f'<w:tc><w:tcPr><w:gridSpan w:val="{"?" if s % 7 == 3 else 1}"/></w:tcPr>{para(run(x))}</w:tc>'  # noqa: B023, E731
            out.append("<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>")
        elif t in (3, 4):
            out.append(para(run(c), '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr>'))
        else:
            extra = {1: '<w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:r>', 2: "<w:r><w:pict/></w:r>"}.get(s % 4, "")
            out.append(para(run(c) + extra))
    body = f"{_HEAD}<w:document {_NAMES}><w:body>{''.join(out)}</w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"word/document.xml": body, "word/numbering.xml": _LEVELS["numbering"], "word/styles.xml": _LEVELS["styles"], "word/_rels/document.xml.rels": _LEVELS["_rels/document.xml"], "word/media/one.png": f"image of {doc}"}.items():
            z.writestr(name, text)
    return raw.getvalue()


def _packages(spark, sf_dir: str) -> DataFrame:
    """(path, content): a Word package for each document, written by Spark."""
    lines = _base_blocks(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("lines"))

    def run(batches):
        for batch in batches:
            for doc, found in zip(batch["doc_id"].to_pylist(), batch["lines"].to_pylist(), strict=True):
                yield pa.record_batch({"path": pa.array([f"D{doc}.docx"]), "content": pa.array([_package(doc, found)], pa.binary())})

    return lines.mapInArrow(run, "path string, content binary")


def _ingested(spark, sf_dir: str) -> I.Vault:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VAULTS:
        packages = _kept(spark, sf_dir, "packages", lambda: _packages(spark, sf_dir))
        _VAULTS[key] = I.ingest(packages, F.regexp_extract("file", r"([^/]+)\.docx$", 1))
    return _VAULTS[key]


_VAULTS: dict = {}
_INGEST = f"""WITH {_SOURCE},
blocks AS (
  SELECT doc_id, -2 AS ord, CAST(NULL AS BIGINT) AS k, -1 AS s, 'front' AS what FROM base WHERE k = 0 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, -1, NULL, -1, 'revision' FROM base WHERE k = 0 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id, k * 2, k, s, CASE t WHEN 0 THEN 'heading' WHEN 1 THEN 'linked' WHEN 2 THEN 'table' WHEN 3 THEN 'list' ELSE 'plain' END FROM base WHERE t <> 4
  UNION ALL SELECT doc_id, k * 2 + 1, k, s, CASE s % 4 WHEN 1 THEN 'figure' ELSE 'shape' END FROM base WHERE t = 5 AND s % 4 IN (1, 2)),
named_blocks AS (SELECT *, 'D' || doc_id || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS VARCHAR), 6, '0') AS own FROM blocks),
heads AS (SELECT doc_id, s, own AS section_id FROM named_blocks WHERE what IN ('front', 'heading')),
filled AS (
  SELECT n.doc_id, n.ord, n.own AS id, h.section_id, n.what, n.s, n.k, b.level, b.c, b.w1, x.section_id AS next_id,
    CASE what WHEN 'front' THEN 'heading' WHEN 'revision' THEN 'paragraph' WHEN 'linked' THEN 'paragraph' WHEN 'plain' THEN 'paragraph' WHEN 'table' THEN (CASE WHEN n.s % 7 = 3 THEN 'raw' ELSE 'table' END) WHEN 'shape' THEN 'raw' ELSE what END AS type,
    CASE what WHEN 'front' THEN '# Front matter' WHEN 'revision' THEN 'Revision of ' || n.doc_id WHEN 'heading' THEN repeat('#', b.level) || ' ' || b.number || ' ' || b.c
      WHEN 'linked' THEN b.c || ' ' || CASE WHEN x.section_id IS NULL THEN b.w1 ELSE '[[' || x.section_id || '|' || b.w1 || ']]' END || ' end'
      WHEN 'table' THEN CASE WHEN n.s % 7 = 3 THEN b.w1 || chr(10) || b.w2 || chr(10) || b.w2 || chr(10) || b.cell || CASE WHEN n.s % 5 = 4 THEN chr(10) || 'extra' ELSE '' END
        WHEN n.s % 5 = 4 THEN '<table><tr><td>' || b.w1 || '</td><td>' || b.w2 || '</td></tr><tr><td>' || b.w2 || '</td><td>' || b.cell || '</td><td>extra</td></tr></table>'
        ELSE '| ' || b.w1 || ' | ' || b.w2 || ' |' || chr(10) || '|---|---|' || chr(10) || '| ' || b.w2 || ' | ' || b.cell || ' |' END
      WHEN 'list' THEN (n.s * 2 + 1) || '. ' || b.c || coalesce(chr(10) || (n.s * 2 + 2) || '. ' || m.c, '')
      WHEN 'plain' THEN b.c WHEN 'figure' THEN '![Figure](../assets/' || n.own || '.png)' ELSE '' END AS content
  FROM named_blocks n JOIN heads h ON h.doc_id = n.doc_id AND h.s = n.s LEFT JOIN base b ON b.doc_id = n.doc_id AND b.k = n.k LEFT JOIN base m ON m.doc_id = n.doc_id AND m.k = n.k + 1 AND n.what = 'list'
  LEFT JOIN heads x ON x.doc_id = n.doc_id AND x.s = n.s + 1 AND n.what = 'linked')"""


@_query(f"{_INGEST} SELECT 'D' || doc_id AS doc, id, section_id, type, content, CASE WHEN type = 'raw' THEN id || '.xml' WHEN type = 'figure' THEN id || '.png' END AS asset FROM filled")
def ingest_blocks(spark, sf_dir):
    """Every block of the vaults that packages of all documents become."""
    return _ingested(spark, sf_dir).blocks.select("doc", "id", "section_id", "type", "content", "asset")


@_query(f"""{_INGEST} SELECT 'D' || doc_id AS doc, 'error' AS severity, 'table_parse_failed' AS code, CAST(k + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS paragraph, 'degraded to ' || id AS detail FROM filled WHERE what = 'table' AND type = 'raw'
UNION ALL SELECT 'D' || doc_id, 'warn', 'shape_unrenderable', CAST(k + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT), 'degraded to ' || id FROM filled WHERE what = 'shape'
UNION ALL SELECT 'D' || doc_id, 'warn', 'unresolved_ref', CAST(k + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT), 'S' || (s + 1) || ' not found' FROM filled WHERE what = 'linked' AND next_id IS NULL""")
def ingest_issues(spark, sf_dir):
    return _ingested(spark, sf_dir).issues


@_query(f"""{_INGEST} SELECT 'D' || doc_id AS doc, count(*) + coalesce(any_value(e.n), 0) AS constructs, count_if(type <> 'raw') + coalesce(any_value(e.n), 0) AS captured, count_if(type = 'raw') AS with_fallback,
  CAST(0 AS BIGINT) AS without_block, CAST(0 AS BIGINT) AS unstored, CAST(0 AS BIGINT) AS unreported, true AS balanced
FROM filled LEFT JOIN (SELECT doc_id, count(*) AS n FROM base WHERE t = 4 GROUP BY doc_id) e USING (doc_id) GROUP BY doc_id""")
def total_capture(spark, sf_dir):
    return I.accounts(_ingested(spark, sf_dir))
