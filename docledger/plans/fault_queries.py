"""A vault with a fault for every rule, derived from documents, and the findings that the rules must give, in DuckDB SQL.

Every document becomes one section file; the number of the document modulo 20 says what its working copy breaks. Texts keep letters
of all scripts, and have CJK characters and escapes.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.plans import rules
from docledger.plans.vault_queries import _kept
from docledger.sources import sections as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_ATTRS = "map<string,string>"


def _words(text):
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L} ]+", " "), " +", " "))
    return F.array_join(F.slice(F.split(F.when(letters == "", "leer").otherwise(letters), " "), 1, 3), " ")


def _blocks(docs: DataFrame, edited: bool) -> DataFrame:
    """file, block_index, type, content, marker, attrs of the blocks of base or of the working copy."""
    w, f = F.col("w"), F.when(F.lit(edited), F.col("doc_id") % 20).otherwise(0)
    at = lambda n: F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(f"-{n:06d}"))
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    if_ = lambda n, then, other: F.when(f == n, then if not isinstance(then, str) else F.lit(then)).otherwise(other if not isinstance(other, str) else F.lit(other))
    none = F.lit(None).cast("string")

    def block(n, kind, content, marker=none, here=None, own=None, **attrs):
        pairs = {"id": at(n) if own is None else own, "type": kind if not isinstance(kind, str) else F.lit(kind)} | attrs
        entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs.items()]))
        return F.when(F.lit(True) if here is None else here, F.struct(F.lit(n).cast("long").alias("block_index"), pairs["type"].alias("type"), content.alias("content"), marker.alias("marker"), F.map_from_entries(entries).cast(_ATTRS).alias("attrs")))

    taken = F.when(f == 6, at(3))
    bare = F.when(f == 13, F.struct(F.lit(8).cast("long").alias("block_index"), F.lit("paragraph").alias("type"), F.lit("ohne Anker").alias("content"), none.alias("marker"), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).cast(_ATTRS).alias("attrs")))
    every = [
        block(1, "heading", line(if_(14, "## 1 ", "# 1 "), w)),
        block(2, if_(2, "note", "paragraph"), line(w, " braucht ", if_(12, "80", "50"), r" ms. 東京 a \| b"), here=f != 4, supersedes=F.when(f == 5, at(99)).otherwise(taken)),
        block(3, "table", line("| a | b |\n| --- | --- |\n", if_(8, "| c |", "| c | d |")), here=f != 6, format=F.lit("pipe")),
        block(4, "figure", line(if_(7, "![Anderes](assets/", "![Bild](assets/"), at(4), ".png)\n*", w, "*"), asset=line(at(4), ".png"), locked=F.lit("true")),
        block(5, "paragraph", F.lit("Ziel"), marker=F.when(f != 15, F.lower(at(5)))),
        block(6, "paragraph", line("siehe [[", if_(9, at(9), line(at(1), "#^", F.lower(at(5)))), "|Ziel]]"), own=if_(3, at(5), at(6)), supersedes=taken),
        block(7, "paragraph", F.trim(F.repeat(F.lit("wort "), 1600)), here=f == 16),
        bare,
    ]
    return docs.select(at(1).alias("file"), F.explode(F.array_compact(F.array(*every))).alias("x")).select("file", "x.*")


def _files(spark, sf_dir: str, edited: bool) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _words(F.col("text")).alias("w"))
    f = F.when(F.lit(edited), F.col("doc_id") % 20).otherwise(0)
    at = lambda n: F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(f"-{n:06d}"))
    key = lambda name, value: F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)
    quoted = lambda *x: F.concat(F.lit('"'), *[F.lit(y) if isinstance(y, str) else y for y in x], F.lit('"'))
    doc = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    n = F.size(F.split("w", " "))
    front = F.concat_ws(
        "\n",
        key("id", F.when(f == 1, at(2)).otherwise(at(1))),
        key("doc", doc),
        key("number", '"1"'),
        key("title", F.when(f == 17, '"falsch"').otherwise(quoted(F.col("w")))),
        key("level", "1"),
        key("order", "0"),
        key("path", '["1"]'),
        key("path_ids", F.concat(F.lit("["), quoted(at(1)), F.lit("]"))),
        key("breadcrumb", quoted(doc, " > 1 ", F.col("w"))),
        key("bookmarks", "[]"),
        key("refs_out", F.concat(F.lit("["), quoted(at(1), "#^", F.lower(at(5))), F.lit("]"))),
        key("blocks", F.when(f == 11, "9").otherwise("6")),
        key("words", (3 * n + 15).cast("string")),
        key("source", "{docx: s.docx, paragraphs: [0, 9]}"),
        key("ingest_version", F.when(f == 19, "0").otherwise("1")),
        key("generated", "false"),
    )
    text = S.rendered(_blocks(docs, edited), docs.select(at(1).alias("file"), front.alias("front")))
    spaced = F.regexp_extract("file", r"^D(\d+)-", 1).cast("long") % 20 == 18
    return text.withColumn("text", F.when(F.lit(edited) & spaced, F.replace("text", F.lit("Ziel ^"), F.lit("Ziel  \n^"))).otherwise(F.col("text")))


_ALL = r"""WITH docs AS (SELECT doc_id, doc_id % 20 AS f, CASE WHEN trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L} ]+', ' ', 'g'), ' +', ' ', 'g')) = '' THEN 'leer' ELSE trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L} ]+', ' ', 'g'), ' +', ' ', 'g')) END AS letters FROM documents),
d AS (SELECT *, 'D' || doc_id || '-00000' AS x, len(w) AS n, array_to_string(w, ' ') AS title FROM (SELECT *, list_slice(string_split(letters, ' '), 1, 3) AS w FROM docs)),
rows AS (SELECT doc_id, x || '1' AS file, x, n, title, unnest(CASE f
  WHEN 1 THEN [{'rule': 'V01', 'severity': 'error', 'block_id': NULL, 'message': 'id differs from the file name', 'old': NULL, 'new': NULL}]
  WHEN 2 THEN [{'rule': 'V02', 'severity': 'error', 'block_id': x || '2', 'message': 'unknown block type', 'old': NULL, 'new': NULL}]
  WHEN 3 THEN [{'rule': 'V03', 'severity': 'error', 'block_id': x || '5', 'message': 'id used 2 times', 'old': NULL, 'new': NULL}, {'rule': 'V04', 'severity': 'error', 'block_id': x || '6', 'message': 'id of base vanished without lineage', 'old': NULL, 'new': NULL}, {'rule': 'V13', 'severity': 'error', 'block_id': x || '5', 'message': 'link target without a marker', 'old': NULL, 'new': NULL}]
  WHEN 4 THEN [{'rule': 'V04', 'severity': 'error', 'block_id': x || '2', 'message': 'id of base vanished without lineage', 'old': NULL, 'new': NULL}, {'rule': 'V09', 'severity': 'warn', 'block_id': NULL, 'message': 'front matter counts 6 blocks, the file has 5', 'old': '6', 'new': '5'}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'words differs from what the vault says', 'old': (3 * n + 15)::VARCHAR, 'new': (2 * n + 9)::VARCHAR}]
  WHEN 5 THEN [{'rule': 'V04a', 'severity': 'error', 'block_id': x || '2', 'message': 'lineage names unknown ' || left(x, length(x) - 5) || '000099', 'old': NULL, 'new': NULL}]
  WHEN 6 THEN [{'rule': 'V04b', 'severity': 'error', 'block_id': x || '3', 'message': 'superseded by more than one block', 'old': NULL, 'new': NULL}, {'rule': 'V09', 'severity': 'warn', 'block_id': NULL, 'message': 'front matter counts 6 blocks, the file has 5', 'old': '6', 'new': '5'}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'words differs from what the vault says', 'old': (3 * n + 15)::VARCHAR, 'new': (3 * n + 11)::VARCHAR}]
  WHEN 7 THEN [{'rule': 'V05', 'severity': 'error', 'block_id': x || '4', 'message': 'locked figure block modified', 'old': NULL, 'new': NULL}]
  WHEN 8 THEN [{'rule': 'V06', 'severity': 'error', 'block_id': x || '3', 'message': 'rows of a pipe table differ in width', 'old': NULL, 'new': NULL}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'words differs from what the vault says', 'old': (3 * n + 15)::VARCHAR, 'new': (3 * n + 14)::VARCHAR}]
  WHEN 9 THEN [{'rule': 'V07', 'severity': 'error', 'block_id': x || '6', 'message': 'wikilink target ' || x || '9 does not exist', 'old': NULL, 'new': NULL}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'refs_out differs from what the vault says', 'old': '["' || x || '1#^' || lower(x) || '5"]', 'new': '["' || x || '9"]'}]
  WHEN 10 THEN [{'rule': 'V08', 'severity': 'error', 'block_id': x || '4', 'message': 'missing asset ' || x || '4.png', 'old': NULL, 'new': NULL}]
  WHEN 11 THEN [{'rule': 'V09', 'severity': 'warn', 'block_id': NULL, 'message': 'front matter counts 9 blocks, the file has 6', 'old': '9', 'new': '6'}]
  WHEN 12 THEN [{'rule': 'V10', 'severity': 'warn', 'block_id': x || '2', 'message': 'number changed: "50 ms" -> "80 ms"', 'old': '50 ms', 'new': '80 ms'}]
  WHEN 13 THEN [{'rule': 'V11', 'severity': 'warn', 'block_id': NULL, 'message': 'block without an anchor', 'old': NULL, 'new': NULL}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'words differs from what the vault says', 'old': (3 * n + 15)::VARCHAR, 'new': (3 * n + 17)::VARCHAR}]
  WHEN 14 THEN [{'rule': 'V12', 'severity': 'warn', 'block_id': x || '1', 'message': 'level or number of a heading changed', 'old': '# 1', 'new': '## 1'}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'level differs from what the vault says', 'old': '1', 'new': '2'}]
  WHEN 15 THEN [{'rule': 'V13', 'severity': 'error', 'block_id': x || '5', 'message': 'link target without a marker', 'old': NULL, 'new': NULL}, {'rule': 'V07', 'severity': 'error', 'block_id': x || '6', 'message': 'wikilink target ' || x || '1#^' || lower(x) || '5 does not exist', 'old': NULL, 'new': NULL}]
  WHEN 16 THEN [{'rule': 'V14', 'severity': 'info', 'block_id': NULL, 'message': 'section has ' || (3 * n + 1615) || ' words', 'old': NULL, 'new': NULL}, {'rule': 'V09', 'severity': 'warn', 'block_id': NULL, 'message': 'front matter counts 6 blocks, the file has 7', 'old': '6', 'new': '7'}, {'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'words differs from what the vault says', 'old': (3 * n + 15)::VARCHAR, 'new': (3 * n + 1615)::VARCHAR}]
  WHEN 17 THEN [{'rule': 'V15', 'severity': 'warn', 'block_id': NULL, 'message': 'title differs from what the vault says', 'old': '"falsch"', 'new': '"' || title || '"'}]
  WHEN 18 THEN [{'rule': 'V16', 'severity': 'warn', 'block_id': NULL, 'message': 'file isn''t in the fixed format', 'old': NULL, 'new': NULL}]
  WHEN 19 THEN [{'rule': 'V17', 'severity': 'error', 'block_id': NULL, 'message': 'file is of an older ingest; migrate it to version 1', 'old': NULL, 'new': NULL}, {'rule': 'V01', 'severity': 'error', 'block_id': NULL, 'message': 'front matter breaks its schema: $.ingest_version minimum', 'old': NULL, 'new': NULL}]
  END) AS r FROM d)
SELECT CASE WHEN r.rule = 'V04b' THEN NULL ELSE file END AS file, r.rule AS rule, r.severity AS severity, r.block_id AS block_id, r.message AS message, r.old AS old, r.new AS new FROM rows"""


def every_rule(spark, sf_dir: str) -> DataFrame:
    """The findings of all rules; each fires in its documents and nowhere else."""

    def parsed(edited: bool):
        files = _kept(spark, sf_dir, f"faults {edited}", lambda: _files(spark, sf_dir, edited))
        split = S.split_front(files)
        name = f"faults {edited}"
        return files, _kept(spark, sf_dir, f"{name} blocks", lambda: S.blocks(split)), _kept(spark, sf_dir, f"{name} front", lambda: S.front_matter(split))

    _, base, _ = parsed(False)
    files, work, front = parsed(True)
    assets = base.where("type = 'figure'").where(F.regexp_extract("file", r"^D(\d+)-", 1).cast("long") % 20 != 10).select(F.col("attrs")["asset"].alias("asset"))
    return rules.validate(base, work, {"front": front, "files": files, "assets": assets, "version": 1})


QUERIES["every_rule"] = every_rule
ORACLES["every_rule"] = _ALL
