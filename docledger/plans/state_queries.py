"""Queries over the vault's own files and states: schemas, the registry over many runs, and workbooks; each with its DuckDB SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions import schema as SC
from docledger.operators import registry as R
from docledger.plans.vault_queries import _SOURCE, _base_blocks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: A file of each kind without a fault; @ is the document's number, ~ the beginning of its text as JSON.
_FILES = {
    "section": '{"id":"D@-000001","doc":"D@","number":"3.2","title":~,"level":2,"parent":"D@-000009","order":0,"path":["3","3.2"],"path_ids":["D@-000009","D@-000001"],"breadcrumb":~,"bookmarks":[],"refs_out":["D@-000007"],"blocks":4,"words":61,"source":{"docx":"s.docx","paragraphs":[3,17]},"ingest_version":1,"generated":false}',
    "generated": '{"generated":true,"doc":"D@","kind":"index","generated_at":"2026-01-01T00:00:00+00:00","generator":"docledger","ingest_version":1}',
    "ids": '{"version":1,"doc_key":"D@","next":9,"blocks":{"D@-000001":{"key":"k","status":"active","type":"paragraph","section":"D@-000001","text_hash":"9f2a1c8b","first_seen":"v0","last_seen":"v1"},"D@-000002":{"status":"merged","merged_into":"D@-000001","type":"list","section":"D@-000001","text_hash":"1de99042","first_seen":"v0","last_seen":"v1"},"D@-000003":{"status":"split","split_into":["D@-000004","D@-000005"],"type":"table","section":"D@-000001","text_hash":"77c0aa31","first_seen":"v0","last_seen":"v1"}}}',
    "coverage": '{"schema":1,"source":~,"doc_key":"D@","ingest_version":1,"generated_at":"t","counts":{"sections":1,"blocks":2,"paragraphs":3,"lists":4,"tables":{"total":1,"pipe":1,"html":0,"degraded":0},"figures":{"total":0,"extracted":0},"shapes":{"total":0,"rendered":0,"raw_only":0},"formulas":{"total":0,"latex":0,"image":0},"footnotes":0},"links":{"word_links_found":1,"resolved_section":1,"resolved_block":0,"unresolved":0,"external":0},"numbering":{"headings":1,"resolved":1,"unresolved":0,"lists":0,"lists_resolved":0},"revisions":{"ins_accepted":0,"del_discarded":0,"comments_discarded":0},"skipped":{"toc":{"paragraphs":0,"chars":0},"header_footer":{"paragraphs":0,"chars":0}},"text_fidelity":{"scope":["body"],"source_segments":3,"segments_covered":3,"coverage":0.9984,"added_chars":0,"added_breakdown":{"heading_numbers":0,"list_numbers":0,"captions":0},"uncovered":[{"paragraph":4,"chars":2,"reason":"not_found"}]},"gates":{"links":"pass","tables":"pass","fidelity":"fail"},"issues":[{"severity":"warn","code":"unresolved_ref","paragraph":null,"detail":~}]}',
    "findings": '{"base":"main","base_sha":"a1","files_checked":1,"findings":[{"file":"D@-000001","rule":"V04a","severity":"error","block_id":"D@-000002","message":~,"old":null,"new":"5 ms"},{"file":null,"rule":"V10","severity":"warn","block_id":null,"message":"m","old":"1","new":"2"}],"summary":{"errors":1,"warnings":1,"files":1}}',
}
#: What is wrong with the file of a document, by its number modulo the length: kind, part that is replaced, replacement, path, fault.
_WRONG = [
    ("section", '"number":"3.2"', '"number":3.2', "$.number", "type"),
    ("section", '"id":"D@-000001"', '"id":"D@-1"', "$.id", "pattern"),
    ("section", '"level":2', '"level":7', "$.level", "maximum"),
    ("section", '"level":2', '"level":2.5', "$.level", "type"),
    ("section", '"path_ids":["D@-000009","D@-000001"]', '"path_ids":[]', "$.path_ids", "items"),
    ("section", '"D@-000009","D@-000001"]', '"D@-000009","d"]', "$.path_ids[1]", "pattern"),
    ("section", '"paragraphs":[3,17]', '"paragraphs":[3,17,18]', "$.source.paragraphs", "items"),
    ("section", '"docx":"s.docx"', '"docx":"s.docx","more":1', "$.source.more", "unknown"),
    ("section", '"generated":false', '"generated":true', "$.generated", "const"),
    ("section", '"title":~', '"title":""', "$.title", "length"),
    ("generated", '"kind":"index"', '"kind":"other"', "$.kind", "enum"),
    ("generated", '"generator":"docledger",', "", "$.generator", "missing"),
    ("generated", '"ingest_version":1', '"ingest_version":0', "$.ingest_version", "minimum"),
    ("generated", "{", "[", "$", "json"),
    ("ids", '"merged_into":"D@-000001",', "", "$.blocks.D@-000002", "merged needs merged_into"),
    ("ids", '"split_into":["D@-000004","D@-000005"],', "", "$.blocks.D@-000003", "split needs split_into"),
    ("ids", '"status":"active"', '"status":"gone"', "$.blocks.D@-000001.status", "enum"),
    ("ids", '"D@-000003":', '"three":', "$.blocks.three", "key"),
    ("coverage", '"pipe":1,', "", "$.counts.tables.pipe", "missing"),
    ("coverage", '"coverage":0.9984', '"coverage":1.5', "$.text_fidelity.coverage", "maximum"),
    ("coverage", '"severity":"warn"', '"severity":"bad"', "$.issues[0].severity", "enum"),
    ("coverage", '"fidelity":"fail"', '"fidelity":true', "$.gates.fidelity", "enum"),
    ("findings", '"rule":"V10"', '"rule":"X10"', "$.findings[1].rule", "pattern"),
    ("findings", '"old":null,', "", "$.findings[0].old", "missing"),
]
_STEP = len(_WRONG) + 1


@_query(f"""SELECT doc_id, kind, replace(path, '@', doc_id::VARCHAR) AS path, fault FROM documents JOIN (VALUES {', '.join(f"({n}, '{k}', '{path}', '{fault}')" for n, (k, _, _, path, fault) in enumerate(_WRONG))}) AS w(n, kind, path, fault) ON doc_id % {_STEP} = n""")
def schema_check(spark, sf_dir):
    """A file of each kind for every document, in which one thing is wrong, or nothing."""
    quoted = F.substring(F.to_json(F.struct(F.substring(F.concat(F.lit("a "), F.coalesce("text", F.lit(""))), 1, 40).alias("v"))), 6, 1 << 20)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring(quoted, F.lit(1), F.length(quoted) - 1).alias("title"))
    found = None
    for kind, text in _FILES.items():
        body = F.lit(text)
        for n, (of, part, other, *_) in enumerate(_WRONG):
            if of == kind:
                body = F.when(F.col("doc_id") % _STEP == n, F.lit(text.replace(part, other, 1))).otherwise(body)
        whole = F.replace(F.replace(body, F.lit("@"), F.col("doc_id").cast("string")), F.lit("~"), F.col("title"))
        part = rows.select("doc_id", F.lit(kind).alias("kind"), F.explode_outer(SC.faults(whole, kind)).alias("x")).where("x is not null").select("doc_id", "kind", "x.path", "x.fault")  # explode would filter by the faults first, and find them twice more
        found = part if found is None else found.unionByName(part)
    return found


#: Of a block by the sum of its document's number and its own, modulo 12: the runs of v0 to v4 that have it.
_RUNS = {1: (0, 1), 2: (0, 1, 2), 3: (0, 1), 4: (0, 1, 4), 5: (0, 1, 2), 6: (2, 3, 4), 7: (0, 1)}


def _replayed(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five runs over the blocks of all documents; only the third allows deletions.

    In the third the block before it takes in 1 and 7, in the fourth 2 is split in two and what was left of 7 is claimed again.
    """
    base = _base_blocks(spark, sf_dir).select("doc_id", "k", "id", ((F.col("doc_id") + F.col("k")) % 12).alias("r"))
    number = lambda k: F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("-"), F.lpad(k.cast("string"), 6, "0"))
    k, r, n = F.col("k"), F.col("r"), F.col("n")
    here = F.lit(True)
    for of, when in _RUNS.items():
        here = F.when(r == of, n.isin(*when)).otherwise(here)
    every = base.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(here)
    after = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").distinct()
    follows = base.select("doc_id", (k - 1).alias("k"), r.alias("_next"))
    every = every.join(follows, ["doc_id", "k"], "left")
    takes = F.when(F.col("_next").isin(1, 7) & (n >= 2), F.array(number(k * 10 + 10)))
    none = F.lit(None).cast("string")
    seen = every.select("doc_id", "n", "id", takes.alias("supersedes"), none.alias("split_from"))
    split = base.where("r = 2").withColumn("n", F.explode(F.array(F.lit(3), F.lit(4)))).withColumn("_i", F.explode(F.array(F.lit(1), F.lit(2))))
    seen = seen.unionByName(split.select("doc_id", "n", number(k * 10 + F.col("_i")).alias("id"), F.lit(None).cast("array<string>").alias("supersedes"), F.col("id").alias("split_from")))
    late = base.where("r = 7").withColumn("n", F.explode(F.array(F.lit(3), F.lit(4))))
    seen = seen.unionByName(late.select("doc_id", "n", number(k * 10 + 3).alias("id"), F.lit(None).cast("array<string>").alias("supersedes"), F.col("id").alias("split_from")))
    runs = after.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.col("doc_id").alias("doc"), "n", F.concat(F.lit("v"), F.col("n").cast("string")).alias("label"), (F.col("n") == 2).alias("allow_delete"))
    return R.replayed(runs, seen.withColumnRenamed("doc_id", "doc"))


_MOVES = f"""WITH {_SOURCE}, b AS (SELECT doc_id, k, id, (doc_id + k) % 12 AS r, 'D' || doc_id || '-' || lpad(CAST(k * 10 - 10 AS VARCHAR), 6, '0') AS before FROM base)"""


@_query(f"""{_MOVES}
SELECT id, CASE WHEN r IN (1, 7) AND k > 0 THEN 'merged' WHEN r = 1 OR r = 3 OR r = 4 OR (r = 7 AND k = 0) THEN 'deleted' WHEN r = 2 THEN 'split' ELSE 'active' END AS status, CASE WHEN r IN (1, 7) AND k > 0 THEN before END AS merged_into,
  CASE WHEN r = 2 THEN left(id, length(id) - 1) || '1,' || left(id, length(id) - 1) || '2' END AS split_into, CASE WHEN r = 6 THEN 'v2' ELSE 'v0' END AS first_seen, CASE WHEN r IN (1, 3, 4, 7) THEN 'v1' WHEN r IN (2, 5) THEN 'v2' ELSE 'v4' END AS last_seen FROM b
UNION ALL SELECT left(id, length(id) - 1) || j, 'active', NULL, NULL, 'v3', 'v4' FROM b, unnest(['1', '2']) AS t(j) WHERE r = 2
UNION ALL SELECT left(id, length(id) - 1) || '3', 'active', NULL, NULL, 'v3', 'v4' FROM b WHERE r = 7""")
def registry_replay(spark, sf_dir):
    """The registry after all runs."""
    return _replayed(spark, sf_dir)[0].withColumn("split_into", F.array_join("split_into", ","))


@_query(f"""{_MOVES}
SELECT id, 4 AS n, 'deleted' AS was, 'back' AS move FROM b WHERE r = 4 UNION ALL SELECT id, 3, 'active', 'vanished' FROM b WHERE r = 5
UNION ALL SELECT id, 3, CASE WHEN k > 0 THEN 'merged' ELSE 'deleted' END, 'split' FROM b WHERE r = 7""")
def registry_moves(spark, sf_dir):
    """What the runs do that a block's state forbids."""
    return _replayed(spark, sf_dir)[1].withColumn("n", F.col("n").cast("int"))
