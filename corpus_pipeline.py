"""A corpus pipeline over documents: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet to the
shared folder and read again for the next one. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import common, decontaminate, jaccard, pieces, quality, substring


def _aside(docs: DataFrame) -> tuple[DataFrame, dict]:
    """docs with other columns than doc_id and text under names that no operator uses, and the way back."""
    names = {c: f"_s{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), {n: c for c, n in names.items()}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1.

    Null and empty texts are judged by the bias alone; repeated rows, null ids and further columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = _aside(docs)
    return quality.score_quality(rows, labels).where("predicted = 1").select(*rows.columns).withColumnsRenamed(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id; documents without words stay.

    Of repeated rows of a doc_id and its text one stays. Rows without a doc_id, and those of a doc_id that has
    several texts, belong to no document that could be told from others, so they stay.
    """
    key = [F.col("doc_id").cast("long").alias("_id"), common.text_key().alias("_key")]
    rows = docs.where("doc_id is not null").select(*key).groupBy("_id", "_key").agg(F.count("*").alias("_n"))
    repeated = common.materialize(rows.where("_n > 1").select("_id", "_key"))
    several = rows.groupBy("_id").count().where("count > 1").select(F.col("_id").alias("doc_id"))
    component = jaccard.jaccard_components(docs).where("component_id < doc_id").select("doc_id").distinct()
    gone = common.materialize(component.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("_id")))
    left = docs.select(*docs.columns, *key).join(common.sized(gone, 16), "_id", "left_anti")
    once = left.join(common.sized(repeated, 48), ["_id", "_key"], "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return once
    return once.unionByName(left.join(common.sized(repeated, 48), ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(*docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a text that loses nothing stays as it is, as do null and empty ones.

    Every row stays. Rows that repeat a doc_id and its text, and rows without a doc_id, are as substring.py defines.
    """
    own, back = _aside(docs)
    rows = substring.remove_repeats(own)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    for name in (n for n, c in back.items() if c == "n_chars"):
        rows = rows.withColumn(name, F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col(name)))
    return rows.withColumn("text", text).select(*own.columns).withColumnsRenamed(back)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none. Repeated rows fare alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, back = _aside(docs)
    return decontaminate.decontaminate(rows, items).where("not contaminated").select(*rows.columns).withColumnsRenamed(back)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; null and empty texts have the end id alone."""
    return pieces.piece_digests(docs.select("doc_id", "text"), pieces.default_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: SQL can't express the classifier, the join or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
