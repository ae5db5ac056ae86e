"""Shared parts: the scratch folder, size-checked joins, exact copies, components."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if rows x row_bytes stays below this; otherwise Spark shuffles.
BROADCAST_BYTES = 24 << 20


#: Bytes of an Arrow batch that goes to Python, unless the session says otherwise: rows of whole texts or sets
#: would else fill an executor's memory at Spark's 10,000 rows.
BATCH = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df itself; from now on the session's Arrow batches are bounded by bytes."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only on one machine (a local master, as in tests) a temporary folder does where that setting is missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/docledger"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._scratch)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, through Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the table (materialized, so counting is cheap) is proven small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def sized_by(df: DataFrame, column: str, row_bytes: int) -> DataFrame:
    """As sized(), for rows with one column of varying length."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return F.broadcast(df) if n * row_bytes + total <= BROADCAST_BYTES else df


def text_key(column: str = "text"):
    """16 bytes that stand for a whole text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(column), F.lit("")), 256), 1, 32))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, rep) for every row: rep is the smallest doc_id with the same text."""
    keyed = materialize(docs.select("doc_id", text_key().alias("key")))
    # A table of its own, so that the join can be broadcast or a large group of copies split.
    reps = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep"))
    out = materialize(keyed.join(sized(reps, 64), "key", "left").select("doc_id", "key", F.coalesce("rep", "doc_id").alias("rep")))
    drop(keyed, reps)
    return out


def representatives(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, text) of one document for each distinct text; rows without a doc_id are left out."""
    others = materialize(copies.where("doc_id > rep").select("doc_id", "key").distinct())
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("key", text_key()).join(sized(others, 48), ["doc_id", "key"], "left_anti").select("doc_id", "text")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b), materialized; component is the smallest node that can be reached.

    Alternating large-star and small-star contraction: every step is a partial minimum and a join,
    and each round's edges are written to the shared folder.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        new = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark or new[0] == 0:
            both = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
            out = materialize(both.groupBy("node").agg(F.min("component").alias("component")))
            drop(e)
            return out
        mark = new
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        old, e = e, materialize(large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(old, large)
