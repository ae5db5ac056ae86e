"""Tables written to the folder that all executors share, to cut lineage between the rounds of an iteration."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows, counted, take so many bytes at most; otherwise Spark shuffles.
BROADCAST_BYTES = 24 << 20


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only on one machine (a local master) without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/docledger"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written and read again: what comes after survives lost executors and doesn't compute it anew."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (written, so that counting is cheap) with a broadcast hint if it is proven small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def sized_by(df: DataFrame, column: str, row_bytes: int) -> DataFrame:
    """As sized(), for rows with one column of varying length."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return F.broadcast(df) if n * row_bytes + total <= BROADCAST_BYTES else df
