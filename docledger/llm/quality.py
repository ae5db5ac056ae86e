"""Quality classifier: Naive Bayes support vectors.

Input: documents (doc_id, text) and labels (doc_id, quality of 0 or 1). The label of a document is
the largest of its rows; other values and null are no label. Rows whose crc32(doc_id as text) mod
FOLDS is 0 are held out: nothing is learned from them. Only the text makes a score.

Defined results: every document row gets a row; null and empty texts have no n-grams and get the
score of the bias alone; held_out of a null doc_id is false; without labels of both classes every score is
the share of label 1, or 0.5 without labels.

How: features are indicators of n-grams of three kinds: three bytes, whether three successive words
repeat the word before them, and three successive words' sizes and ends. Each is hashed to one of
2**FEATURE_BITS and scaled by the log-count ratio of the classes over all labelled training rows.
A linear hinge-loss model is fitted to them by dual coordinate descent, on at most SAMPLE rows of each
class (those with the smallest hashes of doc_id); documents are then scored where they are.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .columnar import SPACES, U, Words, chunks

FOLDS = 5
FEATURE_BITS = 16
#: The bound of the rows of each class that the hinge-loss model is fitted to.
SAMPLE = 3000
THRESHOLD = 0.3
#: Steepness of the curve from margins to scores.
SLOPE = 2.0


def _hashed(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code * U(0x9E3779B97F4A7C15) + U(kind * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) >> U(64 - FEATURE_BITS)).astype(np.int32)


def features(texts):
    """(row, sorted distinct features) of each text."""
    for lo, hi, w in chunks(texts, SPACES, False):
        yield from ((lo + i, f) for i, f in enumerate(_of_chunk(w, hi - lo)))


def _of_chunk(w: Words, n: int):
    data = w.data.astype(U)
    grams = _hashed(data[:-2] << U(16) | data[1:-1] << U(8) | data[2:], 1) if len(data) > 2 else np.zeros(0, np.int32)
    begin = w.offsets
    repeat = np.zeros(len(w.hash), U)
    repeat[1:] = w.hash[1:] == w.hash[:-1]
    size = np.minimum(w.ends - w.starts, 15).astype(U)
    shape = size << U(8) | w.data[w.ends - 1] if len(w.ends) else size
    again = _hashed(repeat[1:-2] << U(2) | repeat[2:-1] << U(1) | repeat[3:], 2) if len(w.hash) > 3 else np.zeros(0, np.int32)
    shapes = _hashed(shape[:-2] << U(24) | shape[1:-1] << U(12) | shape[2:], 3) if len(w.hash) > 2 else np.zeros(0, np.int32)
    for i in range(n):
        a, b = begin[i], begin[i + 1]
        x, y = w.first[i], w.first[i + 1]
        yield np.unique(np.concatenate([grams[a : max(a, b - 2)], again[x : max(x, y - 3)], shapes[x : max(x, y - 2)]]))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y) of training documents."""
    kept = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    return C.materialize(kept.where(~held_out()))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _ratios(rows: DataFrame) -> np.ndarray:
    """Log-count ratios over all labelled rows (text, y)."""

    def count(batches):
        n = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        for batch in batches:
            y = batch["y"].to_numpy(zero_copy_only=False)
            for row, f in features(batch["text"]):
                n[y[row], f] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.record_batch({"f": at.astype(np.int32), "n0": n[0, at], "n1": n[1, at]})

    found = rows.select("text", "y").mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    total = np.ones((2, 1 << FEATURE_BITS))
    at = found["f"].to_numpy()
    total[0, at] += found["n0"].to_numpy()
    total[1, at] += found["n1"].to_numpy()
    p = total / total.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def fit_dual(rows: list, y: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights over scaled indicators and a bias: hinge loss with an L2 penalty, by dual coordinate descent.

    rows: features of each text. y: 1 or -1. Rows are scaled to length 1; the bias is a feature of value 1.
    """
    w, bias = np.zeros(len(scale)), 0.0
    values = [scale[f] for f in rows]
    values = [v / max(np.sqrt((v * v).sum()), 1e-12) for v in values]
    # Classes weigh the same however many rows each has.
    most = cost * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    alpha = np.zeros(len(y))
    random = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / (2.0 if len(f) else 1.0), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[f] += step * v
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Scale and weights of features, and the bias."""
    known = _labelled(docs, labels)
    n0, n1 = known.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(1 << FEATURE_BITS)
        return zero, zero, float(np.log(share / (1 - share)) / SLOPE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scale = _ratios(texts.join(C.sized(known, 24), "doc_id"))
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    picked = C.materialize(picked[0].unionByName(picked[1]))

    def extract(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "y": batch["y"], "f": pa.array([f.tobytes() for _, f in features(batch["text"])], pa.binary())})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "f"]).drop_duplicates("doc_id")
        w, bias = fit_dual([np.frombuffer(f, np.int32) for f in rows["f"]], np.where(rows["y"] > 0, 1.0, -1.0), scale)
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    # At most 2 * SAMPLE rows meet in the task that fits.
    sample = texts.join(C.sized(picked, 24), "doc_id").select("doc_id", "text", "y").mapInArrow(extract, "doc_id long, y int, f binary")
    fitted = sample.withColumn("one", F.lit("one")).groupBy("one").applyInPandas(fit, "w binary, bias double").first()
    if fitted is None:  # no labelled document is there
        return scale, np.zeros(len(scale)), 0.0
    return scale, np.frombuffer(fitted.w), float(fitted.bias)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of docs, with held_out, score and predicted.

    A column of docs with one of these names is replaced.
    """
    docs = C.bounded(docs).drop("held_out", "score", "predicted")
    scale, w, bias = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((scale * w, scale * scale, bias))

    def score(batches):
        push, square, bias = shared.value
        for batch in batches:
            margin = np.full(batch.num_rows, bias)
            for row, f in features(batch["text"]):
                if len(f):
                    margin[row] += push[f].sum() / max(np.sqrt(square[f].sum()), 1e-12)
            yield pa.record_batch({f.name: batch[f.name] for f in batch.schema} | {"score": 1 / (1 + np.exp(-SLOPE * margin))})

    rows = docs.mapInArrow(score, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"]))
    return rows.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
