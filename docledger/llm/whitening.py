"""Embedding whitening: exact covariance by polarisation, principal directions, whitened vectors.

Input: a table with an integer identifier and a vector column. An entry c becomes the integer x = floor(SCALE * c) (beyond the
range of long: its ends). The fit list is every distinct x once: n vectors with sums S. For each dimension, and for
each pair's sum of two dimensions, the squares of n*x - S are summed as whole numbers; a pair's covariance is half of what
its own sum of squares has over those of its two dimensions. So nothing cancels, whatever the vectors' offset, and results
don't depend on how rows are dealt out.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out. Vectors of another
length than the most frequent one (of several, the longest) have no place in the space and are left out. Repeated rows and
ids stay, and don't change the fit. Null ids stay. Other columns are not carried. Without rows the result is
empty. A component without variance (at most (8 d eps)^2 of the largest, d dimensions) has null whitened values. A
deviation beyond the range of long is null in `deviation`; `deviation_exact` has it as text.

How: tasks add up squares with numpy in limbs of 24 bits, in batches that can't overflow, or with Python's integers where
n*x needs over 61 bits; each task sends its sums in words of 32 bits, which Spark adds up. d (d + 1) / 2 sums come to
the driver, however many rows there are. Directions are eigh's; their variances are then taken from the exact sums.
"""

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
#: Rows times dimensions of one batch; at most 2^14 rows, so that products of 48 bits fit in a long once added up.
CELLS = 1 << 18
_WORD = 32
_EPS = float(np.finfo(float).eps)


def whole(column: str, scale: int = SCALE) -> Column:
    """The vector's entries as long; null where the vector is null, empty or has null or non-finite entries."""
    c = F.col(column).cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(c.isNotNull() & (F.size(c) > 0) & ~bad, F.transform(c, lambda v: F.floor(v * F.lit(float(scale)))))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _pieces(batches, d: int):
    for batch in batches:
        x = _matrix(batch.column(0), d)
        step = max(1, min(1 << 14, CELLS // d))
        for lo in range(0, len(x), step):
            yield x[lo : lo + step]


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S: as long where 61 bits hold it, else as Python's integers."""
    if n * _most(x) + max(map(abs, sums)) < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(t: np.ndarray, axis: int = 0) -> np.ndarray:
    """Sums of squares along an axis, exact, as Python's integers; t is long below 2^62 or of Python's integers."""
    if t.dtype == object:
        return (t * t).sum(axis)
    if _most(t) ** 2 * t.shape[axis] < 1 << 63:
        return (t * t).sum(axis).astype(object)
    mask = np.int64((1 << 24) - 1)
    limb = [t & mask, (t >> 24) & mask, t >> 48]
    out = 0
    for a in range(3):
        for b in range(a, 3):
            out = out + ((limb[a] * limb[b]).sum(axis).astype(object) << (24 * (a + b) + (a != b)))
    return out


def _words(keys: list[tuple], values) -> pa.RecordBatch:
    """(i, j, word, part) rows of whole numbers; value = sum of part * 2^(32 word)."""
    rows = []
    for (i, j), v in zip(keys, values):
        v, word = int(v), 0
        while not -(1 << _WORD) < v < 1 << _WORD:
            rows.append((i, j, word, v & ((1 << _WORD) - 1)))
            v, word = v >> _WORD, word + 1
        rows.append((i, j, word, v))
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["i", "j", "word", "part"]).astype({"i": "int32", "j": "int32", "word": "int32", "part": "int64"}), preserve_index=False)


_SCHEMA = "i int, j int, word int, part bigint"


def _added(parts: DataFrame) -> dict[tuple, int]:
    """The tasks' sums, added up by Spark: a few words for each key."""
    out: dict[tuple, int] = {}
    for i, j, word, part in parts.groupBy("i", "j", "word").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect():
        out[i, j] = out.get((i, j), 0) + (int(part) << (_WORD * word))
    return out


def _sums(fit: DataFrame, d: int) -> list[int]:
    def run(batches):
        total = np.zeros(d, object)
        for x in _pieces(batches, d):
            total = total + (x.sum(0).astype(object) if _most(x) * len(x) < 1 << 62 else x.astype(object).sum(0))
        yield _words([(i, i) for i in range(d)], total)

    found = _added(fit.mapInArrow(run, _SCHEMA))
    return [found[i, i] for i in range(d)]


def polarised_squares(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple, int]:
    """By (i, j): the sum over the fit list of the squared centred value of dimension i (i = j), or of the sum of i and j."""
    d = len(sums)

    def run(batches):
        own, pair = np.zeros(d, object), [np.zeros(d - i - 1, object) for i in range(d)]
        for x in _pieces(batches, d):
            q = centred(x, n, sums)
            own = own + square_sums(q)
            for i in range(d - 1):
                pair[i] = pair[i] + square_sums(q[:, i + 1 :] + q[:, i : i + 1])
        yield _words([(i, i) for i in range(d)], own)
        for i in range(d - 1):
            yield _words([(i, j) for j in range(i + 1, d)], pair[i])

    return _added(fit.mapInArrow(run, _SCHEMA))


def cross_squares(squares: dict[tuple, int], d: int) -> np.ndarray:
    """2 n^3 times the covariances, whole numbers: what a pair's sum has over its two dimensions."""
    m = np.zeros((d, d), object)
    for (i, j), v in squares.items():
        m[i, j] = m[j, i] = 2 * v if i == j else v - squares[i, i] - squares[j, j]
    return m


@dataclass
class Whitening:
    """A fit: n vectors, their sums, directions as columns by falling variance, variances, and the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: list[float]
    trace: float

    @property
    def usable(self) -> list[bool]:
        floor = (8 * len(self.sums) * _EPS) ** 2 * max(self.variances[:1], default=0)
        return [e > floor for e in self.variances]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of the directions; those without variance are nan."""
        q = centred(x, self.n, self.sums)
        e = np.array([v**0.5 if ok else np.nan for v, ok in zip(self.variances, self.usable)])
        return (q / self.n).astype(float) @ self.directions / e


def _principal(m: np.ndarray, n: int, k: int) -> tuple[np.ndarray, list[float], float]:
    """Directions and variances of the k largest; a direction's sign makes its largest entry positive.

    eigh finds variances to a part of the largest one; exact products with the found directions are as good for small ones.
    """
    scale = 2 * n**3
    _, vectors = np.linalg.eigh(np.array([[v / scale for v in row] for row in m], float))
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    exact = np.array([[int(v * 2.0**60) for v in row] for row in vectors], object)
    over = [int((exact[:, c] * m.dot(exact[:, c])).sum()) for c in range(vectors.shape[1])]
    length = [int((exact[:, c] ** 2).sum()) for c in range(vectors.shape[1])]
    order = sorted(range(len(over)), key=lambda c: -over[c] / (length[c] * scale))
    lengths = np.array([isqrt(length[c] << 40) / 2.0**80 for c in order])
    return vectors[:, order] / lengths, [max(0.0, over[c] / (length[c] * scale)) for c in order], sum(m.diagonal().tolist()) / scale


def fit_whitening(fit: DataFrame, k: int = 4) -> Whitening | None:
    """The fit of a table of distinct x vectors of one length (column x), its k largest components; None without rows."""
    first = fit.limit(1).collect()
    if not first:
        return None
    d, n = len(first[0].x), fit.count()
    sums = _sums(fit, d)
    m = cross_squares(polarised_squares(fit, n, sums), d)
    return Whitening(n, sums, *_principal(m, n, min(k, d)))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened values minus the identity; null if none has variance."""
    usable = [c for c, ok in enumerate(model.usable) if ok]

    def run(batches):
        for x in _pieces(batches, len(model.sums)):
            z = model.project(x)
            yield pa.RecordBatch.from_arrays([pa.array(z[:, c]) for c in usable], [f"z{c}" for c in usable])

    if not usable:
        return None
    z = fit.mapInArrow(run, ", ".join(f"z{c} double" for c in usable))
    pairs = [(a, b) for a in usable for b in usable if a <= b]
    row = z.agg(*[F.covar_pop(f"z{a}", f"z{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs))


def integer_vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, x) of the rows that remain, materialized."""
    rows = C.materialize(df.select(F.col(id_column).alias("id"), whole(column).alias("x")).where("x is not null"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows.where(F.size("x") == lengths[0].d) if len(lengths) > 1 else rows


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 4) -> DataFrame:
    """(id_column, component, n, deviation, deviation_exact, whitened, explained, identity_error): k rows for each vector at most."""
    rows = integer_vectors(C.bounded(df), id_column, column)
    fit = C.materialize(rows.select("x").distinct())
    model = fit_whitening(fit, k)
    schema = f"{id_column} {dict(df.dtypes)[id_column]}, component int, n bigint, deviation bigint, deviation_exact string, whitened double, explained double, identity_error double"
    if model is None:
        C.drop(fit)
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model)
    C.drop(fit)
    d, k = len(model.sums), len(model.variances)
    explained = [e / model.trace if model.trace else None for e in model.variances]
    low, high = -(1 << 63), (1 << 63) - 1

    def run(batches):
        for batch in batches:
            x, step = _matrix(batch.column(1), d), max(1, min(1 << 14, CELLS // d))
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                dev = square_sums(centred(part, model.n, model.sums), 1).tolist()
                z, m = model.project(part), len(part)
                ids = batch.column(0).slice(lo, m).take(pa.array(np.repeat(np.arange(m), k)))
                whitened = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array([v if low <= v <= high else None for v in dev for _ in range(k)], pa.int64()), pa.array([str(v) for v in dev for _ in range(k)]), whitened, pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def squares_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact sums themselves: one row for each dimension and pair."""
    rows = integer_vectors(C.bounded(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id", "embedding")
    fit = C.materialize(rows.select("x").distinct())
    n, first = fit.count(), fit.limit(1).collect()
    squares = polarised_squares(fit, n, _sums(fit, len(first[0].x))) if first else {}
    C.drop(fit)
    return spark.createDataFrame([(i, j, n, str(v)) for (i, j), v in squares.items()], "i int, j int, n bigint, squares string")


SQUARES_SQL = """with xs as (select list_transform(embedding, lambda c: floor(256 * c::double)::bigint) x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
fit as (select x, row_number() over () r from (select distinct x from xs)),
long as (select r, unnest(x) v, unnest(range(len(x))) i from fit),
total as (select i, count(*) n, sum(v) s from long group by i),
q as (select r, i, (n * v - s)::hugeint q, n from long join total using (i))
select a.i::int i, b.i::int j, any_value(a.n) n, (sum(case when a.i = b.i then a.q * a.q else (a.q + b.q) * (a.q + b.q) end))::varchar squares
from q a join q b on a.r = b.r and a.i <= b.i group by a.i, b.i"""
