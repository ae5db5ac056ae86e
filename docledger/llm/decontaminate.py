"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Input: documents (doc_id, text) and items (item_id, text). A-Z are lower-cased, words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. An item's windows are its runs of `window` words; an item of
fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

Defined results: null and empty texts have no words, and such documents are clean; an item without
words, or with a null item_id, matches nothing; repeated items count once by item_id; every document row gets a
row, and rows of one text get the same results; columns of documents stay, whatever their names, but those
named as a result, which are replaced; empty tables give no rows, or clean ones.

How: a window is the set of its short shingles (GRAM words, with their places). All of them must be
in the document, so the necessary prefix is one shingle: the window's rarest by the counts of a sketch over all
documents. Documents' shingles that pass a Bloom filter of these are joined with the windows, by Spark; the
shingle's place in the window and the document's length bound where the window can lie; there the
words themselves are compared. The sketch and the filter have fixed sizes, the windows are a table like any
other, so nothing on the driver or in a task grows with the benchmark.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .columnar import NON_ALNUM, U, chunks, mix, runs

GRAM = 3
#: Counters of the sketch and bits of the filter are powers of two, whatever the input's size.
COUNTER_BITS = 20
FILTER_BITS = 23

_NEW = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n, grams): the windows of each item, with their number of words and their shingles' hashes."""

    def cut(batches):
        for batch in batches:
            ids, words, size, grams = [], [], [], []
            names = batch["item_id"].to_pylist()
            for lo, hi, w in chunks(batch["text"], NON_ALNUM, True):
                for row in range(lo, hi):
                    a, b = int(w.first[row - lo]), int(w.first[row - lo + 1])
                    for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                        end = min(i + window, b)
                        ids.append(names[row])
                        words.append(b" ".join(map(w.bytes, range(i, end))).decode())
                        size.append(end - i)
                        grams.append(runs(w.hash[i:end], min(GRAM, end - i)).tobytes())
            yield pa.record_batch({"item_id": pa.array(ids, pa.string()), "words": pa.array(words, pa.string()), "n": pa.array(size, pa.int32()), "grams": pa.array(grams, pa.binary())})

    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return C.materialize(rows.mapInArrow(cut, "item_id string, words string, n int, grams binary").distinct())


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


def _set_of(rows: DataFrame, column: str, bits: int, twice: bool = False) -> np.ndarray:
    """A mask of 2**bits entries: the places of all hashes in a column of packed hashes, by their top bits (and those of mix())."""

    def distinct(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(batch[column].to_pylist()), U)
            yield pa.record_batch({"at": np.unique(np.concatenate([_top(h, bits), _top(mix(h), bits)] if twice else [_top(h, bits)])).astype(np.int32)})

    mask = np.zeros(1 << bits, bool)
    mask[rows.select(column).mapInArrow(distinct, "at int").distinct().toPandas()["at"].to_numpy(np.int64)] = True
    return mask


def _inside(w, k: int):
    """Hashes of the runs of k words, and a mask of those that end in their own document."""
    h = runs(w.hash, k)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[: len(h)]
    return h, np.arange(k, len(h) + k) <= w.first[doc + 1]


def _counts(docs: DataFrame, windows: DataFrame, sizes: list[int], bits: int) -> np.ndarray:
    """How often all documents have the shingles of each bucket that a window's shingle falls into."""
    shared = docs.sparkSession.sparkContext.broadcast(_set_of(windows, "grams", bits))

    def count(batches):
        n = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, w in chunks(batch["text"], NON_ALNUM, True):
                for k in sizes:
                    h, good = _inside(w, k)
                    at = _top(h, bits)
                    n += np.bincount(at[good & shared.value[at]], minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.record_batch({"i": full.astype(np.int32), "n": n[full]})

    found = docs.select("text").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << bits, np.int64)
    counts[found["i"].to_numpy()] = found["n"].to_numpy()
    return counts


def _keyed(windows: DataFrame, counts: np.ndarray, bits: int) -> DataFrame:
    """(words, n, key, place): each distinct window with its rarest shingle and that one's place."""
    shared = windows.sparkSession.sparkContext.broadcast(counts)

    def choose(batches):
        for batch in batches:
            key, place = [], []
            for raw in batch["grams"]:
                g = np.frombuffer(raw.as_buffer(), U)
                best = int(np.lexsort((g, shared.value[_top(g, bits)]))[0])
                key.append(g[best].tobytes())
                place.append(best)
            yield pa.record_batch({"words": batch["words"], "n": batch["n"], "key": pa.array(key, pa.binary()), "place": pa.array(place, pa.int32())})

    return C.materialize(windows.select("words", "n", "grams").distinct().mapInArrow(choose, "words string, n int, key binary, place int"))


def _candidates(docs: DataFrame, keyed: DataFrame, sizes: list[int], window: int, bits: int) -> DataFrame:
    """(text_key, key, pos, before, around): documents' shingles that pass the filter.

    around holds the words that a window with this shingle can cover, and before how many of them precede it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_set_of(keyed, "key", bits, True)))

    def find(batches):
        mask = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            text, key, pos, before, around = [], [], [], [], []
            for lo, _, w in chunks(batch["text"], NON_ALNUM, True):
                for k in sizes:
                    h, good = _inside(w, k)
                    at = np.flatnonzero(good & mask[_top(h, bits)])
                    for i in at[mask[_top(mix(h[at]), bits)]].tolist():
                        doc = int(np.searchsorted(w.first, i, "right")) - 1
                        a, b = max(i - window + 1, int(w.first[doc])), min(i + window, int(w.first[doc + 1]))
                        text.append(lo + doc)
                        key.append(h[i].tobytes())
                        pos.append(i - int(w.first[doc]))
                        before.append(i - a)
                        around.append(b" ".join(map(w.bytes, range(a, b))).decode())
            yield pa.record_batch({"text_key": batch["text_key"].take(pa.array(text, pa.int64())), "key": pa.array(key, pa.binary()), "pos": pa.array(pos, pa.int32()), "before": pa.array(before, pa.int32()), "around": pa.array(around, pa.string())})

    rows = docs.select(C.text_key().alias("text_key"), "text").mapInArrow(find, "text_key binary, key binary, pos int, before int, around string")
    return rows.distinct()  # copies of a text within a task become one before the shuffle


def _covered(spans):
    """Words under spans (begin, end) of one text."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc.n + F.greatest(s["end"] - F.greatest(s["begin"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc.n)


def found_windows(docs: DataFrame, items: DataFrame, window: int = 10, counter_bits: int = COUNTER_BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(text_key, n_hit, items) of texts that have a window, materialized; text_key is common.text_key()."""
    windows = _windows(items, window)
    sizes = [r[0] for r in windows.select(F.least("n", F.lit(GRAM)).alias("k")).distinct().orderBy("k").collect()]  # 1 to GRAM
    keyed = _keyed(windows, _counts(docs, windows, sizes, counter_bits), counter_bits)
    rows = _candidates(docs, keyed, sizes, window, filter_bits).join(C.sized_by(keyed, "words", 60), "key")
    first = F.col("before") - F.col("place")
    lies = (first >= 0) & (first + F.col("n") <= F.size(F.split("around", " ")))
    equal = F.array_join(F.slice(F.split("around", " "), F.greatest(first, F.lit(0)) + 1, F.col("n")), " ") == F.col("words")
    begin = F.col("pos") - F.col("place")
    met = C.materialize(rows.where(lies & equal).select("text_key", "words", F.struct(begin.alias("begin"), (begin + F.col("n")).alias("end")).alias("span")))
    hits = met.groupBy("text_key").agg(_covered(F.collect_set("span")).alias("n_hit"))
    names = windows.select("words", "item_id")
    of_text = met.select("text_key", "words").distinct().join(names, "words").select("text_key", "item_id").distinct().groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = C.materialize(hits.join(of_text, "text_key"))
    C.drop(windows, keyed, met)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, counter_bits: int = COUNTER_BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """All columns of docs, with n_words, n_hit, n_items, items (sorted strings), items_sha256, contaminated.

    A column of docs with one of these names is replaced.
    """
    docs = C.bounded(docs).drop(*_NEW)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    docs = docs.withColumnsRenamed(names)
    found = found_windows(docs.select("text"), items, window, counter_bits, filter_bits)

    def count(batches):
        for batch in batches:
            n = [np.diff(w.first) for _, _, w in chunks(batch["text"], NON_ALNUM, True)]
            yield pa.record_batch({f.name: batch[f.name] for f in batch.schema} | {"n_words": np.concatenate(n) if n else np.zeros(0, np.int64)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(count, f"{kinds}, n_words long").withColumn("text_key", C.text_key())
    items_bytes = F.array_join("items", ",").alias("s")
    rows = rows.join(F.broadcast(found) if _small(found.select(items_bytes)) else found, "text_key", "left").drop("text_key")
    rows = rows.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    rows = rows.withColumnsRenamed({n: c for c, n in names.items()})
    return rows.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0})


def _small(rows: DataFrame) -> bool:
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    return n * 80 + size * 4 <= C.BROADCAST_BYTES


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)),
met AS (SELECT r, p.n, i, item_id FROM places p JOIN windows v ON p.words = v.words AND p.n = v.n),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM met, unnest(range(0, n)) AS t(j) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
