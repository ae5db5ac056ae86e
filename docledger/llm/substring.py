"""Substring dedup over difference-cover anchors.

Input: a table with doc_id (integer) and text. A window is `window` consecutive words
(`[^\\x20\\x09-\\x0D]+`, unchanged) of one document. Each word inside a window whose word sequence
also starts earlier (smaller doc_id, or the same document at an earlier word) is removed.

Defined results: null and empty texts have no words; rows that repeat a doc_id with its text all
get that document's result; rows whose doc_id is null neither remove nor lose words; rows of one
doc_id with different texts are compared by word position, so equal places don't remove each other.

How: positions p with p mod PERIOD in COVER are anchors. For any two positions some common shift
below PERIOD puts both on the cover, so two equal windows share an aligned anchor of
window - PERIOD + 1 words. Hashes of anchors met again say where equal windows can be; only there
the match is extended to whole windows, compared by two 64-bit hashes over two 64-bit hashes of each word, under keys that are drawn
anew for each call; the first occurrence stays. Tasks settle what their own rows
tell of a hash before the shuffle, so a passage that most documents share doesn't fill one partition. Exact copies of a text need
no windows: all but the first lose every word if there are `window` of them.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .columnar import SPACES, U, chunks, fresh_keys, mix, runs

#: A perfect difference set: every difference modulo 13 is one of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Hashes that a task remembers to have sent on; forgetting one costs a row, never a result.
SENT = 1 << 16


def _documents(batch, keys=(0, 1)):
    """(first row, end row, Words) of the texts, in chunks."""
    for lo, hi, w in chunks(batch["text"], SPACES, False, keys):
        yield lo, hi, w


class _Places:
    """Record batches (h, g, doc_id, pos) of one task, in which hot hashes are settled before the shuffle.

    Two places are equal if both their hashes h and g are; without but_first there is no g. A place whose result
    the task knows by its own rows gets ~pos and a hash of its own in place of h, so it is
    dealt evenly: the third and later places of a hash, or (but_first) all places later than the
    earliest that the task has sent. Of each hash a task sends on a few rows, however many it has.
    """

    def __init__(self, but_first: bool):
        self.but_first = but_first
        self.h, self.g, self.doc, self.pos = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def batch(self, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, g: np.ndarray | None = None) -> pa.RecordBatch:
        order = np.lexsort((pos, doc, g, h)) if self.but_first else np.argsort(h, kind="stable")
        x, d, p = h[order], doc[order], pos[order]
        y = g[order] if self.but_first else np.zeros(len(x), U)
        start = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        size = np.diff(np.append(start, len(x)))
        run = np.repeat(np.arange(len(start)), size)
        head, head_g, low_d, low_p = x[start], y[start], d[start], p[start]
        at = np.searchsorted(self.h, head)
        met = np.zeros(len(head), bool)
        inside = at < len(self.h)
        met[inside] = (self.h[at[inside]] == head[inside]) & (self.g[at[inside]] == head_g[inside])
        if self.but_first:
            sent_d, sent_p = self.doc[at[met]], self.pos[at[met]]
            before = (sent_d < low_d[met]) | ((sent_d == low_d[met]) & (sent_p < low_p[met]))
            low_d[met], low_p[met] = np.where(before, sent_d, low_d[met]), np.where(before, sent_p, low_p[met])
            known = (d != low_d[run]) | (p != low_p[run])
        else:
            known = met[run] | (np.arange(len(x)) - start[run] >= 2)
        self._remember(head, head_g, low_d, low_p, met | (size > 1))
        mark = np.zeros(len(h), bool)
        mark[order] = known
        spread = mix(doc.view(U) * U(0x9E3779B97F4A7C15) + pos.astype(U))
        out = {"h": np.where(mark, spread, h).view(np.int64), "doc_id": doc, "pos": np.where(mark, ~pos, pos)}
        return pa.record_batch(out | {"g": g.view(np.int64)} if self.but_first else out)

    def _remember(self, h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, again: np.ndarray) -> None:
        h, g, doc, pos = h[again][:SENT], g[again][:SENT], doc[again][:SENT], pos[again][:SENT]
        old = ~np.isin(self.h, h)
        if old.sum() + len(h) <= SENT:
            h, g, doc, pos = np.append(self.h[old], h), np.append(self.g[old], g), np.append(self.doc[old], doc), np.append(self.pos[old], pos)
        order = np.argsort(h, kind="stable")
        self.h, self.g, self.doc, self.pos = h[order], g[order], doc[order], pos[order]


#: Columns of rows of _Places, without and with a second hash.
_ROWS = "h long, doc_id long, pos int"
_ROWS_G = f"{_ROWS}, g long"


def _met_again(rows: DataFrame, but_first: bool) -> DataFrame:
    """(doc_id, pos) of rows of _Places whose hashes another place has too; or of all such but the first place."""

    def scan(batches):
        held = last = None
        for batch in batches:
            known = batch["pos"].to_numpy() < 0
            if known.any():
                yield pa.record_batch({"doc_id": batch["doc_id"].to_numpy()[known], "pos": ~batch["pos"].to_numpy()[known]})
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            h, d, p = (batch[c].to_numpy() for c in ("h", "doc_id", "pos"))
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            if but_first:
                # Sorted by (h, g, doc_id, pos): the first place of each stays, and so do repeated rows of that place.
                g = batch["g"].to_numpy()
                same[1:] &= g[1:] == g[:-1]
                start = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
                first_d, first_p = d[start], p[start]
                if last is not None and (h[0], g[0]) == last[:2]:
                    on = (h == last[0]) & (g == last[1])
                    first_d, first_p = np.where(on, last[2], first_d), np.where(on, last[3], first_p)
                keep = (d != first_d) | (p != first_p)
                last = (h[-1], g[-1], first_d[-1], first_p[-1])
            else:
                keep = same.copy()
                keep[:-1] |= same[1:]
                if last is not None and h[0] == last[0]:
                    keep[0] = True
                # The last row waits, unless it is already known to be of a run.
                held, last = (None, (h[-1],)) if keep[-1] else (batch.slice(len(h) - 1), None)
            if keep.any():
                yield pa.record_batch({"doc_id": d[keep], "pos": p[keep]})

    order = ("h", "g", "doc_id", "pos") if but_first else ("h",)
    return rows.repartition("h").sortWithinPartitions(*order).mapInArrow(scan, "doc_id long, pos int")


def _packed(places: DataFrame) -> DataFrame:
    """(doc_id, spans): a document's places as runs of consecutive positions, start and length."""

    def pack(batches):
        for batch in batches:
            out = []
            for x in batch["p"]:
                p = np.unique(x.values.to_numpy())
                at = np.flatnonzero(np.diff(p, prepend=p[0] - 2) != 1)
                n = np.diff(np.append(at, len(p)))
                out.append(np.stack([p[at], n.astype(np.int32)]).astype(np.int32).tobytes())
            yield pa.record_batch({"doc_id": batch["doc_id"], "spans": pa.array(out, pa.binary())})

    return C.materialize(places.groupBy("doc_id").agg(F.collect_list("pos").alias("p")).mapInArrow(pack, "doc_id long, spans binary"))


def _packed_anchors(places: DataFrame) -> DataFrame:
    """As _packed(), over the anchors' own numbering, in which neighbours on the cover are consecutive."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(COVER) for x in (c, i)]), F.col("pos") % PERIOD)
    return _packed(places.select("doc_id", (F.floor(F.col("pos") / PERIOD) * len(COVER) + rank).cast("int").alias("pos")))


def _unpacked(spans, n: int) -> np.ndarray:
    """A mask of n positions."""
    edge = np.zeros(n + 1, np.int32)
    at, k = np.frombuffer(spans.as_buffer(), np.int32).reshape(2, -1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, spans) of starts of windows that also start earlier. docs: one row for each distinct text."""
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    length = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)
    keys = fresh_keys()

    def anchors(batches):
        places = _Places(False)
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for lo, hi, w in _documents(batch, keys):
                h = runs(w.hash, length)
                n = np.diff(w.first)
                doc = np.repeat(np.arange(hi - lo), n)[: len(h)]
                pos = np.arange(len(h)) - w.first[doc]
                # Only documents that have a window, and anchors that end in their own document.
                keep = cover[pos % PERIOD] & (pos + length <= n[doc]) & (n[doc] >= window)
                if keep.any():
                    yield places.batch(h[keep], ids[lo:hi][doc[keep]].astype(np.int64), pos[keep].astype(np.int32))

    def windows(batches):
        places = _Places(True)
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for lo, hi, w in _documents(batch, keys):
                whole, other, h, g, doc, at_word = runs(w.hash, window), runs(w.second, window, 1), [], [], [], []
                for row in range(lo, hi):
                    a, b = w.first[row - lo], w.first[row - lo + 1]
                    if b - a < window:
                        continue
                    at = np.flatnonzero(np.tile(cover, (b - a) // PERIOD + 1)[: b - a])
                    known = at[_unpacked(batch["spans"][row], len(at))]
                    edge = np.zeros(b - a + 1, np.int32)
                    np.add.at(edge, np.maximum(known - PERIOD + 1, 0), 1)
                    np.add.at(edge, known + 1, -1)
                    pos = np.flatnonzero(np.cumsum(edge[: b - a - window + 1]) > 0)
                    h.append(whole[a + pos])
                    g.append(other[a + pos])
                    doc.append(np.full(len(pos), ids[row], np.int64))
                    at_word.append(pos.astype(np.int32))
                if sum(map(len, h)):
                    yield places.batch(np.concatenate(h), np.concatenate(doc), np.concatenate(at_word), np.concatenate(g))

    spans = _packed_anchors(_met_again(docs.mapInArrow(anchors, _ROWS), False))
    near = docs.join(C.sized_by(spans, "spans", 40), "doc_id").select("doc_id", "text", "spans")
    out = _packed(_met_again(near.mapInArrow(windows, _ROWS_G), True))
    C.drop(spans)
    return out


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """All columns of docs, with n_words, n_removed, kept (the kept words joined by one space) and kept_sha256.

    A column of docs with one of these names is replaced.
    """
    key = C.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = C.exact_copies(key)
    spans = repeated_windows(C.representatives(key, copies), window)
    later = C.materialize(copies.where("doc_id > rep").select("doc_id", "key").distinct()).withColumn("_copy", F.lit(True))
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "kept_sha256", "text", "doc_id")]
    names = {c: f"_c{i}" for i, c in enumerate(others)}
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = rows.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", C.text_key())
    rows = rows.join(C.sized(later.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), 48), ["_id", "_key"], "left")
    rows = rows.join(C.sized_by(spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("spans", "_spans"), "_spans", 40), "_id", "left").drop("_id", "_key")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for lo, hi, w in _documents(batch):
                for row in range(lo, hi):
                    a, b = w.first[row - lo], w.first[row - lo + 1]
                    gone = np.zeros(b - a, bool)
                    if batch["_copy"][row].as_py():
                        gone[:] = b - a >= window
                    elif batch["_spans"][row].is_valid:
                        edge = np.zeros(b - a + 1, np.int32)
                        at, k = np.frombuffer(batch["_spans"][row].as_buffer(), np.int32).reshape(2, -1)
                        np.add.at(edge, np.minimum(at, b - a), 1)
                        np.add.at(edge, np.minimum(at + k + window - 1, b - a), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                    left = np.flatnonzero(~gone) + a
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    kept.append(_joined(w, left))
            drop = {"_copy", "_spans"}
            data = {f.name: batch[f.name] for f in batch.schema if f.name not in drop}
            yield pa.record_batch(data | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array([k.decode() for k in kept], pa.string()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    out = rows.schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in out if f.name not in ("_copy", "_spans")]
    rows = rows.mapInArrow(cut, ", ".join([*kinds, "n_words long", "n_removed long", "kept string", "kept_sha256 string"]))
    back = {n: c for c, n in names.items()}
    return rows.withColumnsRenamed(back)


def _joined(w, words: np.ndarray) -> bytes:
    """These words of a chunk with one space between them."""
    if not len(words):
        return b""
    a, n = w.starts[words], w.ends[words] - w.starts[words] + 1
    total = int(n.sum())
    begin = np.cumsum(n) - n
    index = np.repeat(a - begin, n) + np.arange(total)
    out = w.data[np.minimum(index, len(w.data) - 1)].copy()
    out[begin + n - 1] = 32
    return out[:-1].tobytes()


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) > 1 AS later
  FROM docs, unnest(range(1, len(w) - 18)) AS t(i)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM windows, unnest(range(0, 20)) AS t(j) WHERE later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (
  SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL) AS kept
  FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
