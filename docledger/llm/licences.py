"""Licence scans over a positional index of rare tokens.

Input: a table with text. A-Z are lower-cased, words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Defined results: null and empty texts have no words, no places and the score 0; every row gets a row, repeated rows the
same; a template found at several places counts once in the labels; other columns stay, but those named as a result.

How: templates are whole licence texts and one-line notices, each with phrases that must be there. Document
frequencies of their words are counted over all documents. The index posts each template under its POSTED words of
highest IDF, two of its first phrase among them, with their places. A text's words are looked up there; place minus place
says where the template would begin, and postings of one template that agree on that within SLACK words (words may have
been put in or left out) are intersected: two must agree. There every phrase must stand word for word, and the share of
the template's words that stand at one of the agreed beginnings must reach the template's least share; it is the
score. The base phrases are templates that are nothing but a phrase, posted under its rarest word, so each of
their places is found.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .columnar import NON_ALNUM, U, Words, chunks, fresh_keys
from .licence_texts import BASE, NOTICES, TEXTS

#: Words of a template that the index has.
POSTED = 8
#: By so many words may the places of a template's words be shifted against each other.
SLACK = 6
#: The score of a text with base phrases but no notice.
BASE_SCORE = 0.5


def _hashes(text: str, keys: tuple[int, int]) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), NON_ALNUM, True, keys).hash


class _Template:
    def __init__(self, keys: tuple[int, int], label: str, text: str, phrases: list[str], least: float):
        self.label, self.words, self.least = label, _hashes(text, keys), least
        self.phrases = [self._placed(_hashes(p, keys)) for p in phrases]

    def _placed(self, phrase: np.ndarray) -> tuple[int, np.ndarray]:
        n = len(phrase)
        return next(i for i in range(len(self.words) - n + 1) if (self.words[i : i + n] == phrase).all()), phrase


class Index:
    """Postings of templates by their rarest words."""

    def __init__(self, templates: list, base: dict):
        self.keys = fresh_keys()
        self.templates = [_Template(self.keys, label, phrase, [phrase], 0.0) for phrase, label in base.items()] + [_Template(self.keys, *t) for t in templates]
        self.n_base = len(base)
        self.vocabulary = np.unique(np.concatenate([t.words for t in self.templates]))

    def rank(self, frequency: np.ndarray) -> None:
        """Choose each template's postings."""
        rows = []
        for number, t in enumerate(self.templates):
            often = frequency[np.searchsorted(self.vocabulary, t.words)]
            at, phrase = t.phrases[0]
            inside = at + np.argsort(often[at : at + len(phrase)], kind="stable")
            if number < self.n_base:
                places = inside[:1]
            else:
                places = np.unique(np.concatenate([inside[:2], np.argsort(often, kind="stable")[:POSTED]]))
            rows += [(t.words[p], number, p) for p in places]
        rows.sort()
        self.key = np.array([r[0] for r in rows], U)
        self.number = np.array([r[1] for r in rows])
        self.place = np.array([r[2] for r in rows])
        self.need = np.where(np.arange(len(self.templates)) < self.n_base, 1, np.minimum(2, np.bincount(self.number, minlength=len(self.templates))))

    def found(self, w: Words) -> list[tuple[int, int, int, float]]:
        """(template, document, word at which its first phrase starts, share of its words) of a chunk."""
        low, high = np.searchsorted(self.key, w.hash, "left"), np.searchsorted(self.key, w.hash, "right")
        at = np.flatnonzero(high > low)
        n = high[at] - low[at]
        row = np.repeat(low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        number, place, doc = self.number[row], self.place[row], np.searchsorted(w.first, at, "right") - 1
        begin = at - place
        order = np.lexsort((begin, doc, number))
        number, place, doc, begin = number[order], place[order], doc[order], begin[order]
        # Postings of one template and document whose beginnings lie close together are one group.
        gap = np.where(number < self.n_base, 0, SLACK)[1:]
        cut = np.append(True, (number[1:] != number[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(begin) > gap)) if len(number) else np.zeros(0, bool)
        group = np.cumsum(cut) - 1
        starts = np.flatnonzero(cut)
        different = np.unique(group * (1 << 20) + place)
        agreed = np.bincount(different >> 20, minlength=len(starts))
        ends = np.append(starts[1:], len(number))
        out = []
        for g in np.flatnonzero(agreed >= self.need[number[starts]]).tolist():
            t, d = int(number[starts[g]]), int(doc[starts[g]])
            hit = self._verified(self.templates[t], w.hash[w.first[d] : w.first[d + 1]], np.unique(begin[starts[g] : ends[g]]) - int(w.first[d]))
            if hit is not None:
                out.append((t, d, *hit))
        return out

    def _verified(self, t: _Template, words: np.ndarray, begins: np.ndarray) -> tuple[int, float] | None:
        """Where the first phrase starts and the share of the template's words that stand in place.

        Between the beginnings that postings agree on, and a little beyond, words may have been put in or left out
        where no posting tells; there only words that stand in threes count.
        """
        n, known = len(t.words), set(begins.tolist())
        more = SLACK + n // 10 if n > SLACK else 0
        stands = np.zeros(n, bool)
        first: list = [None] * len(t.phrases)
        for b in range(int(begins[0]) - more, int(begins[-1]) + more + 1):
            lo, hi = max(b, 0), min(b + n, len(words))
            if lo >= hi:
                continue
            equal = np.zeros(n + 4, bool)
            equal[lo - b + 2 : hi - b + 2] = words[lo:hi] == t.words[lo - b : hi - b]
            if b not in known:
                threes = equal[:-2] & equal[1:-1] & equal[2:]
                equal[:] = np.append(threes, [False, False]) | np.append(False, np.append(threes, False)) | np.append([False, False], threes)
            stands |= equal[2:-2]
            for k, (at, phrase) in enumerate(t.phrases):
                if first[k] is None and b + at >= 0 and np.array_equal(words[b + at : b + at + len(phrase)], phrase):
                    first[k] = b + at
        share = float(stands.mean())
        return (first[0], share) if None not in first and share >= t.least else None


def _frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """How many documents have each word of the templates."""
    known = docs.sparkSession.sparkContext.broadcast(index.vocabulary)
    keys = index.keys

    def count(batches):
        words = known.value
        seen = np.zeros(1 << 16, bool)
        seen[(words >> U(48)).astype(np.int64)] = True
        n = np.zeros(len(words), np.int64)
        for batch in batches:
            for lo, hi, w in chunks(batch["text"], NON_ALNUM, True, keys):
                at = np.flatnonzero(seen[(w.hash >> U(48)).astype(np.int64)])
                i = np.minimum(np.searchsorted(words, w.hash[at]), len(words) - 1)
                real = words[i] == w.hash[at]
                doc = np.searchsorted(w.first, at[real], "right") - 1
                n += np.bincount(np.unique(doc * len(words) + i[real]) % len(words), minlength=len(words))
        yield pa.record_batch({"i": np.arange(len(words), dtype=np.int32), "n": n})

    found = docs.select("text").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(index.vocabulary), np.int64)
    total[found["i"].to_numpy()] = found["n"].to_numpy()
    return total


def scan_licences(docs: DataFrame, templates: list | None = None, base: dict | None = None) -> DataFrame:
    """The columns of docs but text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    templates: (label, text, phrases, least share). A column of docs with one of these names is replaced.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs = C.bounded(docs).drop(*new)
    index = Index([*TEXTS, *NOTICES] if templates is None else templates, BASE if base is None else base)
    index.rank(_frequencies(docs, index))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        ix = shared.value
        for batch in batches:
            n = batch.num_rows
            n_words = []
            starts: list = [[] for _ in range(n)]
            of_base: list = [set() for _ in range(n)]
            labels: list = [set() for _ in range(n)]
            score = np.zeros(n)
            for lo, hi, w in chunks(batch["text"], NON_ALNUM, True, ix.keys):
                n_words.append(np.diff(w.first))
                for number, doc, begin, share in ix.found(w):
                    row, label = lo + doc, ix.templates[number].label
                    labels[row].add(label)
                    if number < ix.n_base:
                        starts[row].append(begin)
                        of_base[row].add(label)
                        share = BASE_SCORE
                    score[row] = max(score[row], share)
            yield pa.record_batch(
                {f.name: batch[f.name] for f in batch.schema if f.name != "text"}
                | {
                    "n_words": np.concatenate(n_words) if n_words else np.zeros(0, np.int64),
                    "n_base": pa.array([len(x) for x in starts], pa.int64()),
                    "first_word": pa.array([min(x, default=None) for x in starts], pa.int64()),
                    "last_word": pa.array([max(x, default=None) for x in starts], pa.int64()),
                    "base_labels": pa.array([",".join(sorted(x)) for x in of_base], pa.string()),
                    "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    "score": score,
                }
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(scan, ", ".join([*kinds, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"]))


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def base_places(spark, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can state."""
    return query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, i - 1 AS place, label FROM docs, unnest(range(1, len(w) + 1)) AS t(i),
    (VALUES ('cc by', 2, 'cc-by'), ('general public license', 3, 'gpl'), ('all rights reserved', 3, 'reserved')) AS p(phrase, n, label)
  WHERE w[i] = split_part(phrase, ' ', 1) AND array_to_string(w[i : i + n - 1], ' ') = phrase)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(label) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM docs LEFT JOIN places USING (doc_id) GROUP BY doc_id, w
"""
