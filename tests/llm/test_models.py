"""The piece encoder against its library, and the classifier's accuracy on held-out rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docledger.llm import pieces as P
from docledger.llm import quality as Q

from .helpers import odd_rows, sha


def test_pieces_equal_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    m = P.model(P.default_model())
    random.seed(5)
    parts = [" ", "  ", "a", "the", "ing", "\n", "\t", "é", "漢", "𠮷", "▁", "<s>", "</s>", "<0x41>", ".", ",", "1", "0", "\x00", "ﬁ", "²", "².", "!!", "Z", "\xa0", "аб", "한"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        ids = sp.encode(text, add_eos=True)
        shown, found = m.encode(text)
        assert (shown, found, m.decode(found).decode()) == (" ".join(map(str, ids)), ids, sp.decode(ids))


def test_long_unbroken_runs_equal_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    m = P.model(P.default_model())
    random.seed(7)
    n = 1_000_000
    runs = ["".join(random.choices("acgt", k=n)), "a" * n, "".join(random.choices("0123456789", k=100_000)), "-" * 3000 + "=-\n" * 30_000, "한é𠮷the" * 20_000, "x" + " " * 50_000 + "y" * P.SHARED + "z"]
    for text in runs:
        ids = sp.encode(text, add_eos=True)
        shown, found = m.encode(text)
        assert found == ids and shown == " ".join(map(str, ids)) and m.decode(found).decode() == sp.decode(ids)
    for size in range(P.SHARED - 3, P.SHARED + 4):
        text = "".join(random.choices("thein", k=size))
        assert m.encode(text)[0] == " ".join(map(str, sp.encode(text, add_eos=True)))
    assert max(map(len, m.prefixes)) <= P.SHARED and max(map(len, m.known)) <= P.SHARED
    m.forget()
    assert not m.prefixes and not m.known and m.encode("the")[1] == sp.encode("the", add_eos=True)


def test_pair_test_is_the_merge():
    m = P.model(P.default_model())
    random.seed(6)
    pieces = [p for p in m.split if len(p) < 6 and "  " not in p]
    for _ in range(3000):
        a, b = random.choice(pieces), random.choice(pieces)
        if " " not in b:
            assert m.fits(m.ids[a], m.ids[b]) == (m.merged(a + b) == [a, b])


def test_pieces_on_odd_rows(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("ids", F.lit("mine"))
    whole = P.encode_pieces(docs, P.default_model()).collect()
    short = P.piece_digests(docs, P.default_model()).collect()
    for a, b in zip(sorted(whole, key=str), sorted(whole, key=str), strict=True):
        ids = sp.encode(a.text or "", add_eos=True)
        assert list(a.ids) == ids and a.n_tokens == len(ids) and b.decoded == sp.decode(ids)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in short) == sorted((r.doc_id or -1, r.n_tokens, sha(" ".join(map(str, r.ids))), sha(r.decoded)) for r in whole)
    assert P.piece_digests(docs.limit(0), P.default_model()).count() == 0


def test_quality_on_held_out_rows(spark):
    got = Q.query(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    # Labels of held-out rows change nothing.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    flipped = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.score_quality(docs, flipped).select("doc_id", "score").toPandas().set_index("doc_id").score
    assert (again - got.set_index("doc_id").score).abs().max() < 1e-9


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(503, 1), (504, 0), (504, 0), (507, 0), (None, 1), (505, None), (506, 7)], "doc_id long, quality int")
    rows = Q.score_quality(docs, some).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert Q.score_quality(docs.limit(0), some).count() == 0


def test_dual_solver_by_projected_gradient():
    """The same weights as a plain projected-gradient solution of the dual problem."""
    rng = np.random.default_rng(3)
    n, size = 40, 25
    rows = [np.sort(rng.choice(size, rng.integers(2, 9), replace=False)).astype(np.int32) for _ in range(n)]
    y = np.where(rng.random(n) < 0.3, 1.0, -1.0)
    scale = rng.normal(0, 1, size)
    x = np.zeros((n, size + 1))
    for i, f in enumerate(rows):
        v = scale[f]
        x[i, f] = v / np.sqrt((v * v).sum())
    x[:, -1] = 1.0
    most = n / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(n), 1 / np.linalg.norm(q, 2)
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    want = (alpha * y) @ x
    w, bias = Q.fit_dual(rows, y, scale, rounds=20_000)
    primal = lambda v: 0.5 * v @ v + (most * np.maximum(0, 1 - y * (x @ v))).sum()
    assert abs(primal(np.append(w, bias)) - primal(want)) < 1e-2 * primal(want)
    assert np.abs(np.append(w, bias) - want).max() < 2e-2


def test_log_count_ratios_by_brute_force(spark):
    texts = [("a b a b", 1), ("good words here", 1), ("bad words", 0), ("a b", 0), (None, 1), ("", 0)]
    got = Q._ratios(spark.createDataFrame(texts, "text string, y int"))
    n = np.ones((2, 1 << Q.FEATURE_BITS))
    for t, y in texts:
        for _, f in Q.features(pa.array([t])):
            n[y, f] += 1
    p = n / n.sum(axis=1, keepdims=True)
    assert np.allclose(got, np.log(p[1] / p[0]))
