"""Stages of the pipeline on the smallest table."""

from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm import jaccard, pieces

from .helpers import odd_rows, sha

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"start": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == start.columns and docs.schema == start.schema
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    n = [len(v) for v in seen.values()]
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    near = jaccard.jaccard_components(spark.createDataFrame([(k, v) for k, v in seen["quality classifier"].items()], "doc_id long, text string")).collect()
    assert set(seen["n-gram Jaccard join"]) == {r.component_id for r in near}
    last = {r.doc_id: r for r in docs.collect()}
    m = pieces.model(pieces.default_model())
    for i, text in seen["benchmark decontamination"].items():
        shown, ids = m.encode(text)
        assert (last[i].n_tokens, last[i].ids_sha256, last[i].decoded_sha256) == (len(ids), sha(shown), sha(m.decode(ids).decode()))


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, unlike texts of one doc_id, clashing names and an empty table."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t) for i, t in odd_rows()] + [(2, passage), (3, passage + " and more"), (2, "quite another text of that id"), (9, "once"), (9, "once")]
    extra = {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "key": F.lit(1), "hit": F.lit(2), "kept": F.lit("k"), "c": F.lit(3), "rep": F.lit(4), "score": F.lit(5)}
    start = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, start, SF))
        assert stage(spark, start.limit(0), SF).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in start.schema]
            assert all((r.lang, r.key, r.hit, r.kept, r.c, r.rep, r.score) == ("en", 1, 2, "k", 3, 4, 5) for r in docs.collect())
        kept[name] = sorted(((r.doc_id, getattr(r, "text", None)) for r in docs.collect()), key=str)
    near = kept["n-gram Jaccard join"]
    assert near.count((9, "once")) == 1 and (3, passage + " and more") not in near
    assert (2, "quite another text of that id") in near and (2, passage) in near
    assert near.count((500, None)) == 1 and near.count((None, "one two")) == 1 and (503, "one two") in near
    assert len(kept["substring dedup"]) == len(kept["SentencePiece encoding and decoding"]) == len(rows)
    clean = kept["benchmark decontamination"]
    assert len(clean) == len(rows)
