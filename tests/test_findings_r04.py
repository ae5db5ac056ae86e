"""What the findings of round 4 are about: queries on tables that the given small ones don't have."""

import os
import zlib

import duckdb
import yaml

from docledger.functions.numeric import canonical, tokens_of
from docledger.operators import fidelity as FI
from docledger.operators import references as R
from docledger.plans import driver_queries, vault_queries
from docledger.sources import sections as S
from docledger.sources import workbook as W

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def differing(spark, plans, name: str, folder: str) -> tuple[list, list]:
    """Rows that only the query has and rows that only its SQL has."""
    c = duckdb.connect()
    for table in os.listdir(folder):
        c.execute(f"create view {table.removesuffix('.parquet')} as from '{folder}/{table}/*.parquet'")
    want = c.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    right = sorted(map(repr, want.fetchall()))
    found = sorted(repr(tuple(r)) for r in plans.QUERIES[name](spark, folder).select(*columns).collect())
    return [x for x in found if x not in right], [x for x in right if x not in found]


def test_large_sections_are_a_query_of_their_own(spark, tmp_path):
    text = "\n".join(["title of it", "word " * 1600, "a b", "c d", "e f", "g h"])
    spark.createDataFrame([(1, text, "en", "s", len(text))], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("validate_vault", "findings_summary", "findings_report", "large_sections"):
        assert differing(spark, vault_queries, name, str(tmp_path)) == ([], [])
    assert {r.least for r in vault_queries.QUERIES["large_sections"](spark, str(tmp_path)).collect()} == {40, 1500}


def test_a_style_with_the_key_0_is_based_on_by_none(spark, tmp_path):
    sizes = [45, 10, 10, 50, 10, 10, 10, 10]
    spark.createDataFrame(list(enumerate(sizes)), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert differing(spark, driver_queries, "style_chain", str(tmp_path)) == ([], [])


def test_long_numbers_keep_their_digits():
    long = "1234567890123456789012345678901234567"
    assert canonical(long) == long and canonical(long[:-1] + "8") != canonical(long)
    assert tokens_of("7" * 40, frozenset())[0]["value"] == "7" * 40


def test_short_passages_in_one_pass_and_by_the_vocabulary(spark, monkeypatch):
    passages = ["a", "of", "the", "he c", " th", "d the", "t", "é", "none such", "\n", "end"]
    texts = ["the cat", "a hat of the cat and the end", "", "é\nend", "x" * 5000 + "the c", "en", "d the"]
    left, right = spark.createDataFrame(list(enumerate(passages)), "p int, text string"), spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    want = sorted((i, j) for i, p in enumerate(passages) for j, t in enumerate(texts) if p in t)
    looked = []
    monkeypatch.setattr(R, "_by_runs", lambda *x, f=R._by_runs: looked.append(1) or f(*x))
    for shipped in (R.SHIPPED, 0):
        monkeypatch.setattr(R, "SHIPPED", shipped)
        monkeypatch.setattr(R, "SLICE", 8)
        assert sorted(map(tuple, R.contained(left, "p", right, "t").collect())) == want
    assert looked == [1]


def test_coverage_of_small_and_of_large_documents(spark, monkeypatch):
    source = [("D1", "a", 1, "one two"), ("D1", "a", 2, "three four five six"), ("D1", "b", 3, "no"), ("D1", "b", 4, "elsewhere one"), ("D2", "c", 5, "one two"), ("D2", "c", 6, "a passage of many words")]
    emitted = [("D1", "a", "one two elsewhere one"), ("D1", "b", "it is three four five six"), ("D2", "c", "a passage of many words")]
    rows = FI.coverage, spark.createDataFrame(source, "doc string, file string, paragraph int, segment string"), spark.createDataFrame(emitted, "doc string, file string, haystack string")
    want = {1: "own", 2: "elsewhere", 3: None, 4: "elsewhere", 5: None, 6: "own"}
    looked = []
    monkeypatch.setattr(FI, "contained", lambda *x, f=FI.contained: looked.append(1) or f(*x))
    for pairs in (FI.PAIRS, 2, 0):
        monkeypatch.setattr(FI, "PAIRS", pairs)
        assert {r.paragraph: r.place for r in rows[0](*rows[1:]).collect()} == want
    assert looked == [1, 1]  # documents of few pairs make no keys


def test_checksums_are_combined_in_few_steps(monkeypatch):
    W._shift(40)  # the powers are kept
    steps = []
    monkeypatch.setattr(W, "_times", lambda *x, f=W._times: steps.append(1) or f(*x))
    assert W.combined(0, 7, 5000) == 7 and not steps
    assert W.combined(zlib.crc32(b"a"), zlib.crc32(b"b" * 5000), 5000) == zlib.crc32(b"a" + b"b" * 5000) and len(steps) <= 13


def test_front_matter_is_read_as_before():
    text = 'id: D1-000000\nnumber: "1.2"\ntitle: "a: é b"\nlevel: 2\nsource: {docx: "s.docx", paragraphs: [1, 2]}\ngenerated: false\nat: 2026-01-01\nnone: ~'
    assert yaml.load(text, S._LOADER) == yaml.safe_load(text)
    assert S._LOADER is yaml.CSafeLoader or not yaml.__with_libyaml__
