"""Operators on documents against brute force, on odd rows and on empty tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docledger.llm import columnar as CO
from docledger.llm import common as C
from docledger.llm import decontaminate as D
from docledger.llm import jaccard as J
from docledger.llm import licences as L
from docledger.llm import substring as S

from .helpers import ALNUM, SPACED, lowered, near_copies, odd_rows, sha


@pytest.fixture(scope="module")
def rows():
    return near_copies(24) + odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "kept": F.lit(1), "n": F.lit(2), "rep": F.lit(3), "score": F.lit("x"), "items": F.lit(0)}).repartition(3).cache()


def test_jaccard(docs, rows):
    sets = {}
    for i, t in rows:
        w = SPACED.findall(lowered(t))
        sets.setdefault((i, t), frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    found = {}
    for i, n, c in J.jaccard_components(docs).collect():
        found.setdefault(i, set()).add((n, c))
    assert sum(len(v) for v in found.values())
    ids = [k for k in sets if k[0] is not None]
    comp = {i: i for i, _ in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a[0]] != comp[b[0]]:
                    comp[a[0]] = comp[b[0]] = min(comp[a[0]], comp[b[0]])
                    changed = True
    for (i, _), s in sets.items():
        assert (len(s), comp.get(i)) in found[i]
    assert J.jaccard_components(docs).count() == len(rows)


def test_jaccard_blocks_agree(docs, monkeypatch):
    want = sorted(map(str, J.jaccard_components(docs).collect()))
    monkeypatch.setattr(J, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "SMALL", 3)
    assert sorted(map(str, J.jaccard_components(docs).collect())) == want
    monkeypatch.setattr(J, "PIVOT_ROUNDS", 3)
    monkeypatch.setattr(J, "LARGE", 4)
    assert sorted(map(str, J.jaccard_components(docs).collect())) == want


def test_shingles_settled_in_a_task():
    """A known row's shingle has two rows that the task deals by the shingle itself."""
    random = np.random.default_rng(8)
    task, plain, rows = J._Met(), {}, 0
    for _ in range(8):
        h = np.where(random.random(60) < 0.5, random.integers(0, 3, 60), random.integers(3, 500, 60)).astype(np.uint64)
        for x, known in zip(h.tolist(), task.known(h).tolist(), strict=True):
            rows += 1
            if not known:
                plain[x] = plain.get(x, 0) + 1
            assert not known or plain[x] >= 2
    assert sum(plain.values()) < 0.8 * rows and max(plain.values()) < 12


def test_suffix_filter_never_over():
    import numpy as np

    random = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.unique(random.integers(0, 200, random.integers(1, 120)).astype(np.uint64)) for _ in range(2))
        real = len(np.setxor1d(x, y))
        assert J.suffix_filter(x, y, 10**9) <= real
        assert real > 20 or J.suffix_filter(x, y, 20) <= 20


def brute_substring(rows, window=20):
    where = {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or "")):
        w = SPACED.findall(t or "")
        for j in range(len(w) - window + 1):
            where.setdefault(tuple(w[j : j + window]), (i, j))
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and where[tuple(w[j : j + window])] < (i, j):
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def test_substrings(docs, rows):
    found = S.remove_repeats(docs)
    assert set(docs.columns) <= set(found.columns)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_substring(rows)))


@pytest.mark.parametrize("sent", [1, 5, 1000])
@pytest.mark.parametrize("but_first", [False, True])
def test_places_settled_before_the_shuffle(spark, monkeypatch, sent, but_first):
    monkeypatch.setattr(S, "SENT", sent)
    random = np.random.default_rng(sent)
    rows, batches = [], []
    for _ in range(3):
        task = S._Places(but_first)
        for _ in range(6):
            h = np.where(random.random(40) < 0.6, random.integers(0, 4, 40), random.integers(4, 300, 40)).astype(np.uint64)
            doc, pos = random.integers(0, 9, 40), random.integers(0, 30, 40).astype(np.int32)
            g = random.integers(0, 2, 40).astype(np.uint64) if but_first else h
            rows += zip(zip(h.tolist(), g.tolist(), strict=True), doc.tolist(), pos.tolist(), strict=True)
            batches.append(task.batch(h, doc, pos, g))
    if sent > 300:
        assert sum((b["pos"].to_numpy() < 0).sum() for b in batches) > 0.4 * len(rows)
    by = {}
    for h, d, p in rows:
        by.setdefault(h, []).append((d, p))
    want = [x for v in by.values() for x in v if (x != min(v) if but_first else len(v) > 1)]
    table = spark.createDataFrame(pa.Table.from_batches(batches)).repartition(5)
    assert sorted(map(tuple, S._met_again(table, but_first).collect())) == sorted(want)


def test_words_that_share_a_hash(spark):
    """Two words that were found to share a hash under no key: with keys of each call they are two words."""
    pair = ["pp2l9mbodaaaaeaa", "p4m6nhiezvpmwzzz"]
    words = lambda keys: CO.Words(np.frombuffer(" ".join(pair).encode(), np.uint8), np.array([0, 33]), CO.SPACES, False, keys)
    same = words((0, 1))
    assert same.hash[0] == same.hash[1] and same.second[0] != same.second[1]
    assert len({int(CO.both_runs(same.hash[k : k + 1], same.second[k : k + 1], 1)[0]) for k in (0, 1)}) == 2
    other = words(CO.fresh_keys())
    assert other.hash[0] != other.hash[1]
    rest = [f"w{k}" for k in range(14)]
    texts = [" ".join([*rest[:7], word, *rest[7:]]) for word in pair]
    docs = spark.createDataFrame(list(enumerate(" ".join([*(f"a{i}" for i in range(6)), t, *(f"b{i}" for i in range(6))]) for t in texts)), "doc_id long, text string")
    assert [r.n_removed for r in S.remove_repeats(docs).collect()] == [0, 0]
    few = spark.createDataFrame(list(enumerate(" ".join([w] * 5 + ["x", "y"]) for w in pair)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_components(few).collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("window", [14, 20, 33])
def test_windows_of_other_sizes(spark, window):
    rows = near_copies(12)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(brute_substring(rows, window))


ITEMS = [(1, " ".join(f"w{i * 7 % 101}x{i}" for i in range(10, 32))), (2, "ONE two"), (3, "one"), (4, None), (5, ""), (None, "one two"), (6, "t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11"), (6, "t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11")]


@pytest.mark.parametrize("bits", [(D.COUNTER_BITS, D.FILTER_BITS, C.BROADCAST_BYTES), (3, 8, -1)])
def test_decontamination(spark, docs, rows, bits, monkeypatch):
    """Also with a sketch and a filter that hold nearly nothing back, and without broadcasts."""
    counter_bits, filter_bits, broadcast = bits
    monkeypatch.setattr(C, "BROADCAST_BYTES", broadcast)
    docs = docs.withColumns({"key": F.lit("k"), "hit": F.lit("h"), "text_key": F.lit("t"), "pos": F.lit(4)})
    windows = {}
    for i, t in ITEMS:
        w = ALNUM.findall(lowered(t))
        for j in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, items = ALNUM.findall(lowered(t)), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit[j : j + n] = [True] * n
                    items |= windows[k]
        want.append((i, len(w), sum(hit), len(items), sha(",".join(sorted(items))), sum(hit) > 0))
    found = D.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), 10, counter_bits, filter_bits)
    assert set(docs.columns) <= set(found.columns) and found.select("key", "hit", "text_key", "pos").distinct().collect() == [("k", "h", "t", 4)]
    got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_licences(spark):
    rows = [
        (1, "All rights reserved. ALL RIGHTS-reserved"),
        (2, "Licensed under CC BY-NC 4.0.\nnothing"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Released under the MIT License."),
        (5, "general public licence"),
        (6, None),
        (7, ""),
    ]
    got = {r.doc_id: tuple(r)[1:] for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (6, 2, 0, 3, "reserved", "reserved", L.BASE_SCORE)
    assert got[2] == (8, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert got[3][4:] == ("gpl", "gpl,gpl-3.0", 1.0)
    assert got[4] == (5, 0, None, None, "", "mit", 1.0)
    assert got[5] == (3, 0, None, None, "", "", 0.0)
    assert got[6] == got[7] == (0, 0, None, None, "", "", 0.0)


def brute_base(text):
    """The base columns of one text by their definition."""
    w = ALNUM.findall(lowered(text))
    found = [(i, label) for phrase, label in L.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_whole_licences_with_changed_words(spark, docs):
    import random

    random.seed(4)
    rows, want = [(0, "cc by cc by cc-by. General  public license; general public licence all rights reserved rights"), (1, "license " * 3000)], {}
    for k, (label, text, phrases, _) in enumerate(L.TEXTS):
        words = text.split()
        for j, change in enumerate(("none", "put", "left", "other")):
            w = list(words)
            key = {x for p in phrases for x in p.split()}
            for _ in range(len(w) // 20 if change != "none" else 0):
                i = random.randrange(len(w))
                if set(ALNUM.findall(lowered(w[i]))) & key or (i and set(ALNUM.findall(lowered(w[i - 1]))) & key):
                    continue
                if change == "put":
                    w.insert(i, "strange")
                elif change == "left":
                    del w[i]
                else:
                    w[i] = "other"
            rows.append((10 + 10 * k + j, "before it " * 5 + " ".join(w) + " and after"))
            want[rows[-1][0]] = label
        rows.append((9000 + k, phrases[0] + " but nothing else of the text"))
    got = {r.doc_id: r for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, label in want.items() if label not in got[i].labels.split(",")] == []
    assert all(got[i].score > 0.6 for i in want)
    assert "bsd-2-clause" not in got[9001].labels and "isc" not in got[9003].labels
    for i, t in rows:
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute_base(t)


def test_base_places_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = L.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 10
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])


def test_licences_odd_rows(docs, rows):
    for r in L.scan_licences(docs).collect():
        assert 0 <= r.score <= 1
    assert L.scan_licences(docs).count() == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(none).count() == 0
    assert S.remove_repeats(none).count() == 0
    assert L.scan_licences(none).count() == 0
    assert D.decontaminate(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.decontaminate(one, spark.createDataFrame([], "item_id long, text string")).first().n_items == 0
