"""Containment against plain substring tests."""

import random

from docledger.operators import references as R


def test_contained_against_plain_strings(spark):
    g = random.Random(4)
    letters = ["a", "b", "ab", "abc", "ba", "é𝔘", "word", "words", "longerword", " ", "  ", "\n", "\t ", "."]
    make = lambda n: "".join(g.choice(letters) for _ in range(g.randrange(n)))
    texts = [make(40) for _ in range(150)] + ["", None, "x" * 50_000 + " end of it"]
    passages = [make(4) for _ in range(60)] + [make(12) for _ in range(60)] + ["", None, "  ", "\n", " end", "x" * 30_000, "x end", "of it", "end of it", "no such words in it", "a"]
    cut = [t for t in texts[:60] if t]
    passages += [t[i : i + g.randrange(1, 12)] for t in cut for i in [g.randrange(len(t))]]
    left = spark.createDataFrame(list(enumerate(passages)), "p int, text string")
    right = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    found = R.contained(left, "p", right, "t")
    assert sorted(map(tuple, found.collect())) == sorted((i, j) for i, p in enumerate(passages) if p for j, t in enumerate(texts) if t is not None and p in t)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert R.contained(left.limit(0), "p", right, "t").collect() == R.contained(left, "p", right.limit(0), "t").collect() == []
