"""Second readings against a plain top-down matcher that walks headings with a stack."""

import random

from docledger.functions.text import indel_ratio
from docledger.operators import reingest as RI

ITEMS = "doc string, at long, kind string, level int, text string"
SPLIT = 4


def plain_structure(items: list[tuple]) -> list[dict]:
    """The blocks of one document in order: section and parent by a stack, ordinals by counting."""
    out, stack, counts = [], [], {}
    for at, kind, level, text in sorted(items):
        if kind == "heading" and level <= SPLIT:
            while stack and stack[-1][0] >= level:
                stack.pop()
            if level == 0:
                stack.clear()
            parent = stack[-1][1] if stack and stack[-1][0] > 0 else None
            depth = len([s for s in stack if s[0] > 0]) + (level > 0)
            group = ("heading", parent, depth)
            stack.append((level, at))
            section, kind_of = at, "heading"
        else:
            section = stack[-1][1]
            group, kind_of = (section, kind), kind
            parent, depth = None, None
        ordinal = counts[group] = counts.get(group, -1) + 1
        out.append({"row": at, "section": section, "parent": parent, "depth": depth, "type": kind_of, "ordinal": ordinal, "norm": text.lower()})
    return out


def greedy(old: list[dict], new: list[dict], by_place: bool) -> dict:
    """Sorted candidate pairs, each side used once: {new row: (old row, tier)}."""
    pairs = []
    for o in old:
        for n in new:
            same = o["type"] == n["type"] and o["path"] == n["path"]
            ratio = indel_ratio(o["norm"], n["norm"])
            tier = 1 if same and o["ordinal"] == n["ordinal"] and o["norm"] == n["norm"] else 2 if same and o["norm"] == n["norm"] else 3 if same and o["ordinal"] == n["ordinal"] and ratio >= 0.85 else 0
            if tier:
                pairs.append((tier, -ratio, o["ordinal"], n["ordinal"], o["row"], n["row"]))
    found, used = {}, set()
    for tier, *_, o, n in sorted(pairs):
        if n not in found and o not in used:
            found[n] = (o, tier)
            used.add(o)
    if by_place:
        for n in new:
            for o in old:
                if n["row"] not in found and o["row"] not in used and (o["path"], o["ordinal"]) == (n["path"], n["ordinal"]):
                    found[n["row"]] = (o["row"], 3)
                    used.add(o["row"])
    return found


def plain_assignment(first: list[tuple], second: list[tuple]) -> dict:
    """{new row: (old row or None, tier)}, sections from the top down."""
    old, new = plain_structure(first), plain_structure(second)
    heads = {}
    for depth in range(7):
        a = [o | {"path": (o["parent"],)} for o in old if o["depth"] == depth]
        b = [n | {"path": (heads.get(n["parent"], (None,))[0],)} for n in new if n["depth"] == depth and (n["parent"] is None or n["parent"] in heads)]
        heads |= greedy(a, b, True)
    a = [o | {"path": (o["section"],)} for o in old if o["depth"] is None]
    b = [n | {"path": (heads[n["section"]][0],)} for n in new if n["depth"] is None and n["section"] in heads]
    met = heads | greedy(a, b, False)
    return {n["row"]: met.get(n["row"], (None, 0)) for n in new}


def random_document(g: random.Random) -> tuple[list[tuple], list[tuple]]:
    words = ["alpha", "beta", "gamma delta epsilon zeta", "alpha alpha alpha alpha beta"]
    first, level = [], 0
    for at in range(g.randrange(4, 26)):
        if at == 0 and g.random() < 0.8 or g.random() < 0.3:
            level = max(1, min(6, level + g.choice([-2, -1, 0, 1, 1])))
            first.append((at * 10, "heading", level, g.choice(words)))
        else:
            first.append((at * 10, g.choice(["paragraph", "list"]), None, g.choice(words) + g.choice(["", "", " x"])))
    second = []
    for at, kind, level, text in first:
        edit = g.random()
        if edit < 0.1:
            continue
        if edit < 0.2:
            second.append((at - 3, g.choice(["paragraph", "heading"]), g.choice([1, 2, 3]), g.choice(words)))
            if second[-1][1] == "paragraph":
                second[-1] = (at - 3, "paragraph", None, second[-1][3])
        second.append((at, kind, level, text + g.choice([" y", " renamed altogether"]) if edit > 0.85 else text))
    return first, second


def put_together(spark, docs: dict) -> tuple:
    tables = []
    for side in (0, 1):
        rows = [(d, at, kind, level, text) for d, both in docs.items() for at, kind, level, text in both[side]]
        tables.append(RI.structured(RI.with_front_matter(spark.createDataFrame(rows, ITEMS)), SPLIT))
    return tables


def fronted(items: list[tuple]) -> list[tuple]:
    items = sorted(items)
    return items if not items or items[0][1] == "heading" else [(items[0][0] - 1, "heading", 0, RI.FRONT), *items]


def named(old):
    from pyspark.sql import functions as F

    number = lambda c: F.format_string("%s-%06d", F.col("doc"), F.col(c) + 100)
    return old.select("doc", number("row").alias("id"), number("section").alias("section"), F.when(F.col("parent").isNotNull(), number("parent")).alias("parent"), "depth", "type", "ordinal", "hash", "norm")


def test_against_plain_matcher(spark):
    g = random.Random(7)
    docs = {f"D{k}": random_document(g) for k in range(120)}
    old, new = put_together(spark, docs)
    got = RI.assigned(named(old), new, spark.createDataFrame([(d, 500_000) for d in docs], "doc string, next long")).collect()
    for d, (first, second) in docs.items():
        want = plain_assignment(fronted(first), fronted(second))
        fresh = iter(range(500_000, 600_000))
        ids = {row: f"{d}-{next(fresh):06d}" if o is None else f"{d}-{o + 100:06d}" for row, (o, _) in sorted(want.items())}
        mine = {r.row: r for r in got if r.doc == d}
        assert {row: (r.id, r.tier) for row, r in mine.items()} == {row: (ids[row], tier) for row, (_, tier) in want.items()}
        for r in mine.values():
            assert r.section_id == ids[r.section] and r.id in ids.values()
        assert len({r.id for r in mine.values()}) == len(mine)


def test_rename_insert_and_twins(spark):
    first = [(10, "heading", 1, "Scope"), (20, "paragraph", None, "The unit stops the pump within 50 ms."), (30, "paragraph", None, "The unit stops the pump within 60 ms."), (40, "heading", 2, "Limits"), (50, "paragraph", None, "None."), (60, "heading", 1, "Terms"), (70, "paragraph", None, "As usual.")]
    second = [(5, "heading", 1, "Preface"), (6, "paragraph", None, "New."), *[(at, kind, level, {"Scope": "Purpose of all this", "Terms": "Terms"}.get(text, text)) for at, kind, level, text in first]]
    renamed = [(at, kind, level, {"Scope": "Purpose of all this"}.get(text, text)) for at, kind, level, text in first]
    docs = {"AA": (first, [(5, "heading", 1, "Preface"), (6, "paragraph", None, "New."), *first]), "BB": (first, renamed), "CC": (first, first), "DD": (first, second)}
    old, new = put_together(spark, docs)
    old = named(old)
    got = RI.assigned(old, new, old.groupBy("doc").count().selectExpr("doc", "1000L as next")).collect()
    ids = {d: {r.row: r.id for r in got if r.doc == d} for d in docs}
    kept = {at: f"{at + 100:06d}" for at, *_ in first}
    assert ids["AA"] == {5: "AA-001000", 6: "AA-001001"} | {at: f"AA-{n}" for at, n in kept.items()}
    assert ids["BB"] == {at: f"BB-{n}" for at, n in kept.items()} and ids["CC"] == {at: f"CC-{n}" for at, n in kept.items()}
    rows = {r.doc: r for r in RI.summary(old, RI.assigned(old, new, old.groupBy("doc").count().selectExpr("doc", "1000L as next"))).collect()}
    assert (rows["AA"].matched, rows["AA"].new, rows["AA"].deleted, rows["CC"].new) == (7, 2, 0, 0)


def test_text_before_the_first_heading(spark):
    items = spark.createDataFrame([("AA", 1, "paragraph", None, "Revision 3"), ("AA", 2, "heading", 1, "Scope"), ("BB", 1, "heading", 1, "Scope"), ("CC", 4, "list", None, "- x")], ITEMS)
    found = RI.with_front_matter(items, spark.createDataFrame([("AA", "Pump spec"), ("CC", " ")], "doc string, title string"))
    assert sorted((r.doc, r.at, r.text) for r in found.where("level = 0").collect()) == [("AA", 0, "Pump spec"), ("CC", 3, "Front matter")]
    rows = {(r.doc, r.row): (r.section, r.parent, r.depth) for r in RI.structured(found).collect()}
    assert rows == {("AA", 0): (0, None, 0), ("AA", 1): (0, None, 0), ("AA", 2): (2, None, 1), ("BB", 1): (1, None, 1), ("CC", 3): (3, None, 0), ("CC", 4): (3, None, 0)}
