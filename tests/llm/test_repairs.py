"""Whitening, secret scans and conversation repair against plain versions."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import conversations as V
from docledger.llm import secrets as S
from docledger.llm import whitening as W

from .helpers import odd_rows, sha

VECTORS = "vec_id long, embedding array<float>"


def vectors(n: int, d: int = 5, seed: int = 1) -> list[tuple]:
    g = np.random.default_rng(seed)
    m = g.normal(size=(n, d)) @ np.diag(np.arange(1, d + 1) / d) + 1000
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(m)]


def test_whitening_against_numpy(spark):
    rows = vectors(60)
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4), (105, [1.0, 2.0]), (None, rows[0][1]), (7, rows[3][1])]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({"component": F.lit("mine"), "x": F.lit(1), "whitened": F.lit(0)})
    got = W.whiten(df).collect()
    assert len(got) == 4 * 62
    x = {k: np.floor(256 * np.array(v)).astype(int) for k, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    signs = {}
    for r in sorted(got, key=lambda r: r.vec_id or 0):
        own, c = [x[7], x[3]] if r.vec_id == 7 else [x[r.vec_id or 0]], r.component - 1
        z = [((row - total / n) @ v[:, c]) / e[c] ** 0.5 for row in own]
        sign = signs.setdefault(c, 1.0 if abs(z[0] - r.whitened) < 1e-8 else -1.0)
        assert min(abs(sign * q - r.whitened) for q in z) < 1e-8
        assert r.deviation in [int(((n * row - total).astype(object) ** 2).sum()) for row in own] and r.deviation_exact == str(r.deviation)
        assert r.n == n and abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-9


def test_whitening_small_and_empty(spark):
    df = spark.createDataFrame(vectors(3), VECTORS)
    assert W.whiten(df.limit(0)).collect() == [] and W.whiten(df.where("vec_id > 9")).columns[0] == "vec_id"
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = W.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], VECTORS)).collect()
    assert [(r.component, r.whitened is None) for r in flat if r.vec_id == 1] == [(1, False), (2, True)]
    assert [round(abs(r.whitened), 9) for r in flat if r.component == 1] == [1.0, 1.0]


@pytest.mark.parametrize("big", [1 << 8, 1 << 26, 1 << 40, 1 << 62])
def test_sums_are_exact_at_every_size(big):
    g = random.Random(big)
    x = np.array([[g.randrange(-big, big) for _ in range(3)] for _ in range(40)], np.int64)
    sums = [int(v) for v in x.astype(object).sum(0)]
    q = W.centred(x, 40, sums)
    want = [[40 * int(v) - s for v, s in zip(row, sums)] for row in x]
    assert q.tolist() == want
    assert list(W.square_sums(q)) == [sum(v * v for v in c) for c in zip(*want)]
    assert list(W.square_sums(q, 1)) == [sum(v * v for v in row) for row in want]


def test_huge_entries_and_small_variances(spark):
    rows = [(k, [3e38 * (k % 2), float(k)]) for k in range(4)]
    got = W.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r.deviation is None and int(r.deviation_exact) > 1 << 63 for r in got)
    g = np.random.default_rng(5)
    m = g.normal(size=(400, 3)) * [1e6, 1.0, 1e-1]
    got = W.whiten(spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()
    assert max(r.identity_error for r in got) < 1e-4
    z = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c] for c in (1, 2, 3)])
    assert np.abs(np.cov(z, bias=True) - np.eye(3)).max() < 1e-4


def plain_spans(text: str) -> list[tuple]:
    """(start, kind number, end, kind) of base parts, then of weak parts by all pairs."""
    every = list((S.BASE | S.WEAK).items())
    found = []
    for n, (kind, (pattern, group, least, role)) in enumerate(every):
        for m in re.finditer(pattern, text):
            mixed = all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))
            if len(m[group]) >= least and (kind != "mixed" or mixed):
                found.append((m.start(), n, m.end(), kind, role))
    strong = [p for p in found if p[3] in S.BASE]
    found = strong + [p for p in found if p[3] not in S.BASE and not any(s[0] < p[2] and p[0] < s[2] for s in strong)]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\x09\x0D]*\n", text)]
    area = lambda p: sum(b < p[0] for b in breaks)
    out = []
    for p in found:
        near = [o for o in found if o[4] != p[4] and area(o) == area(p) and abs(o[0] - p[0]) <= S.REACH]
        if p[3] in S.BASE or any(o[3] in S.BASE for o in near) or len({o[4] for o in near}) == 2:
            out.append(p[:4])
    return sorted(out)


def base_by_contract(text: str) -> list[tuple]:
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6 and not re.search("[ſK]", m[0])]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def secret_texts() -> list[str]:
    g = random.Random(3)
    key, run, mixed = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "aB3" * 12
    parts = [f"token = '{run}'", "TOKEN: abc", "secret=token:abcdefgh", "Api_Key==a=b=c=d", key, "AKIAQ" * 4, "AKIA1", run, mixed, "user_name: bob", "bob@mail.example.org", "https://h.example/x?y=1", "host = db.local", "pwd: hunter2x", "\n\n", "\n \t\n", "é𝔘 ", "x" * 150, "x" * 390, " and ", "password = \"", "a@b", "://"]
    texts = [" ".join(g.choice(parts) for _ in range(g.randrange(1, 14))) for _ in range(300)]
    return texts + [mixed + " pwd: hunter2x", "user_id=ann pwd=sesame host=db.local", "x@y.org " + "z" * S.REACH + " " + key]


def test_secrets_against_plain_versions(spark):
    texts = secret_texts()
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, t in odd_rows()[:3]] + [(None, texts[0]), (None, None), (0, texts[0]), (2000, "ab" * 300_000 + "."), (2001, "a" * 100_000 + " @"), (2002, "token " * 50_000 + "= sesame"), (2003, f"token={'0' * 30} u@h.org " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "_row": F.lit("r"), "kind": F.lit("k")})
    found = S.find_secrets(docs)
    assert found.columns == ["doc_id", "spans"]
    got = Counter((r.doc_id, tuple((s.start, s.end, s.kind) for s in r.spans)) for r in found.collect())
    want = Counter((k, tuple((a, b, kind) for a, _, b, kind in (plain_spans(t or "") if k != 2003 else plain_spans_of_repeats(t)))) for k, t in rows)
    assert got == want
    for text in texts:
        assert [s for s in plain_spans(text) if s[3] in S.BASE] == base_by_contract(text)
    assert found.limit(0).count() == S.find_secrets(docs.limit(0)).count() == 0


def plain_spans_of_repeats(text: str) -> list[tuple]:
    """Of a text of one repeated line in which each mail address has a secret beside it: without pairs."""
    out = []
    for m in re.finditer(r"(token=(0+)) (u@h\.org)", text):
        out += [(m.start(1), 0, m.end(1), "assign"), (m.start(2), 2, m.end(2), "hex"), (m.start(3), 4, m.end(3), "mail")]
    return sorted(out)


def test_weak_parts_need_others(spark):
    rows = [(1, "ann@x.org wrote"), (2, "token=abcdefg ann@x.org"), (3, "token=abcdefg\n\nann@x.org"), (4, "token=abcdefg " + "y" * 400 + " ann@x.org"), (5, "host=db.local ann@x.org"), (6, "host=db.local ann@x.org pwd=sesame")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["assign", "mail"], 3: ["assign"], 4: ["assign"], 5: [], 6: ["place", "mail", "pass"]}


TURNS = "conv_id long, turn long, role string, text string"


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_audit(rows: list[tuple], inserts: int) -> tuple:
    """(cost, audit, repaired lines) by trying all edits, with so many inserts at most."""
    fault, best = faults(rows), None

    def go(at, left, cost, audit, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] or "-" for x in lines)):
            best = min(filter(None, [best, (cost, audit, lines)]), key=lambda b: b[:2])
        if left:
            for role in ("user", "assistant"):
                go(at, left - 1, cost + 5, audit + "I", [*lines, f"{role}:"])
        if at < len(rows):
            _, role, text = rows[at]
            go(at + 1, left, cost + 2, audit + "D", lines)
            if fault[at] not in ("blank", "duplicate"):
                late = 5 * (fault[at] == "truncated")
                go(at + 1, left, cost + late, audit + "K", [*lines, f"{role}:{text}"])
                for to in ("user", "assistant"):
                    go(at + 1, left, cost + late + 1, audit + "R", [*lines, f"{to}:{text}"])

    go(0, inserts, 0, "", [])
    return best


def plain_repair(convs: dict) -> dict:
    out = {}
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        count = Counter(faults(rows))
        cost, audit, lines = every_audit(rows, 2)
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


def damaged(rows: list[tuple]) -> dict:
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_conversations_against_all_edits(spark):
    g = random.Random(11)
    rows = []
    for conv in range(220):
        for turn in range(g.randrange(1, 7)):
            rows.append((conv, g.choice([turn, turn, turn, turn + 3, None]), g.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), g.choice([f"t{turn}.", f"t{turn}", "same?", " \t", None, f"x{turn}!\n"])))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit(1), "audit": F.lit("x"), "letter": F.lit("y")})
    got = {r.conv_id: tuple(r)[1:] for r in V.repair(V.damage(df)).collect()}
    assert got == plain_repair(damaged(rows))
    assert V.repair(V.damage(df.limit(0))).count() == 0


def test_conversation_that_loses_all(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = V.repair(V.damage(spark.createDataFrame([(lost, 0, "user", "a.")], TURNS))).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_long_conversation_and_shared_endings(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(6_000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for c in range(2, 40) for t in range(c)]
    got = {r.conv_id: r for r in V.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1].cost == 0 and got[1].audit == "K" * 6_000
    assert got[1].repaired_sha256 == sha("\n".join(f"{r}:{x}" for c, _, r, x in rows if c == 1))
    assert {(got[c].cost, got[c].audit) for c in range(3, 40, 2)} == {(2, "K" * k + "D") for k in range(2, 40, 2)}


def test_suffixes_are_shared():
    g = random.Random(2)
    words = sorted({"".join(g.choice("suaxSUAXd") for _ in range(g.randrange(9))) for _ in range(400)})
    whole = list(V.suffix_audits(words))
    alone = [next(iter(V.suffix_audits([w]))) for w in words]
    assert whole == alone
