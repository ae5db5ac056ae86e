"""Structured documents: sections, rules, versions, packages and the log stream, on small fixtures."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docledger.functions import numeric as N
from docledger.functions import text as T
from docledger.functions.plain import to_plain_text
from docledger.operators import export, fidelity, graph
from docledger.operators import registry as R
from docledger.operators import structure as S
from docledger.operators import vault as vault_ops
from docledger.operators import versions as V
from docledger.plans.driver_queries import numeric_unit_tokens
from docledger.plans.rules import as_json, exit_code, in_order, report, schema_faults, validate
from docledger.sources import docx, sections
from docledger.streaming import log


def test_numeric_grammar():
    tokens = lambda t: [(x["value"], x["unit"], x["range"]) for x in N.tokens_of(t, frozenset(map(T.ws_normalized, N.UNITS)))]
    assert tokens("wait 50 ms.") == [("50", "ms", False)]
    assert tokens("0–100 %") == [("0", "%", True), ("100", "%", True)]
    assert tokens("see section 3.2, §4.1, Table 3.1 and SYS-000120 or A1B-000120") == []
    assert tokens("note 50 ms, Table 3, [[SYS-000999#^sys-000998|takes 7 s]]") == [("50", "ms", False), ("3", None, False), ("7", "s", False)]
    assert tokens("10 ms – 20 ms, ±5 %, −3 °C, 1e999999999 V") == [("10", "ms", True), ("20", "ms", True), ("±5", "%", False), ("-3", "°C", False), ("1e999999999", "V", False)]
    assert tokens("5 µs or 1,000.50 kV") == [("5", T.ws_normalized("µs"), False), ("1000.5", "kV", False)]
    assert tokens("Sig2 10 things") == [("10", None, False)]
    assert tokens("10 mV, 10 MV")[0] != tokens("10 mV, 10 MV")[1]


def test_numbers_of_sections_in_links():
    tokens = lambda t: [(x["value"], x["unit"]) for x in N.tokens_of(t, frozenset(N.UNITS))]
    assert tokens("as in [[S1-000002|5.1 Signal thresholds]] and [[S1-000003|3 Limits of 7 V]]") == [("7", "V")]
    assert tokens("[[S1-000002|5.1]] [[S1-000002|50 ms]] [[S1-000002|2.5 kV]] [[S1-000002|4.]]") == [("50", "ms"), ("2.5", "kV")]


def test_escapes_are_text(spark):
    rows = [("paragraph", r"a \| b \* c **bold \* d** \\ *it* \_x\_ [[S1-000001|see \*]]", None), ("table", "| a \\| b | c |\n|---|---|\n| \\* | 2 |", "pipe"), ("heading", r"## 1.2 A \* B", None), ("list", "- über *größe*\n- 東京 \\# 1", None), ("paragraph", "**" + "x" * 20_000 + "** ****", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "type string, content string, form string").select(to_plain_text(F.col("type"), F.col("content"), F.col("form"))).collect()]
    assert got == [r"a | b * c bold * d \ it _x_ see *", "a | b | c\n* | 2", "1.2 A * B", "- über größe\n- 東京 # 1", "x" * 20_000 + " ****"]


def test_chains_and_groups(spark):
    styles = [("d", k, k - 1, 4 if k == 0 else None) for k in range(1, 5_000)] + [("d", 0, 77, 4), ("e", 1, 2, None), ("e", 2, 3, None), ("e", 3, 1, None), ("e", 4, 3, None), ("e", 5, 99, None), ("e", 6, 6, 8), ("e", 7, None, None), ("e", 6, 6, 8)]
    got = {(r.doc, r.style_id): (r.num_id, r.circular) for r in S.style_numbering(spark.createDataFrame(styles, "doc string, style_id int, based_on int, num_id int").withColumn("ilvl", F.lit(0)), "doc").collect()}
    assert all(got["d", k] == (4, False) for k in range(5_000))
    assert {k[1]: v for k, v in got.items() if k[0] == "e"} == {1: (None, True), 2: (None, True), 3: (None, True), 4: (None, True), 5: (None, False), 6: (8, False), 7: (None, False)}
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1002, 1001), (5, 5), (7, 3), (7, 3)]
    roots = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert roots == {k: 0 for k in range(301)} | {k: 1000 for k in (1000, 1001, 1002)}
    assert graph.connected(spark.createDataFrame([], "a int, b int")).count() == 0


def test_report_and_json(spark):
    findings = spark.createDataFrame([("S1-000001", "V10", "warn", "S1-000002", 'number changed: "1" -> "2"', "1", "2"), ("S1-000001", "V05", "error", "S1-000001", 'say "x"', None, None)], "file string, rule string, severity string, block_id string, message string, old string, new string")
    impact = spark.createDataFrame([("S1-000001", "S1-000300", "S1-000002"), ("S1-000001", "S1-000200", "S1-000002")], "file string, source string, target string")
    lines = [r.line for r in in_order(report(findings, 4, impact, "v0")).collect()]
    assert lines == ["S1-000001.md", '  V05   error  S1-000001  say "x"', '  V10   warn   S1-000002  number changed: "1" -> "2"', "Summary: 1 errors, 1 warnings, 4 files checked, base=v0", "Affected by inbound references: S1-000200, S1-000300"]
    parsed = sorted((json.loads(r.json) for r in as_json(findings).collect()), key=lambda x: x["rule"])
    assert parsed == [{"file": "S1-000001", "rule": "V05", "severity": "error", "block_id": "S1-000001", "message": 'say "x"', "old": None, "new": None}, {"file": "S1-000001", "rule": "V10", "severity": "warn", "block_id": "S1-000002", "message": 'number changed: "1" -> "2"', "old": "1", "new": "2"}]


def test_ratio():
    assert T.indel_ratio("abcd", "abxd") == pytest.approx(2 * 3 / 8)
    assert T.indel_ratio("", "") == 1 and T.common_subsequence("ABCBDAB", "BDCABA") == 4


def test_paths_follow_a_stack(spark):
    import random

    random.seed(2)
    rows = [(d, i, f"{d}-{i}", random.randint(1, 4)) for d in range(5) for i in range(40)]
    want = {}
    for d in range(5):
        stack = []
        for _, _, name, level in [r for r in rows if r[0] == d]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[name] = [x[0] for x in stack]
            stack.append((name, level))
    got = S.paths(spark.createDataFrame(rows, "doc int, at int, id string, level int"), "doc", ["at"])
    assert {r.id: r.path_ids for r in got.collect()} == want


def test_list_numbers_begin_anew(spark):
    rows = [(i, v) for i, v in enumerate([0, 1, 1, 0, 1, 2, 2, 1, 2])]
    got = S.list_numbers(spark.createDataFrame(rows, "at int, ilvl int").withColumn("g", F.lit(1)), ["g"], ["at"], 3).orderBy("at")
    assert [".".join(map(str, r.counters)) for r in got.collect()] == ["1", "1.1", "1.2", "2", "2.1", "2.1.1", "2.1.2", "2.2", "2.2.1"]


FRONT = 'id: SYS-000100\ndoc: SYS\nnumber: "1"\ntitle: Power\nlevel: 1\norder: 0\npath: ["1"]\npath_ids: ["SYS-000100"]\nbreadcrumb: "SYS > 1 Power"\nbookmarks: []\nrefs_out: ["SYS-000100"]\nblocks: 4\nwords: 14\nsource: {docx: s.docx, paragraphs: [0, 9]}\ningest_version: 1\ngenerated: false'
HEAD = f"---\n{FRONT}\n---\n\n# 1 Power <!-- id:SYS-000100 type:heading -->\n\n"


def vault(spark, tmp_path, name, body, file="SYS-000100"):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    (folder / f"{file}.md").write_text(HEAD + body)
    files = sections.read_files(spark, str(folder))
    split = sections.split_front(files)
    return sections.blocks(split), {"front": sections.front_matter(split), "files": files, "version": 1}


ONE = "<!-- id:SYS-000101 type:paragraph -->\nStarts in 50 ms, see [[SYS-000100]]. ^sys-000101\n\n<!-- id:SYS-000102 type:figure asset:b.png locked:true -->\n![a](b.png)\n\n<!-- id:SYS-000103 type:table format:pipe -->\n| a | b |\n|---|---|\n| 1 | 2 |\n"


def rules(findings):
    return sorted((r.rule, r.block_id) for r in findings.collect())


def test_round_trip(spark, tmp_path):
    found, _ = vault(spark, tmp_path, "a", ONE)
    heads = spark.createDataFrame([("SYS-000100", FRONT)], "file string, front string")
    assert sections.rendered(found, heads).first().text == HEAD + ONE


def test_body_is_split_before_anchors_are_read():
    rows = sections.parse_body("# 1 A <!-- id:S1-000001 type:heading -->\n\nno anchor here\n\n<!-- id:S1-000002 type:code -->\n```c\na\n\nb <!-- id:x type:y -->\n```\n\n<!-- id:S1-000003 type:list ordered:true -->\n- a\n- b\n^s1-000003\n<!-- id:S1-000004 type:paragraph -->\n<!-- id:S1-000005 type:paragraph -->\ntwice\n")
    assert [(r["id"], r["type"], r["n_anchors"], r["content"], r["marker"]) for r in rows] == [
        ("S1-000001", "heading", 1, "# 1 A", None),
        (None, "paragraph", 0, "no anchor here", None),
        ("S1-000002", "code", 1, "```c\na\n\nb <!-- id:x type:y -->\n```", None),
        ("S1-000003", "list", 1, "- a\n- b", "s1-000003"),
        ("S1-000004", "paragraph", 2, "twice", None),
    ]
    assert sections.parse_body(None) == sections.parse_body("\n\n") == []


def test_rules(spark, tmp_path):
    base, ctx = vault(spark, tmp_path, "base", ONE)
    assert rules(validate(base, base, ctx)) == []
    work, ctx = vault(spark, tmp_path, "work", ONE.replace("50 ms", "80 ms").replace("b.png)", "c.png)").replace("| 1 | 2 |", "| 1 |").replace("[[SYS-000100]]", "[[SYS-000999]]"))
    found = validate(base, work, ctx)
    assert rules(found) == [("V05", "SYS-000102"), ("V06", "SYS-000103"), ("V07", "SYS-000101"), ("V10", "SYS-000101"), ("V10", "SYS-000103"), ("V15", None), ("V15", None)]
    assert {r.block_id: r.message for r in found.where("rule = 'V10'").collect()} == {"SYS-000101": 'number changed: "50 ms" -> "80 ms"', "SYS-000103": "numbers removed: [2]  added: []"}
    assert exit_code(found) == 2 and exit_code(unreadable=True) == 3 and exit_code(usage=True) == 4
    merged, ctx = vault(spark, tmp_path, "merged", "<!-- id:SYS-000101 type:paragraph supersedes:SYS-000102,SYS-000103 -->\nStarts in 50 ms, see [[SYS-000100]].\n")
    assert {r for r, _ in rules(validate(base, merged, ctx))} <= {"V09", "V10", "V15"}
    lost, ctx = vault(spark, tmp_path, "lost", "<!-- id:SYS-000101 type:paragraph supersedes:SYS-000777 -->\nStarts in 50 ms, see [[SYS-000100]].\n\n<!-- type:paragraph -->\nnew\n\nwithout\n")
    assert {("V02", None), ("V04", "SYS-000102"), ("V04", "SYS-000103"), ("V04a", "SYS-000101"), ("V11", None)} <= set(rules(validate(base, lost, ctx)))
    assert rules(validate(base, lost, ctx | {"registry": spark.createDataFrame([("SYS-000777",)], "id string")}).where("rule = 'V04a'")) == []
    kinds = {r.id: (r.change, r.old) for r in export.changes(base, merged).collect()}
    assert kinds == {"SYS-000100": ("unchanged", None), "SYS-000101": ("merged", "Starts in 50 ms, see SYS-000100.\n[FIGURE] a\na | b\n1 | 2")}
    # Lineage that base already has says nothing about this edit.
    assert {r.id: r.change for r in export.changes(merged, merged).collect()} == {"SYS-000100": "unchanged", "SYS-000101": "unchanged"}


def test_locked_bytes_and_split_numbers(spark, tmp_path):
    base, _ = vault(spark, tmp_path, "base", ONE + "\n<!-- id:SYS-000104 type:paragraph -->\nIt takes 6 ms and then 7 ms.\n")
    spaces, ctx = vault(spark, tmp_path, "spaces", ONE.replace("![a](b.png)", "![a](b.png) ") + "\n<!-- id:SYS-000104 type:paragraph -->\nIt takes 6 ms.\n\n<!-- id:SYS-000105 type:paragraph split_from:SYS-000104 -->\nThen 99 ms.\n")
    found = {(r.rule, r.block_id): r.message for r in validate(base, spaces, ctx).collect()}
    assert found["V05", "SYS-000102"] == "locked figure block modified"
    # A split is one group: 6 ms stays, 7 ms became 99 ms, whichever part has it.
    assert found["V10", "SYS-000104"] == 'number changed: "7 ms" -> "99 ms"' and ("V10", "SYS-000105") not in found
    moved, ctx = vault(spark, tmp_path, "moved", ONE + "\n<!-- id:SYS-000104 type:paragraph -->\nIt takes 7 ms.\n\n<!-- id:SYS-000105 type:paragraph split_from:SYS-000104 -->\nThen 6 ms.\n")
    pair = validate(base, moved, ctx)
    assert [r for r in rules(pair) if r[0] == "V10"] == []
    lost, ctx = vault(spark, tmp_path, "lost", ONE + "\n<!-- id:SYS-000104 type:paragraph -->\nIt takes 7 ms.\n\n<!-- id:SYS-000105 type:paragraph split_from:SYS-000104 -->\nThen.\n")
    assert [(r.block_id, r.message) for r in validate(base, lost, ctx).where("rule = 'V10'").collect()] == [("SYS-000104", "numbers removed: [6 ms]  added: []")]
    twice, _ = vault(spark, tmp_path, "twice", ONE.replace("50 ms", "50 ms and 50 ms"))
    assert N.numeric_changes(base, twice).where("id = 'SYS-000101'").first().message == "numbers removed: []  added: [50 ms]"


def test_faults_of_files(spark, tmp_path):
    bad = ONE.replace("| 1 | 2 |", "| 1\t| 2 |").replace("format:pipe", "format:grid")
    found, ctx = vault(spark, tmp_path, "bad", bad)
    assert {("V02", "SYS-000103"), ("V16", None)} <= set(rules(validate(found, found, ctx)))
    fenced, ctx = vault(spark, tmp_path, "fenced", ONE + "\n<!-- id:SYS-000104 type:code -->\n```c\n\tx\n```\n")
    assert "V16" not in {r for r, _ in rules(validate(fenced, fenced, ctx))}
    (tmp_path / "bad" / "SYS-000100.md").write_text((HEAD + ONE).replace("level: 1", "level: 9").replace("words: 14", "words: 15\nextra: 1").replace("doc: SYS\n", ""))
    front = sections.front_matter(sections.split_front(sections.read_files(spark, str(tmp_path / "bad"))))
    assert sorted(r.key for r in schema_faults(front).collect()) == ["doc", "extra", "level"]


def test_plain_text(spark):
    rows = [
        ("heading", "## 3.2 Braking <!-- id:S1-000001 type:heading -->", None, "3.2 Braking"),
        ("paragraph", "a **b** *c* `d` [[S1-000001|the rest]] [[S1-000001#^s1-000002]]", None, "a b c d the rest S1-000001#^s1-000002"),
        ("list", "- a\n  1. b", None, "- a\n  1. b"),
        ("table", "| a | b \\| c |\n|:--|--:|\n| 1 | 2 |", "pipe", "a | b | c\n1 | 2"),
        ("table", "<table><tr><td>a<br>b</td><td>c</td></tr><tr><th>d</th></tr></table>", "html", "a b | c\nd"),
        ("figure", "![alt](x.png)\n*The caption*", None, "[FIGURE] The caption"),
        ("formula", "$$x = 1$$", "latex", "x = 1"),
        ("formula", "![alt](x.png)", "image", "[FORMULA] alt"),
        ("code", "```c\nint a;\n\nb\n```", None, "int a;\n\nb"),
        ("raw", "text [[as it is]]", None, "text [[as it is]]"),
    ]
    table = spark.createDataFrame(rows, "kind string, content string, form string, want string")
    for r in table.select("want", to_plain_text(F.col("kind"), F.col("content"), F.col("form")).alias("got")).collect():
        assert r.got == r.want


def test_words_count_cjk_apart(spark):
    texts = ["one, two -- 3", "漢字 ab漢", "", "漢字漢字漢", "… ab"]
    assert [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("n")).collect()] == [3, 1 + 2, 0, 2, 1]


def test_registry(spark, tmp_path):
    found, ctx = vault(spark, tmp_path, "a", ONE)
    entries = R.entries_of(found, vault_ops.sections(found, ctx["front"]), "v0")
    assert {r.id: r.key for r in entries.collect()}["SYS-000102"].startswith("SYS-000100|figure|0|")
    text = R.registry_text(entries.withColumns({"doc_key": F.lit("SYS"), "next": F.lit(104)})).first().text
    assert json.dumps(json.loads(text), sort_keys=True, indent=2, ensure_ascii=False) + "\n" == text
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids" / "ids.json").write_text(text)
    again = R.read_registry(spark, str(tmp_path / "ids"))
    assert sorted(map(str, again.drop("doc_key", "next").select(*entries.columns).collect())) == sorted(map(str, entries.collect()))
    work, _ = vault(spark, tmp_path, "b", "<!-- id:SYS-000201 type:paragraph split_from:SYS-000101 -->\na\n\n<!-- id:SYS-000202 type:paragraph split_from:SYS-000101 -->\nb\n\n<!-- id:SYS-000203 type:paragraph supersedes:SYS-000102 -->\nc\n")
    after = R.updated(entries, work, "v1")
    states = {r.id: (r.status, r.merged_into, r.split_into, r.last_seen) for r in after.collect()}
    assert states == {"SYS-000100": ("active", None, None, "v1"), "SYS-000101": ("split", None, ["SYS-000201", "SYS-000202"], "v0"), "SYS-000102": ("merged", "SYS-000203", None, "v0"), "SYS-000103": ("active", None, None, "v0")}
    gone = R.updated(after, work, "v2", allow_delete=True)
    assert gone.where("id = 'SYS-000103'").first().status == "deleted" and R.broken_states(after, gone).count() == 0
    assert [tuple(r) for r in R.broken_states(after, gone.withColumn("status", F.lit("active"))).orderBy("id").collect()] == [("SYS-000101", "split", "active"), ("SYS-000102", "merged", "active")]


def test_word_package(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, pr="": f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("Contents", '<w:pStyle w:val="TOC1"/>') + "<w:p><w:ins><w:r><w:t>kept </w:t></w:r></w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>text</w:t></w:r></w:p>" + f"<w:sdt><w:sdtContent>{p('inside')}</w:sdtContent></w:sdt>" + p("item", '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr>') + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "x.docx").write_bytes(data.getvalue())
    (tmp_path / "y.docx").write_bytes(b"no zip")
    rows = docx.read_docx(spark, str(tmp_path)).orderBy("para_idx").collect()
    assert [(r.kind, r.text, r.in_toc) for r in rows if r.kind != "broken"] == [("heading", "Title", False), ("paragraph", "Contents", True), ("paragraph", "kept text", False), ("paragraph", "inside", False), ("list", "item", False), ("table", "a\nb", False)]
    assert sum(r.kind == "broken" for r in rows) == 1
    assert [len(r.cells) for r in rows if r.kind == "table"] == [2]


def test_formatting_twice_changes_nothing(spark, tmp_path):
    body = ONE.replace(" ^sys-000101", "").replace("format:pipe", "locked:false format:pipe") + "\n<!-- id:SYS-000104 type:paragraph -->\nsee [[SYS-000100#^sys-000102]] ^sys-000104\n"
    found, ctx = vault(spark, tmp_path, "a", body)
    once = vault_ops.formatted_files(found, ctx["front"])
    text = once.first().text
    assert "^sys-000102" in text and "^sys-000104" not in text and "format:pipe locked:false" in text and "blocks: 5" in text
    assert vault_ops.changed_files(ctx["files"], once).count() == 1
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "SYS-000100.md").write_text(text)
    files = sections.read_files(spark, str(tmp_path / "b"))
    split = sections.split_front(files)
    again = vault_ops.formatted_files(sections.blocks(split), sections.front_matter(split))
    assert again.first().text == text and vault_ops.changed_files(files, again).count() == 0
    assert {r.rule for r in validate(found, sections.blocks(split), {"front": sections.front_matter(split), "files": files, "version": 1}).collect()} <= {"V04"}


def test_assets(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{k}.png", bytes([k]) * k) for k in range(1, 5)], "asset string, bytes binary")
    assert sorted(map(tuple, sections.write_assets(rows, f"file://{tmp_path}/assets").collect())) == [(f"a{k}.png", k) for k in range(1, 5)]
    assert sorted(r.asset for r in sections.asset_names(spark, f"{tmp_path}/assets").collect()) == [f"a{k}.png" for k in range(1, 5)]
    assert (tmp_path / "assets" / "a3.png").read_bytes() == b"\x03" * 3


def test_segments_and_summary(spark):
    items = spark.createDataFrame([(0, "heading", 1), (1, "paragraph", None), (2, "heading", 3), (3, "heading", 2), (4, "paragraph", None)], "at int, kind string, level int").withColumn("doc", F.lit("d"))
    assert [r.section_no for r in S.segment(items, "doc", ["at"]).orderBy("at").collect()] == [1, 1, 1, 2, 2]
    old = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, path string")
    new = spark.createDataFrame([("1", "p"), ("2", "r"), ("3", "q")], "row string, path string")
    met = spark.createDataFrame([("a", "1", 1), ("b", "2", 3)], "old_id string, new_row string, tier int")
    assert tuple(V.rematch_summary(met, old, new).first()) == (2, 1, 1, 1)
    blocks = spark.createDataFrame([("d", 1)], "doc string, para_idx int")
    assert [r.para_idx for r in S.not_captured(spark.createDataFrame([("d", 1), ("d", 2)], "doc string, para_idx int"), blocks, ["doc", "para_idx"]).collect()] == [2]


def test_coverage_documents(spark):
    texts = spark.createDataFrame([("D1", 4, 3, 0.75)], "doc string, source_segments long, segments_covered long, coverage double")
    counts = spark.createDataFrame([("D1", 2, 2, 2, 0)], "doc string, blocks long, tables long, tables_pipe long, tables_html long")
    links = spark.createDataFrame([("D1", 10, 9, 1, 0, 2)], "doc string, found long, resolved_section long, resolved_block long, unresolved long, external long")
    gated = fidelity.gates(texts, counts, links)
    assert tuple(gated.first()) == ("D1", True, True, False, False)
    row = fidelity.coverage_documents(texts, counts, links, gated).first()
    assert json.loads(row.json)["links_found"] == 10 and "| coverage | 0.75 |" in row.markdown and row.markdown.startswith("---\ngenerated: true")


def package(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr("word/" + name.replace("__", "/").replace("_xml", ".xml"), text)


def test_parts_of_a_package(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    run = lambda x: f"<w:r>{x}</w:r>"
    field = lambda k: run(f'<w:fldChar w:fldCharType="{k}"/>')
    text = lambda t: run(f"<w:t>{t}</w:t>")
    page = field("begin") + run("<w:instrText>PAGEREF _Toc1</w:instrText>") + field("separate") + text("3") + field("end")
    toc = [f"<w:p>{field('begin')}{run('<w:instrText>TOC o</w:instrText>')}{field('separate')}{text('one')}{page}</w:p>", f"<w:p>{text('two')}{page}</w:p>", f"<w:p>{text('three')}{page}{field('end')}</w:p>"]
    marked = f'<w:p><w:bookmarkStart w:name="_Ref1"/>{text("body")}<w:hyperlink w:anchor="_Ref1">{text("there")}</w:hyperlink><w:hyperlink r:id="r1">{text("out")}</w:hyperlink>{run("<w:instrText> REF _Ref2 h</w:instrText>")}</w:p>'
    changed = f'<w:p><w:ins>{text("new")}</w:ins><w:del>{run("<w:delText>old</w:delText>")}</w:del><w:r><w:commentReference/></w:r><w:r><w:drawing><a:blip r:embed="r2"/></w:drawing></w:r></w:p>'
    levels = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1%2"/><w:lvlRestart w:val="0"/></w:lvl>'
    package(
        tmp_path / "x.docx",
        document_xml=f"<w:document {ns}><w:body>{''.join(toc)}{marked}{changed}</w:body></w:document>",
        header1_xml=f"<w:hdr {ns}><w:p>{text('head')}</w:p></w:hdr>",
        footnotes_xml=f"<w:footnotes {ns}><w:footnote><w:p>{text('note')}</w:p></w:footnote></w:footnotes>",
        numbering_xml=f'<w:numbering {ns}><w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num></w:numbering>',
        styles_xml=f'<w:styles {ns}><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="2"/></w:numPr></w:pPr></w:style></w:styles>',
    )
    with zipfile.ZipFile(tmp_path / "x.docx", "a") as z:
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="http://x/"/><Relationship Id="r2" Target="media/i1.png"/></Relationships>')
        z.writestr("word/media/i1.png", "bytes")
    at = str(tmp_path)
    rows = [(r.part, r.kind, r.text, r.skip) for r in docx.read_docx(spark, at).collect()]
    assert rows == [("body", "paragraph", "one3", "toc"), ("body", "paragraph", "two3", "toc"), ("body", "paragraph", "three3", "toc"), ("body", "paragraph", "bodythereout", None), ("body", "paragraph", "new", None), ("body", "figure", None, None), ("footnotes", "footnote", "note", None), ("header", "paragraph", "head", "header_footer")]
    assert tuple(docx.read_revisions(spark, at).first())[1:] == (1, 1, 1)
    assert [(r.kind, r.target, r.display) for r in docx.read_links(spark, at).collect()] == [("bookmark", "_Ref1", None), ("internal", "_Ref1", "there"), ("external", "http://x/", "out"), ("internal", "_Ref2", None)]
    assert [(r.name, bytes(r.bytes)) for r in docx.read_media(spark, at).collect()] == [("i1.png", b"bytes")]
    numbering = docx.read_numbering(spark, at)
    assert [tuple(r)[1:] for r in numbering.collect()] == [(2, 0, "upperRoman", "%1.", 1, None, 4), (2, 1, "lowerLetter", "%1%2", 1, 0, None)]
    items = spark.createDataFrame([(k, "A" if k % 2 else "C", None if k % 2 else 2, None if k % 2 else 0) for k in range(6)], "at int, style_id string, num_id int, ilvl int").join(numbering.select("file").distinct())
    found = S.effective_numbering(items, docx.read_styles(spark, at), "file")
    numbers = S.numbered(found, numbering, "file", ["at"]).orderBy("at").collect()
    assert [r.number for r in numbers] == ["IV.", "IVa", "V.", "Vb", "VI.", "VIc"]


def test_log_file(spark, tmp_path):
    line = "| 2026-09-24T14:12+07:00 | a1b2c3d | SYS-000120 | restructure-section | m | split step 3 \\| in two | mod=5 new=1 del=0 | numeric: none |"
    head = "| time | sha | section | skill | model | rationale | counts | numeric |\n|---|---|---|---|---|---|---|---|\n"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "log.md").write_text(f"---\ngenerated: true\n---\n\n{head}{line}\n")
    rows = log.read_rows(spark, str(tmp_path / "log"))
    one = rows.first()
    assert (one.sha, one.section_id, one.rationale, one.counts, one.numeric) == ("a1b2c3d", "SYS-000120", "split step 3 | in two", {"mod": 5, "new": 1, "del": 0}, "none")
    log.append_rows(rows, str(tmp_path / "log"))
    assert (tmp_path / "log" / "log.md").read_text().endswith(f"{line}\n")
    again = log.read_rows(spark, str(tmp_path / "log")).collect()
    assert len(again) == 2 and again[0] == again[1]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-0{d}T10:00:00", "section_id": s, "skill": "x", "changed": 2} for d in (1, 1, 2) for s in ("a", "b")]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    query = log.daily_changes(log.read_log(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.section_id, r.rows, r.changed) for r in spark.table("changes").collect()) == [("a", 1, 2), ("a", 2, 4), ("b", 1, 2), ("b", 2, 4)]


def test_similarity_is_the_ratio(spark):
    rows = spark.createDataFrame([("abcd", "ab"), ("abcd", "abcd"), ("", "x"), ("", ""), (None, "x")], "a string, b string")
    assert [r.s for r in rows.select(T.similarity("a", "b").alias("s")).collect()] == [4 / 6, 1.0, 0.0, 1.0, None]


def test_digits_of_other_scripts_give_tokens(spark, tmp_path):
    rows = [(1, "takes \uff15\uff10 ms"), (2, "\u0663 V"), (3, "none"), (4, None), (5, "7 A")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.unit) for r in numeric_unit_tokens(spark, str(tmp_path)).collect()) == [(1, "ms"), (2, "V"), (5, "A")]
