"""Ingest of Word packages: forms, links, what is stored and reported, and documents that are split over tasks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docledger.operators import structure as S
from docledger.plans import ingest as I
from docledger.plans.reading_queries import _HEAD, _LEVELS, _NAMES, _package


def zipped(parts: dict) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def run(text: str) -> str:
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def read(spark, packages: dict, **more) -> I.Vault:
    return I.ingest(spark.createDataFrame([(f"x/{k}.docx", v) for k, v in packages.items()], "path string, content binary"), F.regexp_extract("file", r"([^/]+)\.docx$", 1), **more)


BODY = f"""{_HEAD}<w:document {_NAMES}><w:body>
<w:p>{run('before | all')}</w:p>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:bookmarkStart w:name="top"/>{run('Scope')}</w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr></w:pPr>{run('one')}</w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr></w:pPr>{run('two ')}<w:hyperlink w:anchor="mid">{run('there')}</w:hyperlink>{run('!')}</w:p>
<w:p><w:bookmarkStart w:name="mid"/>{run('see ')}<w:hyperlink w:anchor="top">{run('the top')}</w:hyperlink>{run(' and ')}<w:hyperlink r:id="rId9">{run('out')}</w:hyperlink>{run(', not ')}<w:hyperlink w:anchor="none">{run('this')}</w:hyperlink></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p>{run('a &lt; b')}</w:p></w:tc><w:tc><w:p>{run('c')}</w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p>{run('d')}</w:p></w:tc></w:tr></w:tbl>
<w:tbl></w:tbl>
<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins>{run('kept section 3.2')}</w:ins></w:p>
<w:p><w:r><w:pict><w:t>shape</w:t></w:pict></w:r></w:p>
</w:body></w:document>"""
RELS = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="http://x/"/></Relationships>'


@pytest.fixture(scope="module")
def vault(spark):
    whole = zipped({"word/document.xml": BODY, "word/numbering.xml": _LEVELS["numbering"], "word/styles.xml": _LEVELS["styles"], "word/_rels/document.xml.rels": RELS, "word/header1.xml": f"{_HEAD}<w:hdr {_NAMES}><w:p>{run('page')}</w:p></w:hdr>", "word/footnotes.xml": f"{_HEAD}<w:footnotes {_NAMES}><w:footnote><w:p>{run('a note')}</w:p></w:footnote></w:footnotes>", "word/endnotes.xml": f"{_HEAD}<w:endnotes {_NAMES}><w:endnote><w:p>{run('at the end')}</w:p></w:endnote></w:endnotes>"})
    return read(spark, {"AA": whole, "BAD": b"no package"}, first=100)


def test_forms_and_links(vault):
    rows = [(r.id[-3:], r.section_id[-3:], r.type, r.format, r.content, r.marker) for r in vault.blocks.orderBy("at").collect()]
    assert rows == [
        ("100", "100", "heading", "", "# Front matter", None),
        ("101", "100", "paragraph", "", "before | all", None),
        ("102", "102", "heading", "", "# 1 Scope", None),
        ("103", "102", "list", "", "1. one\n2. two [[AA-000102#^aa-000104|there]]!", None),
        ("104", "102", "paragraph", "", "see [[AA-000102|the top]] and [out](http://x/), not this", "aa-000104"),
        ("105", "102", "table", "html", '<table><tr><td rowspan="2">a &lt; b</td><td>c</td></tr><tr><td>d</td></tr></table>', None),
        ("106", "102", "raw", "", "", None),
        ("107", "102", "paragraph", "", "kept section 3.2", None),
        ("108", "102", "paragraph", "", "shape", None),
        ("109", "102", "raw", "", "", None),
        ("110", "102", "paragraph", "", "a note", None),
        ("111", "102", "paragraph", "", "at the end", None),
    ]


def test_nothing_is_lost(vault):
    assert sorted((r.code, r.severity, r.detail) for r in vault.issues.collect()) == [("shape_unrenderable", "warn", "degraded to AA-000109"), ("table_parse_failed", "error", "degraded to AA-000106"), ("textual_ref_candidate", "info", "section 3.2"), ("unresolved_ref", "warn", "none not found")]
    stored = {r.asset: bytes(r.bytes).decode() for r in vault.assets.collect()}
    assert set(stored) == {"AA-000106.xml", "AA-000109.xml"} and "pict" in stored["AA-000109.xml"] and "tbl" in stored["AA-000106.xml"]
    assert [(r.doc, r.code, r.paragraphs, r.chars) for r in vault.skipped.collect()] == [("AA", "header_footer", 1, 4)]
    assert [tuple(r) for r in I.accounts(vault).collect()] == [("AA", 13, 11, 2, 0, 0, 0, True)]
    lost = I.Vault(vault.blocks.where("type <> 'list'"), vault.assets.limit(1), vault.issues.limit(0), vault.skipped, vault.items)
    assert [(r.without_block, r.unstored, r.unreported, r.balanced) for r in I.accounts(lost).collect()] == [(2, 1, 2, False)]


def test_long_document_over_stretches(spark, monkeypatch):
    package = _package(3, [f"word{k} other{k} end" for k in range(200)])
    want = sorted(map(tuple, read(spark, {"D3": package}).blocks.collect()), key=lambda r: r[2])
    monkeypatch.setattr(I, "STRETCH", 5 << 10)
    assert sorted(map(tuple, read(spark, {"D3": package}).blocks.collect()), key=lambda r: r[2]) == want
    assert len(want) > 150


def test_carried_equals_one_window(spark):
    rows = spark.range(300).selectExpr("id % 3 as doc", "id as at", "case when id % 7 = 0 then id end as v").repartition(5)
    got = S.carried(rows, "doc", "at", {"n": F.lit(1)}, {"last": F.col("v")}, 10).collect()
    for r in got:
        before = [i for i in range(r.at + 1) if i % 3 == r.doc]
        assert r.n == len(before) and r["last"] == max((i for i in before if i % 7 == 0), default=None)
