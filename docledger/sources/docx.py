"""Word packages: the block stream of their documents, skips and revisions, numbering, styles, bookmarks, links and media."""

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
ITEM = "file string, part string, skip string, para_idx int, item_seq int, kind string, outline_level int, num_id int, ilvl int, style_id string, revision string, in_toc boolean, text string, cells array<struct<row:int,col:int,grid_span:int,v_merge:string,n_paras:int,nested:boolean,text:string>>, xml string, embed string"
LEVEL = "num_id int, ilvl int, num_fmt string, lvl_text string, start int, lvl_restart int, start_override int"
STYLE = "style_id string, based_on string, num_id int, ilvl int"
IMAGE = "embed string, name string, bytes binary"
LINK = "para_idx int, kind string, target string, display string, at int"


def _attr(node, path: str, name: str = "val"):
    found = node.find(path.replace("w:", W)) if node is not None else None
    return None if found is None else found.get(f"{W}{name}")


def _texts(node) -> str:
    """Visible text: insertions stay, deletions go, one branch of alternatives is read."""
    if node.tag in (f"{W}del", f"{W}delText", f"{W}instrText", f"{MC}Fallback"):
        return ""
    if node.tag in (f"{W}t", f"{M}t"):
        return node.text or ""
    if node.tag in (f"{W}tab", f"{W}br"):
        return " "
    return "".join(_texts(c) for c in node)


def _cells(t) -> list[dict]:
    """The cells of a table; raises ValueError where their spans are no numbers or rows have none."""
    cells = []
    for r, row in enumerate(t.findall(f"{W}tr")):
        for c, cell in enumerate(row.findall(f"{W}tc")):
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            cells.append({"row": r, "col": c, "grid_span": int(_attr(cell, "w:tcPr/w:gridSpan") or 1), "v_merge": None if merge is None else merge.get(f"{W}val") or "continue", "n_paras": len(cell.findall(f"{W}p")), "nested": cell.find(f".//{W}tbl") is not None, "text": " ".join(_texts(cell).split())})
    if not cells:
        raise ValueError("a table without cells")
    return cells


def walk(body, seen=None) -> list[dict]:
    """Items of a body in document order; unknown containers are entered. seen(node, para_idx) is called for each paragraph and table.

    xml is the element itself where no other form holds all of it: tables whose cells can't be read, and drawn objects.
    """
    out: list[dict] = []
    # A contents list is a field; others, such as page references, may stand inside of it.
    state = {"para": -1, "fields": [], "simple": False}

    def paragraph(p, revision):
        state["para"] += 1
        if seen:
            seen(p, state["para"])
        style = _attr(p, "w:pPr/w:pStyle")
        in_toc = "toc" in state["fields"] or state["simple"] or bool(style and style.upper().replace(" ", "").startswith("TOC") and style[3:].strip().isdigit())
        for x in (x for x in p.iter() if x.tag in (f"{W}fldChar", f"{W}instrText", f"{W}fldSimple")):
            what = x.get(f"{W}fldCharType")
            toc = (x.text if x.tag == f"{W}instrText" else x.get(f"{W}instr") or "").strip().upper().startswith("TOC")
            if what == "begin":
                state["fields"].append("")
            elif what == "end" and state["fields"]:
                state["fields"].pop()
            elif toc and x.tag == f"{W}instrText" and state["fields"]:
                state["fields"][-1] = "toc"
            in_toc = in_toc or toc
        level = _attr(p, "w:pPr/w:outlineLvl")
        if level is None and style and style.lower().startswith("heading") and style[7:].strip().isdigit():
            level = int(style[7:]) - 1
        num, ilvl = _attr(p, "w:pPr/w:numPr/w:numId"), _attr(p, "w:pPr/w:numPr/w:ilvl")
        text = _texts(p)
        base = {"para_idx": state["para"], "style_id": style, "revision": revision, "in_toc": in_toc, "skip": "toc" if in_toc else None, "text": text}
        if p.find(f"{W}pPr/{W}rPr/{W}del") is not None and not text:
            out.append(base | {"item_seq": 0, "kind": "paragraph", "revision": "del"})
            return
        seq = 0
        if text.strip():
            kind = "heading" if level is not None else "list" if num is not None else "formula" if p.find(f".//{M}oMathPara") is not None else "paragraph"
            out.append(base | {"item_seq": 0, "kind": kind, "outline_level": None if level is None else int(level) + 1, "num_id": num and int(num), "ilvl": int(ilvl or 0) if num else None})
            seq = 1
        for what, kind in (("drawing", "figure"), ("pict", "shape"), ("object", "shape")):
            for x in p.iter(f"{W}{what}"):
                # The text of a box is in its paragraph's text already.
                image = x.find(f".//{A}blip")
                out.append(base | {"item_seq": seq, "kind": kind, "text": None, "xml": ET.tostring(x, "unicode"), "embed": None if image is None else image.get(f"{R}embed")})
                seq += 1

    def table(t, revision):
        state["para"] += 1
        if seen:
            seen(t, state["para"])
        try:
            cells, xml = _cells(t), None
        except ValueError:
            cells, xml = None, ET.tostring(t, "unicode")
        text = "\n".join(" ".join(_texts(cell).split()) for cell in t.iter(f"{W}tc"))
        out.append({"para_idx": state["para"], "item_seq": 0, "kind": "table", "revision": revision, "in_toc": "toc" in state["fields"], "skip": "toc" if "toc" in state["fields"] else None, "text": text, "cells": cells, "xml": xml})

    def descend(node, revision):
        for child in node:
            if child.tag == f"{W}p":
                paragraph(child, revision)
            elif child.tag == f"{W}tbl":
                table(child, revision)
            elif child.tag == f"{W}ins":
                descend(child, "ins")
            elif child.tag == f"{W}fldSimple" and (child.get(f"{W}instr") or "").strip().upper().startswith("TOC"):
                state["simple"] = True
                descend(child, revision)
                state["simple"] = False
            elif child.tag in (f"{W}del", f"{MC}Fallback", f"{W}sectPr"):
                continue
            else:
                descend(child, revision)

    descend(body, None)
    return out


def _parts(package: zipfile.ZipFile):
    """(name, skip, root of the paragraphs) of the parts that have text, the body first."""
    for name in sorted(package.namelist(), key=lambda n: (n != "word/document.xml", n)):
        found = re.fullmatch(r"word/(document|footnotes|endnotes|header\d*|footer\d*)\.xml", name)
        if found:
            root = ET.fromstring(package.read(name))
            kind = found[1].rstrip("0123456789")
            yield {"document": "body"}.get(kind, kind), "header_footer" if kind in ("header", "footer") else None, root.find(f"{W}body") if kind == "document" else root


def items_of(content: bytes) -> list[dict]:
    """The items of a package's parts; headers and footers are there to be counted."""
    out = []
    for part, skip, root in _parts(zipfile.ZipFile(io.BytesIO(content))):
        found = walk(root)
        if part in ("footnotes", "endnotes"):
            found = [r | {"kind": "footnote"} if r["kind"] == "paragraph" else r for r in found]
        out += [r | {"part": part, "skip": skip or r.get("skip")} for r in found]
    return out


def revisions_of(content: bytes) -> list[dict]:
    """Counts of accepted insertions, discarded deletions and comments of a body."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    n = {k: sum(1 for _ in root.iter(f"{W}{tag}")) for k, tag in (("ins_accepted", "ins"), ("del_discarded", "del"), ("comments_discarded", "commentReference"))}
    return [n]


def numbering_of(content: bytes) -> list[dict]:
    """The levels of each list: format, text, first number, what restarts it and an override of its start."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/numbering.xml"))
    whole = lambda x: None if x is None else int(x)
    abstract = {}
    for a in root.findall(f"{W}abstractNum"):
        abstract[a.get(f"{W}abstractNumId")] = [(int(v.get(f"{W}ilvl")), _attr(v, "w:numFmt"), _attr(v, "w:lvlText"), whole(_attr(v, "w:start")), whole(_attr(v, "w:lvlRestart"))) for v in a.findall(f"{W}lvl")]
    out = []
    for n in root.findall(f"{W}num"):
        over = {int(o.get(f"{W}ilvl")): whole(_attr(o, "w:startOverride")) for o in n.findall(f"{W}lvlOverride")}
        for ilvl, form, text, start, restart in abstract.get(_attr(n, "w:abstractNumId"), []):
            out.append({"num_id": int(n.get(f"{W}numId")), "ilvl": ilvl, "num_fmt": form or "decimal", "lvl_text": text or "", "start": start if start is not None else 1, "lvl_restart": restart, "start_override": over.get(ilvl)})
    return out


def styles_of(content: bytes) -> list[dict]:
    """Each paragraph style with the one it is based on and its own numbering."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/styles.xml"))
    out = []
    for x in root.findall(f"{W}style"):
        num, ilvl = _attr(x, "w:pPr/w:numPr/w:numId"), _attr(x, "w:pPr/w:numPr/w:ilvl")
        out.append({"style_id": x.get(f"{W}styleId"), "based_on": _attr(x, "w:basedOn"), "num_id": num and int(num), "ilvl": ilvl and int(ilvl)})
    return out


def links_of(content: bytes) -> list[dict]:
    """Bookmarks, hyperlinks and reference fields of a body, with the paragraph they stand in; external ones with their address."""
    package = zipfile.ZipFile(io.BytesIO(content))
    relations = {}
    if "word/_rels/document.xml.rels" in package.namelist():
        relations = {x.get("Id"): x.get("Target") for x in ET.fromstring(package.read("word/_rels/document.xml.rels"))}
    out = []

    def seen(node, para_idx):
        row = lambda kind, target, display, at=None: out.append({"para_idx": para_idx, "kind": kind, "target": target, "display": display, "at": at})

        def within(x, at):
            """Emits what stands at x, which has so many characters of the paragraph before it; returns those behind it."""
            if x.tag == f"{W}bookmarkStart":
                row("bookmark", x.get(f"{W}name"), None)
            elif x.tag == f"{W}hyperlink":
                external = x.get(f"{R}id")
                row("external" if external else "internal", relations.get(external) if external else x.get(f"{W}anchor"), _texts(x), at)
            elif x.tag == f"{W}instrText":
                if m := re.match(r"\s*REF\s+(\S+)", x.text or ""):
                    row("internal", m[1], None)
            if x.tag in (f"{W}del", f"{W}delText", f"{W}instrText", f"{MC}Fallback", f"{W}t", f"{M}t", f"{W}tab", f"{W}br"):
                return at + len(_texts(x))
            for c in x:
                at = within(c, at)
            return at

        within(node, 0)

    root = ET.fromstring(package.read("word/document.xml"))
    walk(root.find(f"{W}body"), seen)
    return out


def media_of(content: bytes) -> list[dict]:
    """Images that the body shows, in order, with their bytes."""
    package = zipfile.ZipFile(io.BytesIO(content))
    if "word/_rels/document.xml.rels" not in package.namelist():
        return []
    relations = {x.get("Id"): x.get("Target") for x in ET.fromstring(package.read("word/_rels/document.xml.rels"))}
    out = []
    for at, x in enumerate(ET.fromstring(package.read("word/document.xml")).iter(f"{A}blip")):
        name = f"word/{relations.get(x.get(f'{R}embed'))}"
        if name in package.namelist():
            out.append({"at": at, "name": name.rsplit("/", 1)[-1], "bytes": package.read(name)})
    return out


def images_of(content: bytes) -> list[dict]:
    """The images that a body's relationships name, by the id by which drawings embed them."""
    package = zipfile.ZipFile(io.BytesIO(content))
    relations = ET.fromstring(package.read("word/_rels/document.xml.rels"))
    named = {x.get("Id"): f"word/{x.get('Target')}" for x in relations}
    return [{"embed": key, "name": name.rsplit("/", 1)[-1], "bytes": package.read(name)} for key, name in named.items() if "/media/" in name and name in package.namelist()]


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the packages below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


_BROKEN = (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError)


def _rows(source: DataFrame, rows_of, columns: str, broken: list[dict]) -> DataFrame:
    """A row for each dict that rows_of(bytes) gives of every package (path, content), with its file."""

    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    found = rows_of(content.as_py())
                except _BROKEN:
                    found = broken
                rows += [r | {"file": file} for r in found]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return source.select("path", "content").mapInArrow(run, columns)


def read_package(source: DataFrame) -> DataFrame:
    """(file, item, level, style, link, image) of packages (path, content), each row with one of them: all that ingesting needs, from one reading.

    A part that a package lacks gives no rows; a package that can't be read gives a single item of kind 'broken'.
    """

    def every(content: bytes) -> list[dict]:
        out = [{"item": r} for r in items_of(content)]
        for name, rows_of in (("level", numbering_of), ("style", styles_of), ("link", links_of), ("image", images_of)):
            try:
                out += [{name: r} for r in rows_of(content)]
            except KeyError:
                continue
        return out

    struct = lambda fields: "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", fields) + ">"
    return _rows(source, every, f"file string, item {struct(ITEM.removeprefix('file string, '))}, level {struct(LEVEL)}, style {struct(STYLE)}, link {struct(LINK)}, image {struct(IMAGE)}", [{"item": {"kind": "broken", "in_toc": False}}])


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The items of every package below a path; one that can't be read gives a single item of kind 'broken'."""
    return _rows(packages(spark, path), items_of, ITEM, [{"kind": "broken", "in_toc": False}])


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    return _rows(packages(spark, path), revisions_of, "file string, ins_accepted long, del_discarded long, comments_discarded long", [])


def read_numbering(spark: SparkSession, path: str) -> DataFrame:
    return _rows(packages(spark, path), numbering_of, f"file string, {LEVEL}", [])


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    return _rows(packages(spark, path), styles_of, f"file string, {STYLE}", [])


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return _rows(packages(spark, path), links_of, f"file string, {LINK}", [])


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return _rows(packages(spark, path), media_of, "file string, at int, name string, bytes binary", [])
