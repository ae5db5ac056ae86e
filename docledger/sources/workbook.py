"""Workbooks (XLSX) of one document each, written in parts by many tasks, and read back.

A sheet's rows are ranged in their order; each task writes its ranges as XML and compresses them to pieces that end on a byte and know
nothing of each other, with the checksum and length of what they hold. A workbook is then joined from pieces as they are:
checksums combine, and nothing is unpacked or held as a whole. Sizes follow their entry, so entries are written as they come.
"""

import io
import re
import struct
import zipfile
import zlib
from functools import cache
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.sources import scratch

#: Bytes of XML in a piece, about.
PIECE = 1 << 20
#: Namespaces of the format, and characters that XML can't hold.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_BAD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


@cache
def _shift(k: int) -> list[int]:
    """What 2 ** k zero bits behind a string do to its checksum."""
    if k == 0:
        return [0xEDB88320] + [1 << i for i in range(31)]
    return [_times(_shift(k - 1), v) for v in _shift(k - 1)]


def combined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one behind the other, of their own and the second's length."""
    k = 3
    while first and length:
        if length & 1:
            first = _times(_shift(k), first)
        length, k = length >> 1, k + 1
    return first ^ second


def _row(values: list) -> str:
    """A row of a sheet; its number is its place."""
    cells = []
    for v in values:
        if v is None:
            cells.append("<c/>")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f"<c><v>{v}</v></c>")
        else:
            cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)), {chr(13): "&#13;"})}</t></is></c>')
    return f"<row>{''.join(cells)}</row>"


class _Deflated:
    """A raw deflate stream in pieces; each can follow any other."""

    def __init__(self):
        self.crc = self.raw = 0

    def piece(self, text: str) -> bytes:
        raw = text.encode()
        self.crc, self.raw = combined(self.crc, zlib.crc32(raw), len(raw)), self.raw + len(raw)
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        return pack.compress(raw) + pack.flush(zlib.Z_FULL_FLUSH)

    def follow(self, crc: int, raw: int) -> None:
        self.crc, self.raw = combined(self.crc, crc, raw), self.raw + raw


def pieces(sheet: DataFrame, name: str, at: int, columns: list[str], order: list[str]) -> DataFrame:
    """(doc, sheet, at, part, seq, crc, raw, data) of a sheet's rows (doc and columns), in their order within each document."""

    def run(batches):
        part, seq, doc, rows, size = TaskContext.get().partitionId(), 0, None, [], 0

        def piece():
            nonlocal seq, rows, size
            out = _Deflated()
            data = out.piece("".join(rows))
            seq, rows, size = seq + 1, [], 0
            return pa.record_batch({"doc": [doc], "sheet": [name], "at": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "crc": pa.array([out.crc], pa.int64()), "raw": pa.array([out.raw], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for of, *values in zip(*[batch[c].to_pylist() for c in ("doc", *columns)], strict=True):
                if rows and (of != doc or size > PIECE):
                    yield piece()
                doc = of
                rows.append(_row(values))
                size += len(rows[-1])
        if rows:
            yield piece()

    rows = sheet.select("doc", *[F.col(c) for c in dict.fromkeys([*columns, *order])])
    rows = rows.repartitionByRange("doc", *order).sortWithinPartitions("doc", *order).select("doc", *columns)
    return rows.mapInArrow(run, "doc string, sheet string, at int, part int, seq int, crc long, raw long, data binary")


class _Package:
    """A zip written in one go: each entry's sizes follow it."""

    def __init__(self, out):
        self.out, self.at, self.entries, self.now = out, 0, [], None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> _Deflated:
        self.now = (name.encode(), self.at, _Deflated())
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0x808, 8, 0, 33, 0, 0, 0, len(self.now[0]), 0) + self.now[0])
        self.body = self.at
        return self.now[2]

    def add(self, data: bytes) -> None:
        self._write(data)

    def close(self) -> None:
        name, start, packed = self.now
        self._write(b"\x03\x00")  # an empty last block
        size = self.at - self.body
        self._write(struct.pack("<IIII", 0x08074B50, packed.crc, size, packed.raw))
        self.entries.append((name, start, packed.crc, size, packed.raw))

    def whole(self, name: str, text: str) -> None:
        packed = self.open(name)
        self.add(packed.piece(text))
        self.close()

    def finish(self) -> None:
        start = self.at
        for name, at, crc, size, raw in self.entries:
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0x808, 8, 0, 33, crc, size, raw, len(name), 0, 0, 0, 0, 0, at) + name)
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(self.entries), len(self.entries), self.at - start, start, 0))


def _frame(package: _Package, names: list[str]) -> None:
    """The parts of a workbook beside its sheets."""
    numbered = list(enumerate(names, 1))
    package.whole("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i, _ in numbered) + "</Types>")
    package.whole("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    package.whole("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in numbered) + "</sheets></workbook>")
    package.whole("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered) + "</Relationships>")


def write_workbooks(sheets: dict[str, tuple[DataFrame, list[str], list[str]]], folder: str, notes: dict[str, str] | None = None) -> DataFrame:
    """Write a workbook for each document into a folder that all executors share (a URI); returns (doc, bytes).

    sheets: name to (rows with doc, columns, order). Every sheet begins with a note, if it has one, and the names of its columns; every
    workbook has all sheets. A workbook is written under a name of its attempt and then moved.
    """
    names = list(sheets)
    tops = {n: ([_row([notes[n]])] if notes and n in notes else []) + [_row(columns)] for n, (_, columns, _) in sheets.items()}
    found = None
    for at, (name, (rows, columns, order)) in enumerate(sheets.items()):
        part = pieces(rows, name, at, columns, order)
        found = part if found is None else found.unionByName(part)
    found = scratch.written(found)

    def run(batches):
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        attempt, doc, package, at, stream = TaskContext.get().taskAttemptId(), None, None, -1, None

        def sheet_until(upto: int) -> None:
            """Close the open sheet and write those without rows up to this one, which is opened."""
            nonlocal at
            while at < upto:
                if at >= 0:
                    package.add(package.now[2].piece("</sheetData></worksheet>"))
                    package.close()
                at += 1
                if at < len(names):
                    packed = package.open(f"xl/worksheets/sheet{at + 1}.xml")
                    package.add(packed.piece(f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetData>' + "".join(tops[names[at]])))

        def end():
            sheet_until(len(names))
            package.finish()
            stream.close()
            store.move(f"{path}/.{doc}.{attempt}", f"{path}/{doc}.xlsx")
            return pa.record_batch({"doc": [doc], "bytes": pa.array([package.at], pa.int64())})

        for batch in batches:
            for of, sheet, crc, raw, data in zip(*[batch[c].to_pylist() for c in ("doc", "at", "crc", "raw", "data")], strict=True):
                if of != doc:
                    if package:
                        yield end()
                    doc, at = of, -1
                    stream = store.open_output_stream(f"{path}/.{doc}.{attempt}", compression=None)
                    package = _Package(stream)
                    _frame(package, names)
                sheet_until(sheet)
                package.add(data)
                package.now[2].follow(crc, raw)
        if package:
            yield end()

    rows = found.repartition("doc").sortWithinPartitions("doc", "at", "part", "seq")
    return scratch.written(rows.mapInArrow(run, "doc string, bytes long"))


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, sheet, row, cells) of the workbooks below a folder; rows count from 1, cells are texts, null where a cell is empty."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                package = zipfile.ZipFile(io.BytesIO(content.as_py()))
                names = [x.get("name") for x in ET.fromstring(package.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]
                for i, name in enumerate(names, 1):
                    rows, number = [], 0
                    for _, x in ET.iterparse(package.open(f"xl/worksheets/sheet{i}.xml")):
                        if x.tag == f"{{{MAIN}}}row":
                            number += 1
                            rows.append((number, [None if c.find(f".//{{{MAIN}}}t") is None and c.find(f"{{{MAIN}}}v") is None else "".join(c.itertext()) for c in x]))
                            x.clear()
                            if len(rows) == 5_000:
                                yield table(path, name, rows)
                                rows = []
                    if rows:
                        yield table(path, name, rows)

    def table(path, name, rows):
        doc = path.rsplit("/", 1)[-1].removesuffix(".xlsx")
        return pa.record_batch({"doc": [doc] * len(rows), "sheet": [name] * len(rows), "row": pa.array([r[0] for r in rows], pa.int64()), "cells": pa.array([r[1] for r in rows], pa.list_(pa.string()))})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content").mapInArrow(run, "doc string, sheet string, row long, cells array<string>")
