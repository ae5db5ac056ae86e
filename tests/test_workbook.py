"""Workbooks: pieces, checksums, and reading back."""

import io
import random
import zipfile
import zlib

from docledger.sources import workbook as B


def test_checksums_combine():
    g = random.Random(1)
    for _ in range(50):
        a, b = g.randbytes(g.randrange(90)), g.randbytes(g.randrange(3_000))
        assert B.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_round_trip_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 300)
    rows = [(f"D{k % 3}", k, f"text {k} <&> \x01é\r\n東京 ", None if k % 4 else "", k / 2) for k in range(200)]
    one = spark.createDataFrame(rows, "doc string, n long, t string, u string, x double").repartition(7)
    two = one.where("n % 50 = 3 and doc <> 'D1'")
    folder = f"file://{tmp_path}/books"
    written = B.write_workbooks({"All": (one, ["n", "t", "u", "x"], ["n"]), "Few": (two, ["t"], ["n"])}, folder, {"All": "note"}).collect()
    assert {r.doc: r.bytes for r in written} == {f"D{k}": (tmp_path / "books" / f"D{k}.xlsx").stat().st_size for k in range(3)}
    got = {}
    for r in B.read_workbooks(spark, folder).collect():
        got[r.doc, r.sheet, r.row] = r.cells
    for d in range(3):
        own = sorted(r for r in rows if r[0] == f"D{d}")
        want = [["note"], ["n", "t", "u", "x"]] + [[str(n), t.replace("\x01", ""), u, str(x)] for _, n, t, u, x in own]
        assert [got[f"D{d}", "All", k + 1] for k in range(len(want))] == want
        few = [] if d == 1 else [[t.replace("\x01", "")] for _, n, t, _, _ in own if n % 50 == 3]
        assert [v for k, v in sorted(got.items()) if k[:2] == (f"D{d}", "Few")] == [["t"], *few]
        package = zipfile.ZipFile(io.BytesIO((tmp_path / "books" / f"D{d}.xlsx").read_bytes()))
        assert package.testzip() is None and len(package.namelist()) == 6
