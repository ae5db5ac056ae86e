"""WARC archives: writing with revisits and segments, and reassembly when they are read.

Input: pages with page_id (integer), url and html. The payload is the html in UTF-8; null is empty. Of pages
with equal payloads of at least REVISIT bytes the smallest page_id is a response and the others revisit it.

Defined results: every row gives one record and one row; a null page_id is written as a response of its
own and read back as null; rows that repeat the smallest page_id with its payload are all responses; null urls give
records without a target; other columns are not written.

How: digests meet in one grouping; only the revisits it finds are joined back to the pages. Each task
writes its records, a gzip member each, to archives of about ARCHIVE bytes in the shared folder; its rows
name those archives, so files of lost attempts are never read. HTTP bodies use chunked
framing, and blocks over SEGMENT bytes go on in continuation records. When read, whole records are
decoded where they are; segments are grouped by the identifier of the record they continue,
ordered by number, checked against the total length, and then decoded.
"""

import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

REVISIT = 100
SEGMENT = 32 << 10
FRAME = 8 << 10
ARCHIVE = 8 << 20
PIECE = 16 << 10
#: Bytes of blocks that a task holds before it sends their rows on.
PARSED = 4 << 20

_PAGE = "urn:x-page:"


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + FRAME] for i in range(0, len(body), FRAME)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(headers: dict, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str) -> list[bytes]:
    """The records of a page; place tells it from any other record."""
    origin = f"<{_PAGE}{'' if page_id is None else page_id}#{place}>"
    target = None if url is None else "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
    head = {"WARC-Type": "response", "WARC-Record-ID": origin, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
    if refers_to is not None:
        head |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_PAGE}{refers_to}>", "Content-Type": "application/http; msgtype=response"}
        return [_record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    head["Content-Type"] = "application/http; msgtype=response"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        return [_record(head, block)]
    out = [_record(head | {"WARC-Segment-Number": 1}, parts[0])]
    for number, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{origin[:-1]}.{number}>", "WARC-Date": head["WARC-Date"], "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": number}
        out.append(_record(more | ({"WARC-Segment-Total-Length": len(block)} if number == len(parts) else {}), part))
    return out


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages to archives in folder (a URI that all executors can write to). Returns (archive, n_records)."""
    rows = C.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.where(F.octet_length("html") >= REVISIT).where("page_id is not null").select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"))
    digests = C.materialize(digests)
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = C.materialize(digests.join(first, "digest").where("page_id > refers_to").distinct())
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256))).join(C.sized(revisits, 64), ["page_id", "digest"], "left").drop("digest")

    def write(batches):
        task = TaskContext.get()
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        made, buffer, size, n, number = [], [], 0, 0, 0

        def close():
            nonlocal buffer, size, n
            name = f"part-{task.partitionId()}-{task.taskAttemptId()}-{len(made)}.warc.gz"
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(b"".join(buffer))
            made.append((name, n))
            buffer, size, n = [], 0, 0

        for batch in batches:
            for page, url, html, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                number += 1
                for record in records(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers.as_py(), f"{task.partitionId()}.{number}"):
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    buffer.append(packer.compress(record) + packer.flush())
                    size += len(buffer[-1])
                    n += 1
                if size >= ARCHIVE:
                    close()
        if n:
            close()
        yield pa.record_batch({"archive": pa.array([m[0] for m in made], pa.string()), "n_records": pa.array([m[1] for m in made], pa.int64())})

    return C.materialize(rows.mapInArrow(write, "archive string, n_records long"))


def parse_records(content: bytes):
    """(headers, block) of every record of an archive of gzip members."""
    content, at = memoryview(content), 0
    while at < len(content):
        reader, parts = zlib.decompressobj(31), []
        # In pieces: zlib copies whatever lies behind a member.
        while not reader.eof and at < len(content):
            piece = content[at : at + PIECE]
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        record = b"".join(parts)
        end = record.index(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in record[:end].decode().split("\r\n")[1:])
        yield headers, record[end + 4 : end + 4 + int(headers["Content-Length"])]


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(_PAGE).split("#")[0]
    return int(number) if number else None


def _http(headers: dict, block: bytes, keep: bool) -> dict:
    """What a whole block says; its payload only if it is to be kept. A revisit is verified later, by its response."""
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": _page(headers["WARC-Record-ID"]), "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": _page(headers.get("WARC-Refers-To"))}
    head, _, body = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "revisit":
        return out | {"payload_bytes": int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0]), "verified": False, "payload": None}
    try:
        payload = unchunked(body)
    except ValueError:
        return out | {"payload_bytes": None, "verified": False, "payload": None}
    return out | {"payload_bytes": len(payload), "verified": hashlib.sha256(payload).hexdigest() == digest, "payload": payload if keep else None}


_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())])
_OUT_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def read_archives(spark, folder: str, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and verified of every page in these archives.

    With payloads also payload (binary, null for revisits). Segments that miss a part, or whose length or digest
    is wrong, and revisits whose response isn't there or differs from what they say give a row with verified false.
    """
    if archives.isEmpty():
        return spark.createDataFrame([], _OUT_SQL + (", payload binary" if payloads else ""))
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    files = files.join(C.sized(archives.select("archive"), 60), "archive", "left_semi")
    out = pa.schema([*_OUT, ("payload", pa.binary())]) if payloads else _OUT
    out_sql = _OUT_SQL + ", payload binary" if payloads else _OUT_SQL
    segment = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                rows, origin, size = [], [], 0
                for headers, block in parse_records(content.as_buffer().to_pybytes()):
                    if "WARC-Segment-Number" in headers:
                        total = headers.get("WARC-Segment-Total-Length")
                        rows.append({})
                        origin.append({"origin": headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"]), "number": int(headers["WARC-Segment-Number"]), "total": total and int(total), "digest": headers.get("WARC-Payload-Digest"), "block": block})
                        size += len(block)
                    else:
                        rows.append(_http(headers, block, payloads))
                        origin.append({})
                        size += len(block) if payloads else 0
                    if size >= PARSED or len(rows) >= 10_000:
                        yield table(origin, rows)
                        rows, origin, size = [], [], 0
                yield table(origin, rows)

    def table(origin, rows):
        a, b = pa.RecordBatch.from_pylist(origin, segment), pa.RecordBatch.from_pylist(rows, out)
        return pa.RecordBatch.from_arrays([*a.columns, *b.columns], schema=pa.schema([*segment, *out]))

    def join(batches):
        for batch in batches:
            rows = []
            for origin, parts in zip(batch["origin"].to_pylist(), batch["parts"].to_pylist(), strict=True):
                block = b"".join(p["block"] for p in parts)
                total = next((p["total"] for p in parts if p["total"] is not None), None)
                digest = next((p["digest"] for p in parts if p["digest"]), "")
                row = _http({"WARC-Record-ID": origin, "WARC-Type": "response", "WARC-Payload-Digest": digest}, block, payloads)
                whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and total == len(block)
                rows.append(row | {"verified": row["verified"] and whole})
            yield pa.RecordBatch.from_pylist(rows, out)

    parsed = C.materialize(files.select("content").mapInArrow(parse, f"origin string, number int, total long, digest string, block binary, {out_sql}"))
    whole = parsed.where("origin is null").select(*out.names)
    parts = parsed.where("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "digest", "block"))).alias("parts"))
    return _revisits_verified(C.materialize(whole.unionByName(parts.mapInArrow(join, out_sql))))


def _revisits_verified(rows: DataFrame) -> DataFrame:
    """rows, in which a revisit is verified if the response that it names has its digest and length and is verified."""
    revisit = F.col("record_type") == "revisit"
    named = rows.where(revisit).select(F.col("refers_to").alias("page_id")).distinct()
    responses = rows.where(~revisit).join(named, "page_id", "left_semi").where("verified")
    responses = C.materialize(responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("same")).distinct())
    checked = rows.where(revisit).drop("verified").join(C.sized(responses, 120), ["refers_to", "payload_digest", "payload_bytes"], "left").withColumn("verified", F.coalesce("same", F.lit(False)))
    return rows.where(~revisit).unionByName(checked.select(*rows.columns))


def query(spark, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark)
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, archives)


ORACLE_SQL = """
WITH records AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
first AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS origin FROM records)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> origin THEN origin END AS refers_to, true AS verified
FROM first
"""
