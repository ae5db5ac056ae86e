"""Section files: front matter and anchored blocks, as tables and back to bytes."""

import hashlib
import json
import re

import pyarrow as pa
import pyarrow.fs
import yaml
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Order of front-matter keys in files.
KEYS = ["id", "doc", "number", "title", "level", "parent", "order", "path", "path_ids", "breadcrumb", "bookmarks", "refs_out", "blocks", "words", "source", "ingest_version", "generated"]
#: Order of anchor attributes; the rest follows by name.
ATTRIBUTES = ["id", "type", "ordered", "format", "lang", "fallback", "asset", "reason", "locked", "supersedes", "split_from"]
#: The form of an anchor and of a block reference.
_ANCHOR = re.compile(r"<!--\s*((?:[a-z][a-z0-9_]*:\S+\s*)+)-->$")
_MARKER = re.compile(r"(?:^|\n| )\^([a-z0-9-]+)\Z")
#: The safe loader over libyaml where PyYAML has it: the same values in a tenth of the time.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the section files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("file"), F.col("value").alias("text"))


def split_front(files: DataFrame) -> DataFrame:
    """(file, front, body): front is the YAML between the first two --- lines, null without one."""
    found = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n(.*)\z", 1)
    whole = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n(.*)\z", 2)
    has = F.col("text").rlike(r"(?s)\A---\n.*?\n---\n")
    return files.select("file", F.when(has, found).alias("front"), F.when(has, whole).otherwise(F.col("text")).alias("body"))


def front_matter(files: DataFrame) -> DataFrame:
    """(file, valid, fields as a map of JSON texts) of split files."""

    def run(batches):
        for batch in batches:
            good, out = [], []
            for raw in batch["front"].to_pylist():
                try:
                    fields = yaml.load(raw, _LOADER) if raw is not None else None
                except yaml.YAMLError:
                    fields = None
                good.append(isinstance(fields, dict))
                out.append([(str(k), json.dumps(v, sort_keys=True, default=str, ensure_ascii=False, separators=(",", ":"))) for k, v in fields.items()] if good[-1] else [])
            yield pa.record_batch({"file": batch["file"], "valid": good, "fields": pa.array(out, pa.map_(pa.string(), pa.string()))})

    return files.select("file", "front").mapInArrow(run, "file string, valid boolean, fields map<string,string>")


def parse_body(body: str | None) -> list[dict]:
    """The blocks of a body, in order: what blank lines outside of fences separate; an anchor line begins one too."""
    found: list[list[str]] = [[]]
    fence = False
    for line in (body or "").split("\n"):
        if not fence and not line.strip():
            found.append([])
            continue
        if not fence and _ANCHOR.match(line) and any(not _ANCHOR.match(x) for x in found[-1]):
            found.append([])
        if line.startswith("```"):
            fence = not fence
        found[-1].append(line)
    out = []
    for lines in filter(None, found):
        anchors = []
        while lines and (m := _ANCHOR.match(lines[0])):
            anchors.append(m[1])
            lines = lines[1:]
        heading = bool(lines) and re.match(r"#{1,6} ", lines[0]) is not None
        if heading and (m := _ANCHOR.search(lines[0])):
            anchors.append(m[1])
            lines = [lines[0][: m.start()].rstrip(), *lines[1:]]
        content = "\n".join(lines)
        attrs = dict(pair.split(":", 1) for pair in anchors[0].split()) if anchors else {}
        marker = None if heading else _MARKER.search(content)
        raw = content[: marker.start()] if marker else content
        out.append(
            {
                "block_index": len(out),
                "n_anchors": len(anchors),
                "attrs": list(attrs.items()),
                "id": attrs.get("id"),
                "type": attrs.get("type") or ("heading" if heading else "paragraph"),
                "content": raw.rstrip(),
                "marker": marker[1] if marker else None,
                "raw_sha": hashlib.sha256(raw.encode()).hexdigest(),
                "supersedes": attrs["supersedes"].split(",") if "supersedes" in attrs else [],
                "split_from": attrs.get("split_from"),
            }
        )
    return out


_BLOCK = pa.schema([("file", pa.string()), ("block_index", pa.int64()), ("n_anchors", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("id", pa.string()), ("type", pa.string()), ("content", pa.string()), ("marker", pa.string()), ("raw_sha", pa.string()), ("supersedes", pa.list_(pa.string())), ("split_from", pa.string())])
_BLOCK_SQL = "file string, block_index long, n_anchors int, attrs map<string,string>, id string, type string, content string, marker string, raw_sha string, supersedes array<string>, split_from string"


def blocks(files: DataFrame) -> DataFrame:
    """A row for each block of split files. raw_sha stands for the block's bytes without anchor and marker."""

    def run(batches):
        for batch in batches:
            rows = [{"file": file} | block for file, body in zip(batch["file"].to_pylist(), batch["body"].to_pylist(), strict=True) for block in parse_body(body)]
            yield pa.RecordBatch.from_pylist(rows, _BLOCK)

    return files.select("file", "body").mapInArrow(run, _BLOCK_SQL)


def rendered(found: DataFrame, heads: DataFrame) -> DataFrame:
    """(file, text): files written from blocks and heads (file, front), byte for byte the same each time.

    A heading's anchor ends its line, the others have a line before their block.
    """
    place = lambda key: F.array_position(F.array(*map(F.lit, ATTRIBUTES)), key)
    key = lambda a: F.struct(F.when(place(a.key) > 0, place(a.key)).otherwise(99).alias("at"), F.concat(a.key, F.lit(":"), a.value).alias("text"))
    pairs = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("attrs"), key)), lambda x: x.text), " ")
    anchor = F.when(F.size("attrs") > 0, F.concat(F.lit("<!-- "), pairs, F.lit(" -->")))
    marked = F.concat("content", F.when(F.col("marker").isNotNull(), F.concat(F.when(F.col("type").isin("paragraph"), " ").otherwise("\n"), F.lit("^"), "marker")).otherwise(""))
    text = F.when(F.col("type") == "heading", F.concat_ws(" ", "content", anchor)).otherwise(F.concat_ws("\n", anchor, marked))
    body = found.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", text.alias("t")))), lambda s: s.t), "\n\n").alias("body"))
    whole = F.concat(F.lit("---\n"), "front", F.lit("\n---\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    return heads.join(body, "file", "left").select("file", whole.alias("text"))


def asset_names(spark: SparkSession, folder: str) -> DataFrame:
    """asset: the names of the files below a folder; their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("asset"))


def write_assets(assets: DataFrame, folder: str) -> DataFrame:
    """Write (asset, bytes) as files into a folder that all executors share (a URI). Returns (asset, size) of what was written.

    A file is written under a name of its attempt and then moved, so a lost task leaves no half file under its name.
    """

    def run(batches):
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, content in zip(batch["asset"].to_pylist(), batch["bytes"], strict=True):
                with store.open_output_stream(f"{path}/.{name}.{attempt}", compression=None) as out:
                    out.write(content.as_buffer())
                store.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            yield pa.record_batch({"asset": batch["asset"], "size": pa.array([len(c.as_buffer()) for c in batch["bytes"]], pa.int64())})

    return assets.select("asset", "bytes").mapInArrow(run, "asset string, size long")
