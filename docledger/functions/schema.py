"""Schemas of the vault's files, as tables of constraints that become column expressions over parsed JSON.

A node of a schema is a dict of these constraints:
  type        string, integer, number, boolean, object, array, or a list of them; null among them allows null
  properties  key: node; required: keys that must be there; closed: no other keys (true unless said otherwise)
  values      node of every value of an object with free keys; keys: the pattern of these keys
  items       node of every element; least, most: how many
  pattern, shortest (characters), minimum, maximum, enum, const
  when        (key, value, needed): if key has the value, needed must be there
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of IDs and document keys, and the words that stand for themselves.
ID = "^[A-Z][A-Z0-9]{1,7}-[0-9]{6}$"
DOC = "^[A-Z][A-Z0-9]{1,7}$"
_ID, _DOC, _TEXT, _COUNT = {"type": "string", "pattern": ID}, {"type": "string", "pattern": DOC}, {"type": "string"}, {"type": "integer", "minimum": 0}
_TEXTS = {"type": "array", "items": _TEXT}
_NAME = {"type": "string", "shortest": 1}
_FROM_1 = {"type": "integer", "minimum": 1}


def _object(required: dict, optional: dict | None = None, **more) -> dict:
    return {"type": "object", "properties": required | (optional or {}), "required": list(required)} | more


def _counts(*names: str) -> dict:
    return _object(dict.fromkeys(names, _COUNT))


_SPAN = {"type": "array", "items": _COUNT, "least": 2, "most": 2}
_ENTRY = _object(
    {"status": {"enum": ["active", "deleted", "merged", "split"]}, "type": _NAME, "section": _ID, "text_hash": {"type": "string", "pattern": "^[0-9a-f]{8}$"}, "first_seen": _TEXT, "last_seen": _TEXT},
    {"key": _TEXT, "merged_into": _ID, "split_into": {"type": "array", "items": _ID, "least": 1}},
    when=[("status", "merged", "merged_into"), ("status", "split", "split_into")],
)
_SEVERITY = {"enum": ["error", "warn", "info"]}
_GATE = {"enum": ["pass", "fail"]}
#: The five schemas.
SCHEMAS = {
    "section": _object(
        {"id": _ID, "doc": _DOC, "number": _TEXT, "title": _NAME, "level": {"type": "integer", "minimum": 0, "maximum": 6}, "order": _COUNT, "path": _TEXTS, "path_ids": {"type": "array", "items": _ID, "least": 1}, "breadcrumb": _TEXT, "bookmarks": _TEXTS, "refs_out": _TEXTS, "blocks": _FROM_1, "words": _COUNT, "source": _object({"docx": _TEXT, "paragraphs": _SPAN}), "ingest_version": _FROM_1, "generated": {"const": False}},
        {"parent": _ID},
    ),
    "generated": _object({"generated": {"const": True}, "doc": _DOC, "kind": {"enum": ["index", "log", "backlinks", "coverage"]}, "generated_at": _NAME, "generator": _NAME, "ingest_version": _FROM_1}),
    "ids": _object({"version": {"const": 1}, "doc_key": _DOC, "next": _FROM_1, "blocks": {"type": "object", "values": _ENTRY, "keys": ID}}),
    "coverage": _object(
        {
            "schema": {"const": 1},
            "source": _TEXT,
            "doc_key": _DOC,
            "ingest_version": _FROM_1,
            "generated_at": _NAME,
            "counts": _object({"sections": _COUNT, "blocks": _COUNT, "paragraphs": _COUNT, "lists": _COUNT, "tables": _counts("total", "pipe", "html", "degraded"), "figures": _counts("total", "extracted"), "shapes": _counts("total", "rendered", "raw_only"), "formulas": _counts("total", "latex", "image"), "footnotes": _COUNT}),
            "links": _counts("word_links_found", "resolved_section", "resolved_block", "unresolved", "external"),
            "numbering": _counts("headings", "resolved", "unresolved", "lists", "lists_resolved"),
            "revisions": _counts("ins_accepted", "del_discarded", "comments_discarded"),
            "skipped": _object({"toc": _counts("paragraphs", "chars"), "header_footer": _counts("paragraphs", "chars")}),
            "text_fidelity": _object({"scope": _TEXTS, "source_segments": _COUNT, "segments_covered": _COUNT, "coverage": {"type": "number", "minimum": 0, "maximum": 1}, "added_chars": _COUNT, "added_breakdown": _counts("heading_numbers", "list_numbers", "captions"), "uncovered": {"type": "array", "items": _object({"paragraph": _COUNT, "chars": _COUNT, "reason": _NAME})}}),
            "gates": _object({"links": _GATE, "tables": _GATE, "fidelity": _GATE}),
            "issues": {"type": "array", "items": _object({"severity": _SEVERITY, "code": _NAME, "paragraph": {"type": ["integer", "null"], "minimum": 0}, "detail": _TEXT})},
        },
        {"tool_version": _TEXT},
    ),
    "findings": _object(
        {
            "base": _TEXT,
            "base_sha": _TEXT,
            "files_checked": _COUNT,
            "findings": {"type": "array", "items": _object({"file": {"type": ["string", "null"]}, "rule": {"type": "string", "pattern": "^V[0-9]{2}[a-z]?$"}, "severity": _SEVERITY, "block_id": {"type": ["string", "null"], "pattern": ID}, "message": _NAME, "old": {"type": ["string", "null"]}, "new": {"type": ["string", "null"]}})},
            "summary": _counts("errors", "warnings", "files"),
        }
    ),
}

_FAULT = "array<struct<path:string,fault:string>>"


def _bound(value: Column, then) -> Column:
    """then(value), an array, with value as the variable of a lambda: it is computed once, however often then names it."""
    return F.flatten(F.transform(F.array(value), then))


def _kind(name: Column) -> Column:
    """The JSON type of a value, by the name of its schema."""
    whole = name.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | name.rlike(r"^DECIMAL\(\d+,0\)$")
    return F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(whole, "integer").otherwise("number")


def faults_of(node: dict, value: Column, path: Column) -> Column:
    """The faults of a value (a variant) against a node: an array of path and fault.

    A value that isn't there has none; its object says that it is missing. Its parts and its type are taken from it once, as the type
    of a container is seen from its parts alone.
    """
    if "properties" in node or "values" in node:
        parts, of = "map<string,variant>", "object"
    elif "items" in node:
        parts, of = "array<variant>", "array"
    else:
        named = F.struct(value.alias("v"), F.schema_of_variant(value).alias("name"))
        return _bound(named, lambda x: _bound(F.struct(x["v"].alias("v"), _kind(x["name"]).alias("kind")), lambda y: _faults(node, y["v"], y["kind"], None, path)))
    named = F.struct(value.alias("v"), F.try_variant_get(value, "$", parts).alias("parts"))
    kind = lambda x: F.when(x["parts"].isNotNull(), of).otherwise(_bound(F.schema_of_variant(x["v"]), lambda n: F.array(_kind(n)))[0])
    return _bound(named, lambda x: _bound(F.struct(x["v"].alias("v"), x["parts"].alias("parts"), kind(x).alias("kind")), lambda y: _faults(node, y["v"], y["kind"], y["parts"], path)))


def _faults(node: dict, value: Column, kind: Column, inner: Column | None, path: Column) -> Column:
    """faults_of() of a value whose type and parts (of a container) are known."""
    get = lambda kind: F.try_variant_get(value, "$", kind)
    none = F.array().cast(_FAULT)
    one = lambda fault, at=path: F.struct(at.alias("path"), F.lit(fault).alias("fault"))
    tests: list[Column] = []
    own = lambda bad, fault: tests.append(F.when(F.coalesce(bad, F.lit(False)), one(fault)))
    allowed = [node["type"]] if isinstance(node.get("type"), str) else node.get("type", [])
    if allowed:
        own(~kind.isin(*allowed, *(["integer"] if "number" in allowed else [])), "type")
    text, number = F.when(kind == "string", get("string")), F.when(kind.isin("integer", "number"), get("double"))
    if "pattern" in node:
        own(~text.rlike(node["pattern"]), "pattern")
    if "shortest" in node:
        own(F.length(text) < node["shortest"], "length")
    if "minimum" in node:
        own(number < node["minimum"], "minimum")
    if "maximum" in node:
        own(number > node["maximum"], "maximum")
    if "enum" in node:
        own((kind != "string") | ~text.isin(*node["enum"]), "enum")
    if "const" in node:
        want = node["const"]
        same = (kind == "boolean") & (get("boolean") == want) if isinstance(want, bool) else (kind == "integer") & (number == want)
        own(~same, "const")
    parts: list[Column] = []
    if "items" in node:
        size = F.size(inner)
        if "least" in node:
            own((kind == "array") & (size < node["least"]), "items")
        if "most" in node:
            own((kind == "array") & (size > node["most"]), "items")
        each = F.transform(inner, lambda x, i: faults_of(node["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.when(kind == "array", F.flatten(each)))
    at = lambda key: F.concat(path, F.lit("." + key) if isinstance(key, str) else F.concat(F.lit("."), key))
    if "values" in node:
        checked = lambda e: F.concat(F.when(e["key"].rlike(node["keys"]), none).otherwise(F.array(one("key", at(e["key"])))), faults_of(node["values"], e["value"], at(e["key"])))
        parts.append(F.when(kind == "object", F.flatten(F.transform(F.map_entries(inner), checked))))
    if "properties" in node:
        lacks = lambda key: ~F.map_contains_key(inner, F.lit(key))
        tests += [F.when((kind == "object") & lacks(key), one("missing", at(key))) for key in node["required"]]
        if node.get("closed", True):
            unknown = F.array_except(F.map_keys(inner), F.array(*map(F.lit, node["properties"])))
            parts.append(F.when(kind == "object", F.transform(unknown, lambda k: F.struct(at(k).alias("path"), F.lit("unknown").alias("fault")))))
        for key, other, needed in node.get("when", ()):
            own((kind == "object") & (F.try_variant_get(value, f"$.{key}", "string") == other) & lacks(needed), f"{other} needs {needed}")
        for key, child in node["properties"].items():
            parts.append(F.when((kind == "object") & ~lacks(key), faults_of(child, inner[key], at(key))))
    found = F.array_compact(F.array(*tests)) if tests else none
    return F.concat(found, *[F.coalesce(part, none) for part in parts])


def faults(text: Column, schema: str) -> Column:
    """The faults of a JSON text against one of SCHEMAS; a text that is no JSON has the one fault json."""
    wrong = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("fault"))).cast(_FAULT)
    return _bound(F.try_parse_json(text), lambda x: F.when(x.isNull(), wrong).otherwise(faults_of(SCHEMAS[schema], x, F.lit("$"))))
