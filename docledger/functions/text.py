"""Text functions of structured documents: plain Spark columns, and Arrow UDFs where the JVM has no equal."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

#: Characters that normalization drops, and the ranges that count as CJK.
INVISIBLE = "​‌‍﻿­"
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
#: Fixed value: the least similarity of two versions of a block.
SIMILAR = 0.85

_dropped = str.maketrans("", "", INVISIBLE)


def ws_normalized(text: str | None) -> str | None:
    """NFKC without invisible characters, white space collapsed to single spaces and trimmed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).translate(_dropped).split())


@F.pandas_udf(StringType())
def normalize_ws(s: pd.Series) -> pd.Series:
    return s.map(ws_normalized)


@F.pandas_udf(StringType())
def normalize(s: pd.Series) -> pd.Series:
    """normalize_ws, case-folded."""
    return s.map(lambda t: None if t is None else ws_normalized(t).casefold())


def text_hash(text: Column) -> Column:
    """The first 8 hex digits of the SHA-256 of the normalized text."""
    return F.substring(F.sha2(normalize(text), 256), 1, 8)


def words(text: Column) -> Column:
    """White-space tokens with a letter or digit that isn't CJK, and one for every 2.5 CJK characters, rounded up."""
    spoken = F.regexp_count(F.regexp_replace(text, f"[{CJK}]", ""), F.lit(r"(?<!\S)[^\s\p{L}\p{N}]*+[\p{L}\p{N}]"))
    return (spoken + F.ceil(F.regexp_count(text, F.lit(f"[{CJK}]")) / 2.5)).cast("long")


def block_id(doc: Column, number: Column) -> Column:
    return F.concat(doc, F.lit("-"), F.lpad(number.cast("string"), 6, "0"))


def match_key(path: Column, kind: Column, ordinal: Column, digest: Column) -> Column:
    """What a block is recognized by when its document is read again."""
    return F.concat_ws("|", path, kind, ordinal.cast("string"), digest)


def breadcrumb(*parts: Column) -> Column:
    return F.concat_ws(" > ", *parts)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of Python integers."""
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS over the summed lengths; 1 for two empty texts."""
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The indel ratio of normalized texts; where a threshold follows, may_be_similar() spares the pairs that can't pass."""

    def one(x, y):
        if x is None or y is None:
            return None
        return indel_ratio(x, y)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def may_be_similar(a: Column, b: Column) -> Column:
    """Whether the lengths of two texts allow SIMILAR at all."""
    return 2 * F.least(F.length(a), F.length(b)) >= SIMILAR * (F.length(a) + F.length(b))


def links_of(text: Column) -> Column:
    """Targets and display texts of wikilinks: structs of section, block (null without a block) and display."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\[]+)\]\]"), F.lit(1))

    def parts(link: Column) -> Column:
        target, display = F.split_part(link, F.lit("|"), F.lit(1)), F.split_part(link, F.lit("|"), F.lit(2))
        block = F.split_part(target, F.lit("#^"), F.lit(2))
        return F.struct(F.split_part(target, F.lit("#^"), F.lit(1)).alias("section"), F.when(block != "", block).alias("block"), F.when(display != "", display).alias("display"))

    return F.transform(found, parts)


def anchor_of(line: Column) -> Column:
    """The attributes of a block anchor, a comment of `id:… type:…` pairs; null for other lines."""
    inside = F.regexp_extract(line, r"^<!--\s*((?:[a-z_]+:\S+\s*)+)-->$", 1)
    return F.when(inside != "", F.str_to_map(F.trim(inside), F.lit(r"\s+"), F.lit(":")))


TOKEN = ArrayType(StructType([StructField("value", StringType()), StructField("unit", StringType()), StructField("range", BooleanType())]))
