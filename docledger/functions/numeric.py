"""Numbers with units in texts, as multisets that can be compared between versions."""

import re
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import TOKEN, ws_normalized

#: The base vocabulary; callers can add their own.
UNITS = """
% ‰ ° °C °F K
s ms µs us ns min h d
Hz kHz MHz GHz rpm
m mm cm km in ft
g kg mg t N Nm kN
V mV kV A mA µA Ω kΩ MΩ W kW mW Wh kWh Ah mAh
Pa kPa MPa bar mbar psi
B kB MB GB bit kbit Mbit baud
""".split()
#: Words before a dotted number that make it a reference, and the form of block IDs.
REFERENCE = r"(?:\b(?:section|clause|figure|table|annex)|§)\s*\d+(?:\.\d+)+"
BLOCK_ID = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{1,7}-[0-9]{6}(?![0-9])"

_NUMBER = re.compile(r"(?<![\w.,])(?P<sign>[-+±−]?)(?P<digits>\d[\d.,]*(?:[eE][-+]?\d+)?)")
_RANGE = re.compile(r"\s?[-–—]\s?(?=\d)")
_UNIT = re.compile(r"[^\s\d.,;:()\[\]]+")
#: Exponents beyond this stay as they are written.
_PLAIN = 60


def canonical(number: str) -> str:
    """A plain decimal without thousands separators; what no decimal is, or too large for one, stays as it is."""
    sign = "±" if number.startswith("±") else ""
    try:
        value = Decimal(number.removeprefix("±").replace(",", "").replace("−", "-"))
        if not value:
            return f"{sign}0"
        value = value.normalize(Context(prec=len(number)))  # all digits that it has
    except ArithmeticError:
        return number
    return f"{sign}{value:f}" if abs(value.adjusted()) <= _PLAIN else f"{sign}{value}"


_LINK = re.compile(r"\[\[[^\]|]*(?:\|([^\]]*))?\]\]")
_SECTION = re.compile(r"\s*\d+(?:\.\d+)*\.?(?:\s+|$)")


def _shown(display: str, units: frozenset) -> str:
    """The display text of a link without the number of a section that it begins with; a number with a unit is none."""
    number = _SECTION.match(display)
    if number is None:
        return display
    rest = display[number.end() :]
    unit = _UNIT.match(rest)
    return display if unit and unit[0] in units else rest


def tokens_of(text: str | None, units: frozenset) -> list[dict]:
    """value, unit and whether it is an end of a range, for each number that isn't an ID, link target or reference."""
    if not text:
        return []
    text = ws_normalized(text)
    text = _LINK.sub(lambda m: f" {_shown(m[1] or '', units)} ", text)
    text = re.sub(REFERENCE, " ", re.sub(BLOCK_ID, " ", text), flags=re.I)
    out, at = [], 0

    def unit_at(end: int) -> str | None:
        found = _UNIT.match(text, end + (text[end : end + 1] == " "))
        return found[0] if found and found[0] in units else None

    while m := _NUMBER.search(text, at):
        digits = m["digits"].rstrip(".,")
        at = m.start("digits") + len(digits)
        unit = unit_at(at)
        out.append({"value": canonical(m["sign"] + digits), "unit": unit, "range": False})
        behind = at if unit is None else text.index(unit, at) + len(unit)
        if (span := _RANGE.match(text, behind)) and (second := _NUMBER.match(text[span.end() :])):
            digits = second["digits"].rstrip(".,")
            at = span.end() + len(digits)
            second_unit = unit_at(at)
            out[-1] |= {"range": True, "unit": unit or second_unit}
            out.append({"value": canonical(digits), "unit": second_unit, "range": True})
    return out


def numeric_tokens(text: Column, extra: tuple = ()) -> Column:
    units = frozenset(ws_normalized(u) for u in (*UNITS, *extra))

    @F.pandas_udf(TOKEN)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: tokens_of(t, units))

    return run(text)


def multiset_difference(base: DataFrame, work: DataFrame) -> DataFrame:
    """Rows that one of two tables of equal columns has more often, with `side` removed or added and `n`.

    One aggregation over both, so nothing is joined.
    """
    columns = base.columns
    both = base.withColumn("_n", F.lit(-1)).unionByName(work.withColumn("_n", F.lit(1)))
    found = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return found.select(*columns, F.when(F.col("_n") < 0, "removed").otherwise("added").alias("side"), F.abs("_n").cast("long").alias("n"))


def numeric_changes(base: DataFrame, work: DataFrame, extra: tuple = (), groups: DataFrame | None = None) -> DataFrame:
    """(id, removed, added, message) of blocks (id, type, content) whose numbers with units changed.

    groups: (id, root) of blocks that lineage ties together. What a group has in base is compared with what it has in work, as one
    multiset, so numbers may move between parts of a split; its finding stands at the smallest id that work has. Every other
    block is a group of its own; a new one has nothing in base. Headings and code have no numbers. removed and added are sorted
    lists, an entry for each time.
    """
    kept = "id is not null and type not in ('heading', 'code')"

    def rooted(t: DataFrame) -> DataFrame:
        if groups is None:
            return t.withColumn("root", F.col("id"))
        return t.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))

    token = lambda t: rooted(t.where(kept).select("id", F.explode(numeric_tokens(F.col("content"), extra)).alias("t"))).select("root", F.concat_ws(" ", "t.value", "t.unit").alias("token"))
    found = multiset_difference(token(base), token(work))
    texts = lambda side: F.array_sort(F.flatten(F.collect_list(F.when(F.col("side") == side, F.array_repeat("token", F.col("n").cast("int"))))))
    rows = found.groupBy("root").agg(texts("removed").alias("removed"), texts("added").alias("added"))
    rows = rows.join(rooted(work.where(kept).select("id")).groupBy("root").agg(F.min("id").alias("id")), "root")
    arrow = F.concat(F.lit('number changed: "'), F.col("removed")[0], F.lit('" -> "'), F.col("added")[0], F.lit('"'))
    lists = F.concat(F.lit("numbers removed: ["), F.array_join("removed", ", "), F.lit("]  added: ["), F.array_join("added", ", "), F.lit("]"))
    return rows.select("id", "removed", "added", F.when((F.size("removed") == 1) & (F.size("added") == 1), arrow).otherwise(lists).alias("message"))
