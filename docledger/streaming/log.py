"""The append-only change log: its pipe rows in batch and as a stream, appending, and counts for each section and day."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, section_id string, skill string, changed long"
#: Columns of a row of the log file.
COLUMNS = ("ts", "sha", "section_id", "skill", "model", "rationale", "counts", "numeric")


def parse_rows(lines: DataFrame) -> DataFrame:
    """The columns of log rows (value: a line each); other lines, the table's head among them, are left out.

    ts is a timestamp, counts a map of numbers; a bar that belongs to a text is written with a backslash before it.
    """
    inner = F.regexp_replace(F.trim("value"), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rows = lines.where(F.trim("value").startswith("|")).select(cells.alias("c")).where(F.size("c") == len(COLUMNS))
    rows = rows.select(*[F.col("c")[i].alias(name) for i, name in enumerate(COLUMNS)]).withColumn("ts", F.try_to_timestamp(F.regexp_replace("ts", r"^(\S+T\d\d:\d\d)(?!:)", "$1:00"))).where("ts is not null")
    counts = F.transform_values(F.str_to_map("counts", F.lit(" "), F.lit("=")), lambda k, v: v.try_cast("long"))
    return rows.withColumns({"counts": counts, "numeric": F.regexp_replace("numeric", r"^numeric:\s*", "")})


def row_text() -> F.Column:
    """The line of a row with COLUMNS, counts as a map."""
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.concat(F.lit("| "), F.array_join(F.array(stamp, *[cell(F.col(c)) for c in COLUMNS[1:6]], counts, F.concat(F.lit("numeric: "), cell(F.col("numeric")))), " | "), F.lit(" |"))


def append_rows(rows: DataFrame, folder: str) -> None:
    """Add rows to the log below folder; what is there is never written again."""
    rows.select(row_text().alias("value")).write.mode("append").text(folder)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return parse_rows(spark.read.text(path))


def stream_rows(spark: SparkSession, path: str) -> DataFrame:
    return parse_rows(spark.readStream.text(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def daily_changes(log: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Rows and changed blocks for each day and section; days close `lateness` after the latest row."""
    grouped = log.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "section_id")
    return grouped.agg(F.count("*").alias("rows"), F.sum("changed").alias("changed")).select(F.col("window.start").alias("day"), "section_id", "rows", "changed")
