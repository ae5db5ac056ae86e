"""URL filters: dated list entries joined as of each capture's fetch.

Input: captures (any columns, with url and fetched, a number that grows with time) and list events (list,
scope, pattern, action, at): from `at` on a pattern is on a list (action 'add') or off it ('remove'). Scopes:
'domain' (the host or a parent domain of at least two labels), 'prefix' (host and leading directories,
ending in a slash) and 'url' (host and path, without query and fragment). Hosts are lower-cased.

Defined results: a capture with a null url or fetch time, or without a host, meets no entry; events with a null field
are ignored; of an add and a remove at the same time the remove holds; repeated events and captures
change nothing, every capture row gets a row.

How: each pattern's events become validity intervals by one window; each distinct (url, fetched) is
spread to its few possible patterns and meets the intervals by equality of the pattern with the fetch
time inside the interval. A host with many captures is split by Spark; the lists are broadcast
only if their measured size is small.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def validity(events: DataFrame) -> DataFrame:
    """(list, pattern, since, until) of the times a pattern is on a list; until is null while it stays. pattern starts with its scope."""
    rows = events.dropna(subset=["list", "scope", "pattern", "action", "at"]).select("list", F.concat_ws(":", "scope", "pattern").alias("pattern"), "action", F.col("at").alias("since")).distinct()
    state = rows.groupBy("list", "pattern", "since").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "pattern").orderBy("since")
    return state.withColumn("until", F.lead("since").over(order)).where("action = 'add'").select("list", "pattern", "since", "until")


def possible_patterns(url):
    """The patterns of all scopes that a url can meet."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    labels, parts = F.split(host, "\\."), F.split(path, "/")
    domains = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, folders, F.array(F.concat(F.lit("url:"), host, path)))).otherwise(F.array().cast("array<string>"))


def evaluate_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """The columns of captures, with n_active (entries), lists (sorted, comma-joined) and blocked.

    A column of captures with one of these names is replaced.
    """
    captures = captures.drop("n_active", "lists", "blocked")
    entries = C.materialize(validity(events))
    asked = captures.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    asked = asked.select("url", "fetched", F.explode(possible_patterns(F.col("url"))).alias("pattern"))
    met = asked.join(C.sized_by(entries, "pattern", 60), "pattern").where("since <= fetched and (until is null or fetched < until)")
    found = met.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    rows = captures.join(found, ["url", "fetched"], "left").select(*captures.columns, "n_active", "lists")
    return rows.withColumns({"n_active": F.coalesce("n_active", F.lit(0)), "lists": F.coalesce("lists", F.lit("")), "blocked": F.coalesce(F.col("n_active") > 0, F.lit(False))})


def _derived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list events that the pages table stands for: it has no times or lists of its own."""
    captures = pages.select("page_id", "url", ((F.col("page_id") * 7) % 365).alias("fetched"))
    parts = pages.where("url is not null").select(
        F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("long")
    hosts = parts.select(F.col("host").alias("pattern")).distinct().withColumn("x", number("pattern")).where("x % 3 = 0")
    folders = parts.select(F.concat("host", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("/")).alias("pattern")).distinct().withColumn("x", number("pattern")).where("x % 5 = 0")
    urls = parts.select(F.concat("host", "path").alias("pattern")).distinct().withColumn("x", number("pattern")).where("x % 20 = 0")
    event = lambda rows, name, scope, action, at: rows.select(F.lit(name).alias("list"), F.lit(scope).alias("scope"), "pattern", F.lit(action).alias("action"), at.alias("at"))
    x = F.col("x")
    events = event(hosts, "spam", "domain", "add", x % 200)
    for more in (
        event(hosts.where("x % 2 = 0"), "spam", "domain", "remove", x % 200 + 90),
        event(hosts.where("x % 4 = 0"), "spam", "domain", "add", x % 200 + 150),
        event(folders, "adult", "prefix", "add", x % 300),
        event(urls, "opt-out", "url", "add", x % 100),
        event(urls.where("x % 40 = 0"), "opt-out", "url", "remove", x % 100 + 200),
    ):
        events = events.unionByName(more)
    return captures, events


def query(spark, sf_dir: str) -> DataFrame:
    captures, events = _derived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return evaluate_captures(captures, events)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, url, (page_id * 7) % 365 AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (
  SELECT DISTINCT 'spam' AS list, 'domain:' AS scope, host AS pattern FROM parts WHERE url IS NOT NULL
  UNION ALL SELECT DISTINCT 'adult', 'prefix:', host || '/' || split_part(path, '/', 2) || '/' FROM parts WHERE url IS NOT NULL
  UNION ALL SELECT DISTINCT 'opt-out', 'url:', host || path FROM parts WHERE url IS NOT NULL),
numbered AS (SELECT *, CAST('0x' || substr(md5(pattern), 1, 4) AS BIGINT) AS x FROM named),
events AS (
  SELECT list, scope || pattern AS pattern, 'add' AS action, x % 200 AS since FROM numbered WHERE list = 'spam' AND x % 3 = 0
  UNION ALL SELECT list, scope || pattern, 'remove', x % 200 + 90 FROM numbered WHERE list = 'spam' AND x % 3 = 0 AND x % 2 = 0
  UNION ALL SELECT list, scope || pattern, 'add', x % 200 + 150 FROM numbered WHERE list = 'spam' AND x % 3 = 0 AND x % 4 = 0
  UNION ALL SELECT list, scope || pattern, 'add', x % 300 FROM numbered WHERE list = 'adult' AND x % 5 = 0
  UNION ALL SELECT list, scope || pattern, 'add', x % 100 FROM numbered WHERE list = 'opt-out' AND x % 20 = 0
  UNION ALL SELECT list, scope || pattern, 'remove', x % 100 + 200 FROM numbered WHERE list = 'opt-out' AND x % 40 = 0),
intervals AS (
  SELECT list, pattern, action, since, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS until FROM events),
asked AS (
  SELECT page_id, fetched, 'url:' || host || path AS pattern FROM parts WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM parts, unnest(range(1, len(string_split(host, '.')))) AS t(i) WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched, 'prefix:' || host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/'
  FROM parts, unnest(range(1, len(string_split(path, '/')))) AS t(i) WHERE host <> ''),
met AS (
  SELECT a.page_id, i.list FROM asked a JOIN intervals i
  ON a.pattern = i.pattern AND i.action = 'add' AND i.since <= a.fetched AND (i.until IS NULL OR a.fetched < i.until)),
found AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM met GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched, coalesce(f.n_active, 0) AS n_active, coalesce(f.lists, '') AS lists, coalesce(f.n_active > 0, false) AS blocked
FROM parts p LEFT JOIN found f ON p.page_id = f.page_id
"""
