"""Secret scans: access identifiers, secrets and endpoints, linked where they complete each other.

Input: documents with doc_id and text. Strong parts are found by their form alone (BASE): assigned secrets, access
identifiers, long runs of hex digits. Weak parts (WEAK) are user names, mail addresses, mixed runs, assigned pass
phrases and endpoints; alone they say nothing. A scope is a block of text between blank lines. A weak part is
reported if its scope has, at most REACH code points from start to start, a strong part of another role, or parts of both
other roles. The roles are identifier, secret and endpoint. A weak part that overlaps a strong one is that one.

Defined results: one row for each row of the input with its spans (kind, start, end; code points, end exclusive) by
start, then kind as listed; a null text is empty, and texts without parts have an empty list; null ids, repeated ids and
repeated rows are kept as they are; other columns are not carried. Letters are ASCII letters.

How: built-in functions only. A pattern's matches and the text between them give places by one running sum. Places are
narrow rows, dealt by document; what lies near a weak part is looked up in summaries of the same and the two next
stretches of REACH code points, each with its first and last start, so no pairs of parts are made and the distance is
exact. Every pattern takes time linear in the text.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

REACH = 400


def _either(words: str) -> str:
    """A pattern for words in either case, without a flag, so that engines agree on it."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_SECRET, _PASS = _either("password|passwd|secret|token|api_?key"), _either("pwd|passphrase|credential|private_?key|access_?key")
_USER, _PLACE = _either("user_?name|user_?id|client_?id|login"), _either("host|endpoint|server|base_?url")

#: kind: (pattern, group that must have a length, that length at least, role).
BASE = {
    "assign": (rf"({_SECRET}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret"),
}
WEAK = {
    "user": (rf"({_USER}){_SET}([A-Za-z0-9@._-]+)", 2, 3, "identifier"),
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", 0, 6, "identifier"),
    "mixed": (r"[A-Za-z0-9+/]{32,}", 0, 32, "secret"),
    "pass": (rf"({_PASS}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, "secret"),
    "url": (r"(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++://[^\x00-\x20\"'<>]+", 0, 8, "endpoint"),
    "place": (rf"({_PLACE}){_SET}([A-Za-z0-9.:/_-]+)", 2, 3, "endpoint"),
}
_KINDS = [*BASE, *WEAK]
_ROLES = ["identifier", "secret", "endpoint"]
_BREAK, _BREAKS = len(_KINDS), r"\n[\x20\x09\x0D]*\n"


def _matches(kind: int, pattern: str, group: int, least: int) -> Column:
    """Of each match in text, from the left: the length of the text before it, its own, and whether it holds."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    sized = F.zip_with(found, inner, lambda m, g: F.struct(m.alias("m"), (F.length(g) >= least).alias("ok")))
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    one = lambda x, before: F.struct(F.lit(kind).alias("kind"), F.length(before).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), (x["ok"] & (mixed(x["m"]) if kind < _BREAK and _KINDS[kind] == "mixed" else F.lit(True))).alias("ok"))
    return F.filter(F.zip_with(sized, F.split("text", pattern, -1), one), lambda x: x["size"].isNotNull())


def _scanned(docs: DataFrame, id_column: str) -> DataFrame:
    """(_row, id, found): found has the matches of every document where something is reported or could be linked, else null."""
    text = docs.select(F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    every = BASE | WEAK
    text = text.withColumns({f"has_{k}": F.col("text").rlike(p) for k, (p, *_) in every.items()})
    any_of = lambda kinds: F.greatest(*[F.col(f"has_{k}") for k in kinds])
    roles = [any_of([k for k, x in WEAK.items() if x[3] == role]) for role in _ROLES]
    strong = any_of(BASE)
    text = text.withColumn("strong", strong).withColumn("linkable", (strong & any_of(WEAK)) | (roles[0] & roles[1] & roles[2]))
    none = F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,ok:boolean>>")
    parts = [F.when(F.col(f"has_{k}") & F.col("strong" if k in BASE else "linkable"), _matches(n, p, group, least)).otherwise(none) for n, (k, (p, group, least, _)) in enumerate(every.items())]
    parts.append(F.when(F.col("linkable"), _matches(_BREAK, _BREAKS, 0, 0)).otherwise(none))
    return text.select(F.monotonically_increasing_id().alias("_row"), "id", F.when(F.col("strong") | F.col("linkable"), F.concat(*parts)).alias("found"))


def _placed(scanned: DataFrame) -> DataFrame:
    """(_row, id, kind, start, end, ok, strong, scope) of all matches; a match that fails has ok false."""
    rows = scanned.where("found is not null").select("_row", "id", F.posexplode("found").alias("k", "x")).select("_row", "id", "k", "x.*").repartition("_row")
    running = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("_row", "kind").orderBy("k"))
    rows = rows.withColumn("end", running).withColumn("start", F.col("end") - F.col("size")).withColumn("strong", F.col("ok") & (F.col("kind") < len(BASE)))
    ahead = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"reached": F.max(F.when(F.col("strong"), F.col("end"))).over(ahead), "scope": F.coalesce(F.count(F.when(F.col("kind") == _BREAK, 1)).over(ahead), F.lit(0))})
    rows = rows.withColumn("next", F.min(F.when(F.col("strong"), F.col("start"))).over(back))
    alone = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return rows.where(f"kind < {_BREAK}").select("_row", "id", "kind", "start", "end", (F.col("ok") & (F.col("strong") | alone)).alias("ok"), "strong", "scope")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts that others complete: (_row, id, kind, start, end)."""
    role = F.element_at(F.array(*[F.lit(_ROLES.index((BASE | WEAK)[k][3])) for k in _KINDS]), F.col("kind") + 1)
    parts = parts.where("ok").withColumns({"role": role, "at": F.floor(F.col("start") / REACH)})
    strong = F.when(F.col("strong"), F.col("start"))
    near = parts.groupBy("_row", "scope", "at", F.col("role").alias("other")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.min(strong).alias("strong_lo"), F.max(strong).alias("strong_hi"))
    weak = parts.where("not strong").select("_row", "id", "kind", "start", "end", "scope", "role", F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0, 1)])).alias("step"), (F.col("at") + F.col("step")).alias("at"))
    within = lambda lo, hi: F.when(F.col("step") == 0, F.col(lo).isNotNull()).when(F.col("step") < 0, F.col("start") - F.col(hi) <= REACH).otherwise(F.col(lo) - F.col("start") <= REACH)
    met = weak.join(near, ["_row", "scope", "at"]).where("role <> other")
    met = met.groupBy("_row", "id", "kind", "start", "end").agg(F.max(within("strong_lo", "strong_hi")).alias("strong"), F.size(F.collect_set(F.when(within("lo", "hi"), F.col("other")))).alias("others"))
    return met.where("strong or others = 2").select("_row", "id", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id_column, spans) for every row of docs; spans is an array of (kind, start, end)."""
    scanned = C.materialize(_scanned(docs, id_column))
    parts = C.materialize(_placed(scanned))
    keep = F.col("ok") & F.col("strong")
    rows = parts.select("_row", "id", "kind", "start", "end", keep.alias("keep")).unionByName(_linked(parts).withColumn("keep", F.lit(True)))
    found = rows.groupBy("_row", "id").agg(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("start", "kind", "end")))).alias("x"))
    name = F.array(*[F.lit(k) for k in _KINDS])
    spans = F.transform("x", lambda s: F.struct(F.element_at(name, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = found.select(F.col("id").alias(id_column), spans.alias("spans"))
    empty = scanned.where("found is null or size(found) = 0").select(F.col("id").alias(id_column), F.array().cast(found.schema["spans"].dataType).alias("spans"))
    return found.unionByName(empty)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *[number(k) for k in BASE], F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """Matches, overlaps and neighbours by plain pairs of one document's parts."""
    every = BASE | WEAK | {"break": (_BREAKS, 0, 0, "")}
    scans = []
    for n, (kind, (pattern, group, least, role)) in enumerate(every.items()):
        p = pattern.replace("(?<![A-Za-z0-9._%+-])", "").replace("(?<![A-Za-z0-9+.-])", "").replace("++", "+").replace("'", "''")
        scans.append(f"select doc_id, {n} kind, '{kind}' as name, '{role}' as part_role, unnest(regexp_extract_all(body, '{p}')) m, unnest(regexp_extract_all(body, '{p}', {group})) g, unnest(string_split_regex(body, '{p}')[:-2]) before, {least} least, unnest(range(len(regexp_extract_all(body, '{p}')))) k from texts where regexp_matches(body, '{p}')")
    near = "select 1 from parts o where o.doc_id = p.doc_id and o.area = p.area and o.part_role <> p.part_role and abs(o.starts - p.starts) <= " + str(REACH)
    strong = f"kind < {len(BASE)}"
    line = "string_agg(name || ':' || starts || ':' || ends, ',' order by starts, kind)"
    return f"""with texts as (select doc_id, coalesce(text, '') body from documents),
    scan as ({' union all '.join(scans)}),
    place as (select *, (sum(len(before) + len(m)) over (partition by doc_id, kind order by k))::bigint ends from scan),
    sure as (select doc_id, kind, name, part_role, ends - len(m) starts, ends from place where len(g) >= least and (name <> 'mixed' or (regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')))),
    single as (select * from sure p where {strong} or not exists (select 1 from sure o where o.doc_id = p.doc_id and o.{strong} and o.starts < p.ends and p.starts < o.ends)),
    parts as (select p.*, (select count(*) from sure b where b.doc_id = p.doc_id and b.name = 'break' and b.starts < p.starts) area from single p where name <> 'break'),
    kept as (select * from parts p where {strong} or exists ({near} and o.{strong}) or 2 = (select count(distinct o.part_role) from ({near.replace('select 1', 'select o.part_role')}) o)),
    by_doc as (select doc_id, count(*) filter (name = 'assign') n_assign, count(*) filter (name = 'access') n_access, count(*) filter (name = 'hex') n_hex, {line} filter ({strong}) base, {line} spans from kept group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from documents d left join by_doc using (doc_id)"""


ORACLE_SQL = _oracle()
