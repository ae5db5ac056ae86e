"""Main text of pages by equivalence-class template deduction.

Input: pages with page_id, url and html. The result is the main article's text: blocks in page order
joined by two newlines, white space inside a block made one space, character references decoded.

Defined results: null and empty html give an empty text; every row gives a row, also repeated ones, which count once for
a template; pages without a host in their url share the host ''; broken, nested and unclosed markup is read as far as it
goes; other columns stay, those named as a result are replaced; an empty table gives an empty one.

How: the tokens of a page are the opening and closing tags of block elements, by the names of the elements they stand
in, and its blocks of text. Tokens with the same counts on all of a host's unlike pages are one equivalence class. A
class is valid if it is large and frequent, if every page repeats its tokens in one order, and if it lies between the same
two tokens of the root, the class that each page has once; valid classes nested in the root are the template.
What lies between two of the template's tags is a slot. A slot whose text on every page is all in valid classes is the
template's own; what the remaining slots hold is extracted. Inside them the elements tell menus, notices and the like
from the article, and an article or main element bounds it. Pages that don't have the root, that would lose MOST
of their words as near copies do, or whose host has too few unlike pages, are judged by their elements alone.
"""

import html as _html
import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Fewer pages of a host make no template.
LEAST_PAGES = 3
#: A class is frequent if this share of the host's unlike pages has it.
SUPPORT = 0.5
#: Classes of fewer tokens, and slots of fewer words, aren't taken out.
LEAST_TOKENS = 3
LEAST_WORDS = 3
#: Tokens that a task counts before it sends them on.
HELD = 200_000
#: If slots of the template hold more of a page's words, they aren't the template's.
MOST = 2 / 3

#: Elements that are never main text.
DROPPED = frozenset("nav footer aside form script style noscript template head title button select textarea option iframe svg object dialog menu input".split())
#: Elements whose text isn't read as markup.
RAW = "script|style|textarea|title|noscript|iframe"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Words of class, id or role that mark what isn't the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|replies|reply|respond|discussion|disqus|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|footer|header|masthead|toolbar|widget|pagination|pager|search|skip|hidden|contentinfo|complementary)(?:$|[\s_-])"
)
#: Marks of readers' comments, which hold for articles too.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|respond|discussion|disqus)(?:$|[\s_-])")
#: Names that tell how a wrapper of the page is laid out, though a mark is part of them.
_LAYOUT = re.compile(r"^(?:with|has|no|without|content|main-content)[_-]|[_-](?:fixed|sticky|open|closed|enabled|layout)$|side-by-side")
#: Fixed value: a mark that names a section of its own inside an article, not readers' comments.
_SECTION = re.compile(r"^(?:\w+[_-])?discussion$")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattr>[^>]*)>(?P<rawtext>.*?)(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)


class Node:
    """An open element: its name, the signature of its place, whether it is never main text, is marked
    as something else (COMMENT: as readers' comments), and is inside an article, and whether that is inside a mark."""

    __slots__ = ("name", "path", "dropped", "mark", "article", "outer")

    def __init__(self, name: str, path: str, dropped: bool, mark: int, article: bool, outer: int):
        self.name, self.path, self.dropped, self.mark, self.article, self.outer = name, path, dropped, mark, article, outer


MARK, COMMENT = 1, 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The token of an article's headings, which belong to it also where many pages have the same.
HEADING = 1
_ROOT = Node("", "", False, 0, False, 0)


def _opened(parent: Node, name: str, attributes: str) -> Node:
    dropped = parent.dropped or name in DROPPED or (name == "header" and not parent.article)
    mark, outer = parent.mark, parent.outer
    starts = name in ("article", "main")
    if starts and not parent.article and mark == MARK:
        # Whether a mark around an article holds for it is decided when the whole page is known.
        mark, outer = 0, MARK
    if attributes:
        seen = set()
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in seen:
                continue
            seen.add(key)
            value = value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                dropped = dropped or name not in ("html", "body")
            elif key in ("class", "id", "role") and name not in ("body", "html"):
                marks = [v for v in value.split() if not _LAYOUT.search(v) and not (parent.article and _SECTION.search(v))]
                if any(map(COMMENTS.search, marks)):
                    mark = COMMENT
                elif not starts and any(map(MARKS.search, marks)):
                    mark = max(mark, MARK)
    # The path stands for the names of all open elements, however deep.
    return Node(name, xxhash.xxh64_hexdigest(f"{parent.path}/{name}"), dropped, mark, parent.article or starts, outer)


def parse(html: str):
    """(kind, node, text): 'open' and 'close' of elements and 'text' inside them, in page order."""
    stack = [_ROOT]
    depth: Counter = Counter()

    def closed():
        depth[stack[-1].name] -= 1
        return "close", stack.pop(), ""

    for m in _TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            yield "text", stack[-1], m["text"]
        elif m["raw"]:
            node = _opened(stack[-1], m["raw"].lower(), m["rawattr"])
            yield "open", node, ""
            yield "close", node, ""
        elif m["name"]:
            name = m["name"].lower()
            if not m["end"]:
                if name in BLOCKS and stack[-1].name == "p":
                    yield closed()
                elif name == "p" and any(n.name == "p" for n in stack[-4:]):
                    # A p ends one that is still open, with what is open in it.
                    while stack[-1].name != "p":
                        yield closed()
                    yield closed()
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == name:
                    yield closed()
                node = _opened(stack[-1], name, m["attr"])
                yield "open", node, ""
                if name not in VOID and not m["attr"].endswith("/"):
                    stack.append(node)
                    depth[name] += 1
            elif depth[name]:
                while stack[-1].name != name:
                    yield closed()
                yield closed()


def article_of(events: list) -> int | None:
    """Which articles are the main text: 0 those outside marks; MARK all, if the others' marks must be those of the
    page's wrappers, as no more words are outside of articles; None if elements outside of articles are."""
    found = {node.outer for _, node, _ in events if node.article and not node.dropped and not node.mark}
    if not found:
        return None
    if 0 in found:
        return 0
    words = [0, 0]
    for kind, node, text in events:
        if kind == "text" and not node.dropped and not node.mark:
            words[node.article] += len(text.split())
    return MARK if words[True] >= words[False] else None


def host_of(column: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def items_of(events: list, article: int | None) -> list[tuple[int, str | None]]:
    """A page's tokens in order: their hashes, and the text of blocks that may be main text (None for tags).

    article: as article_of() says.
    """
    items: list[tuple[int, str | None]] = []
    text: list[str] = []

    def close():
        block = " ".join(_html.unescape("".join(text)).split())
        if block:
            items.append((HEADING if heading else _hash(f"= {path} {block}"), block))
        text.clear()

    path, heading = "", False
    for kind, node, piece in events:
        if kind == "text":
            if not node.dropped and not node.mark and (not node.outer if article is None else node.article and node.outer <= article):
                text.append(piece)
        elif node.name in BLOCKS:
            close()
            path, heading = node.path, kind == "open" and node.article and node.name in HEADINGS
            items.append((_hash(f"{kind} {path}"), None))
        elif node.name == "br" and kind == "open":
            text.append(" ")
    close()
    return items


def _page(html: str) -> list[tuple[int, str | None]]:
    events = list(parse(html))
    return items_of(events, article_of(events))


def _tokens(batches):
    """Of each host's tokens: whether they are text, pages, the mean of first places, and the occurrence vector.

    The vector is summed: each page adds its count times two numbers of its own. Token 0 stands for the page itself.
    """

    def rows(seen):
        keys, values = list(seen), list(seen.values())
        columns = {"host": pa.array([k[0] for k in keys], pa.string()), "token": pa.array([k[1] for k in keys], pa.int64()), "is_text": pa.array([k[2] for k in keys], pa.bool_())}
        names = (("pages", pa.int64()), ("place", pa.float64()), ("v0", pa.int64()), ("v1", pa.int64()))
        return pa.record_batch(columns | {name: pa.array([v[i] for v in values], kind) for i, (name, kind) in enumerate(names)})

    seen: dict = {}
    for batch in batches:
        for host, html in zip(batch["host"].to_pylist(), batch["html"], strict=True):
            html = html.as_py()
            own = xxhash.xxh64_intdigest(html, 1)
            a, b = own & 0x7FFFFFFF, own >> 33
            found = _page(html)
            counts = Counter((h, t is not None) for h, t in found)
            first: dict = {}
            for i, (h, t) in enumerate(found):
                first.setdefault((h, t is not None), i / len(found))
            for (h, is_text), n in [*counts.items(), ((0, False), 1)]:
                at = seen.setdefault((host, h, is_text), [0, 0.0, 0, 0])
                at[0] += 1
                at[1] += first.get((h, is_text), 0.0)
                at[2] += n * a
                at[3] += n * b
        if len(seen) >= HELD:
            yield rows(seen)
            seen = {}
    yield rows(seen)


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, v0, v1, n, pages, tokens, texts) of large and frequent classes of unlike pages (host, html).

    tokens: the tags, ordered by mean place; texts: the blocks; n: the host's pages. The class of all pages once, the root,
    has the vector of the pages themselves.
    """
    found = pages.mapInArrow(_tokens, "host string, token long, is_text boolean, pages long, place double, v0 long, v1 long")
    total = found.groupBy("host", "token", "is_text").agg(F.sum("pages").alias("pages"), (F.sum("place") / F.sum("pages")).alias("place"), F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
    tokens = C.materialize(total.where(F.col("pages") >= LEAST_PAGES))
    hosts = C.materialize(tokens.where("token = 0 and not is_text").select("host", F.col("pages").alias("n")))
    frequent = tokens.where("token <> 0 or is_text").where(f"token <> {HEADING} or not is_text").join(C.sized_by(hosts, "host", 40), "host").where(F.col("pages") >= SUPPORT * F.col("n"))
    # So frequent tokens are at most twice a page's, so a host's are few.
    grouped = frequent.groupBy("host", "v0", "v1", "n", "pages").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(~F.col("is_text"), F.struct("place", "token")))).alias("tags"), F.sort_array(F.collect_list(F.when(F.col("is_text"), F.col("token")))).alias("texts"))
    roots = tokens.where("token = 0 and not is_text").select("host", F.col("v0").alias("r0"), F.col("v1").alias("r1"))
    rows = grouped.where(F.col("size") >= LEAST_TOKENS).join(roots, "host").withColumn("is_root", (F.col("v0") == F.col("r0")) & (F.col("v1") == F.col("r1")))
    return C.materialize(rows.select("host", "v0", "v1", "n", "pages", "is_root", F.col("tags.token").alias("tokens"), "texts"))


def gaps(items: list, root: dict) -> list[int] | None:
    """For each token, how many of the root's stand up to it; None if the root's don't stand there once, in order."""
    out, at = [], 0
    for h, t in items:
        place = root.get(h) if t is None else None
        if place is not None:
            if place != at:
                return None
            at += 1
        out.append(at)
    return out if at == len(root) else None


def in_order(items: list, order: dict, at: list[int]) -> tuple[bool, int, int]:
    """Whether the tags of a class repeat its order on a page, and the least and largest gap of the root they stand in."""
    found = [(order[h], g) for (h, t), g in zip(items, at, strict=True) if t is None and h in order]
    good = len(found) % len(order) == 0 and all(k == i % len(order) for i, (k, _) in enumerate(found))
    return good, min((g for _, g in found), default=1 << 30), max((g for _, g in found), default=-1)


def _checked(batches):
    """(host, class, good, low, high) for every page that has the root and a class's tags."""
    for batch in batches:
        rows = []
        for host, html, raw in zip(batch["host"].to_pylist(), batch["html"], batch["classes"].to_pylist(), strict=True):
            root, classes = _classes(raw)
            items = _page(html.as_py())
            at = gaps(items, root)
            for number, order in classes.items():
                if at is not None:
                    good, low, high = in_order(items, order, at)
                    if high >= 0:
                        rows.append((host, number, good, low, high))
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "number", "good", "low", "high"])


@lru_cache(512)
def _classes(raw: str) -> tuple[dict, dict]:
    """The root's tags with their places, and those of the other classes by number."""
    found = json.loads(raw)
    return {h: i for i, h in enumerate(found["root"])}, {c["number"]: {h: i for i, h in enumerate(c["tokens"])} for c in found["classes"]}


class Template:
    """The root's tags with their places, the tags of valid classes, their texts, and the slots that are the template's own."""

    def __init__(self, raw: str):
        found = json.loads(raw)
        self.root = {h: i for i, h in enumerate(found["root"])}
        self.tags, self.texts, self.slots = frozenset(found["root"]) | frozenset(found["tags"]), frozenset(found["texts"]), frozenset(found.get("slots", ()))

    def placed(self, items: list) -> list[tuple[int, int, str]] | None:
        """(slot, token, text) of a page's blocks; a slot is named by the tag before it. None if the page doesn't have the root."""
        if gaps(items, self.root) is None:
            return None
        out, slot = [], 0
        for h, t in items:
            if t is not None:
                out.append((slot, h, t))
            elif h in self.tags:
                slot = h
        return out


_template = lru_cache(512)(Template)


def _owned(batches):
    """(host, slot, own): whether all text of a slot on a page is in valid classes."""
    for batch in batches:
        own: dict = {}
        for host, html, raw in zip(batch["host"].to_pylist(), batch["html"], batch["template"].to_pylist(), strict=True):
            template = _template(raw)
            for slot, h, _ in template.placed(_page(html.as_py())) or ():
                own[host, slot] = own.get((host, slot), True) and h in template.texts
        yield pa.record_batch({"host": pa.array([k[0] for k in own], pa.string()), "slot": pa.array([k[1] for k in own], pa.int64()), "own": pa.array(list(own.values()), pa.bool_())})


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template) from unlike pages (host, html); template is the JSON of a Template."""
    classes = equivalence_classes(pages)
    numbered = classes.withColumn("number", F.row_number().over(Window.partitionBy("host").orderBy("is_root", "v0", "v1")))
    numbered = C.materialize(numbered)
    roots = numbered.where("is_root and size(tokens) > 0").select("host", F.col("tokens").alias("root"), F.col("texts").alias("root_texts"))
    others = numbered.where("not is_root and size(tokens) > 0").groupBy("host").agg(F.collect_list(F.struct("number", "tokens")).alias("classes"))
    empty = F.array().cast("array<struct<number:int,tokens:array<bigint>>>")
    asked = roots.join(others, "host", "left").select("host", F.to_json(F.struct("root", F.coalesce("classes", empty).alias("classes"))).alias("classes"))
    asked = C.materialize(asked)
    checked = pages.join(C.sized_by(asked, "classes", 60), "host").mapInArrow(_checked, "host string, number int, good boolean, low int, high int")
    valid = checked.groupBy("host", "number").agg(F.min("good").alias("good"), F.min("low").alias("low"), F.max("high").alias("high")).where("good and low = high")
    nested = numbered.join(valid.select("host", "number"), ["host", "number"]).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tags"), F.flatten(F.collect_list("texts")).alias("texts"))
    # Classes of text alone have no tags whose order could be wrong.
    texts = numbered.where("not is_root and size(tokens) = 0").groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("more"))
    none = F.array().cast("array<bigint>")
    whole = roots.join(nested, "host", "left").join(texts, "host", "left").select("host", "root", F.coalesce("tags", none).alias("tags"), F.concat("root_texts", F.coalesce("texts", none), F.coalesce("more", none)).alias("texts"))
    whole = C.materialize(whole.select("host", F.to_json(F.struct("root", "tags", "texts")).alias("template")))
    own = pages.join(C.sized_by(whole, "template", 60), "host").mapInArrow(_owned, "host string, slot long, own boolean")
    slots = own.groupBy("host", "slot").agg(F.min("own").alias("own")).where("own").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return slots.join(whole, "host").select("host", F.concat(F.expr("substring(template, 1, length(template) - 1)"), F.lit(',"slots":'), F.to_json("slots"), F.lit("}")).alias("template"))


def extract(html: str, template: str | None) -> str:
    """The main text of a page."""
    items = _page(html)
    blocks = _template(template).placed(items) if template else None
    if blocks is None:
        return "\n\n".join(t for _, t in items if t is not None)
    own = _template(template).slots
    words: Counter = Counter()
    for slot, _, t in blocks:
        words[slot] += len(t.split())
    # A page that is nearly all template is a copy of others that differ in little.
    copy = sum(n for slot, n in words.items() if slot in own) > MOST * words.total()
    gone = set() if copy else {slot for slot, n in words.items() if slot in own and n >= LEAST_WORDS}
    return "\n\n".join(t for slot, _, t in blocks if slot not in gone)


def unlike(rows: DataFrame) -> DataFrame:
    """(host, html) of one of the pages with equal html of a host; rows: page_id, host, html."""
    keyed = C.materialize(rows.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "host", F.unhex(F.md5("html")).alias("key")))
    first = keyed.groupBy("host", "key").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = C.materialize(keyed.join(first, ["host", "key"]).where(F.col("page") > F.col("first")).select("page", "host", "key").distinct())
    C.drop(keyed)
    named = rows.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "host", "html").withColumn("key", F.unhex(F.md5("html")))
    return named.join(C.sized_by(others, "host", 60), ["page", "host", "key"], "left_anti").select("host", "html")


def extract_text(pages: DataFrame) -> DataFrame:
    """The columns of pages but html, with text and n_chars. A column of pages with one of these names is replaced."""
    pages = C.bounded(pages).drop("text", "n_chars")
    others = [c for c in pages.columns if c != "html"]
    names = {c: f"_c{i}" for i, c in enumerate(others)}
    page_id = F.col("page_id") if "page_id" in others else F.lit(None)
    templates = C.materialize(deduce_templates(unlike(pages.select(page_id.alias("page_id"), F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host")))))
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    rows = rows.join(C.sized_by(templates, "template", 60), "host", "left").drop("host")

    def run(batches):
        for batch in batches:
            found = [extract(h.as_py(), t.as_py()) for h, t in zip(batch["html"], batch["template"], strict=True)]
            yield pa.record_batch({n: batch[n] for n in names.values()} | {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in set(names.values())]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"])).withColumnsRenamed({n: c for c, n in names.items()})


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
