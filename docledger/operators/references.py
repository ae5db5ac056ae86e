"""Links between places: resolution, dangling targets, inverse lists, impact, and containment of passages."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.sources import scratch


def resolve(links: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """links with `resolved`: whether a target has the name."""
    known = targets.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return links.join(known, name, "left").withColumn("resolved", F.coalesce("_hit", F.lit(False))).drop("_hit")


def wikilinks(links: DataFrame, bookmarks: DataFrame, blocks: DataFrame) -> DataFrame:
    """links (doc, target, display and more) with text and resolved: bookmarks become links to the section of their block.

    bookmarks: doc, name, block_id; blocks: id, file, type. A heading is linked by its section, another block by its marker in
    it; what can't be resolved keeps its display text.
    """
    places = bookmarks.select("doc", F.col("name").alias("target"), F.col("block_id").alias("id")).join(blocks.select("id", F.col("file").alias("_file"), "type"), "id")
    places = places.select("doc", "target", "_file", F.when(F.col("type") != "heading", F.concat(F.lit("#^"), F.lower("id"))).alias("_block"))
    rows = links.join(places, ["doc", "target"], "left")
    link = F.concat(F.lit("[["), "_file", F.coalesce("_block", F.lit("")), F.when(F.coalesce("display", F.lit("")) != "", F.concat(F.lit("|"), "display")).otherwise(""), F.lit("]]"))
    return rows.withColumns({"resolved": F.col("_file").isNotNull(), "text": F.coalesce(link, "display", F.lit(""))}).drop("_file", "_block")


def owning_section(paragraphs: DataFrame, sections: DataFrame, doc: str, at: str) -> DataFrame:
    """paragraphs with the file of the section whose range (first, last) they stand in; null between ranges.

    Ranges of a document don't overlap, so the last one that began is the only one that can hold a paragraph: one window
    over both instead of a join on a range.
    """
    starts = sections.select(doc, F.col("first").alias(at), F.struct("file", "last").alias("_range"))
    both = paragraphs.withColumn("_range", F.lit(None).cast(starts.schema["_range"].dataType)).withColumn("_own", F.lit(1))
    both = both.unionByName(starts.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(doc).orderBy(at, "_own").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_range", F.last("_range", ignorenulls=True).over(so_far)).where("_own = 1")
    return rows.withColumn("file", F.when(F.col(at) <= F.col("_range.last"), F.col("_range.file"))).drop("_range", "_own")


def dangling(links: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    return links.join(targets.select(name), name, "left_anti")


def inverse(links: DataFrame, source: str, target: str) -> DataFrame:
    """target, source and the target's n_refs, a row for each distinct link: a hub's sources never meet in one row."""
    rows = links.select(target, source).distinct()
    return rows.join(rows.groupBy(target).agg(F.count("*").alias("n_refs")), target)


def as_of_last(rows: DataFrame, key: list, order: list, wanted: Column, value: str, name: str, bucket: Column | None = None) -> DataFrame:
    """rows with the value of the last earlier row of the key that is wanted.

    bucket: something that never falls in the order, such as the day. With it a key's rows are dealt by bucket, and only the
    last wanted row of each bucket is carried on to those behind it, so a key with very many rows fills no task.
    """
    keep = F.when(wanted, F.col(value))
    if bucket is None:
        before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.last(keep, ignorenulls=True).over(before))
    rows = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*key, "_bucket").agg(F.max_by(keep, F.when(keep.isNotNull(), F.struct(*order))).alias("_last"))
    carried = last.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    out = rows.withColumn(name, F.last(keep, ignorenulls=True).over(before)).join(carried, [*key, "_bucket"])
    return out.withColumn(name, F.coalesce(name, "_before")).drop("_before", "_bucket")


#: Words in a row that stand for a passage in the search for its texts.
KEY_WORDS = 3
#: Characters by which a part of a run of characters is looked up.
GRAM = 6
#: Bytes of short passages, counted, up to which every task has them all.
SHIPPED = 4 << 20
#: Characters of texts that are looked through together, about.
SLICE = 1 << 20


def _runs(text) -> Column:
    """The runs of white space and of other characters that a text consists of, in order."""
    return F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0))


def _grams(words: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))


def _by_word_keys(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (pid, tid) of passages with KEY_WORDS inner words or more: the rarest KEY_WORDS of them in a row."""
    keys = passages.select("pid", "scope", F.explode(_grams(F.col("inner"), KEY_WORDS)).alias("key"))
    known = scratch.written(keys.select("scope", "key").distinct())
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    t = texts.select("tid", "scope", words.alias("w")).where(F.size("w") >= KEY_WORDS)
    found = scratch.written(t.select("tid", "scope", F.explode(_grams(F.col("w"), KEY_WORDS)).alias("key")).join(scratch.sized_by(known, "key", 96), ["scope", "key"], "left_semi"))
    often = found.groupBy("scope", "key").agg(F.count("*").alias("n"))
    # Every key must be in some text, or the passage is in none.
    met = keys.join(often, ["scope", "key"], "left").groupBy("pid", "scope").agg(F.count("*").alias("every"), F.count("n").alias("met"), F.min_by("key", F.struct("n", "key")).alias("key"))
    chosen = scratch.written(met.where("every = met").select("pid", "scope", "key"))
    return found.join(scratch.sized_by(chosen, "key", 96), ["scope", "key"]).select("pid", "tid")


def _by_runs(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (pid, tid) of passages of few words, over the vocabulary of the texts' runs.

    A passage of one run lies inside a run of the text. Of several, the first ends a run, the last begins one, and those between
    are runs themselves. Each of these says which runs of the vocabulary a text must have one of; a passage takes the one whose runs
    stand in the fewest texts. Runs are looked up by their grams (of GRAM characters, or of a shorter part's length), which are made of distinct
    runs only.
    """
    posts = scratch.written(texts.select("tid", "scope", F.explode(F.array_distinct(_runs(F.col("text")))).alias("run")))
    vocabulary = scratch.written(posts.groupBy("scope", "run").agg(F.count("*").alias("df")))
    n, runs = F.size("runs"), F.col("runs")
    part = lambda place, text: F.struct(F.lit(place).alias("place"), text.alias("part"))
    whole = F.transform(F.slice(runs, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda r: part("whole", r))
    parts = F.when(n == 1, F.array(part("inside", runs[0]))).otherwise(F.concat(F.array(part("end", runs[0]), part("begin", F.element_at(runs, -1))), whole))
    asked = passages.select("pid", "scope", F.explode(parts).alias("x")).select("pid", "scope", "x.place", "x.part").distinct()
    size = F.least(F.length("part"), F.lit(GRAM))
    gram = F.when(F.col("place") == "end", F.col("part").substr(F.length("part") - size + 1, size)).when(F.col("place") == "whole", F.col("part")).otherwise(F.col("part").substr(F.lit(1), size))
    asked = scratch.written(asked.withColumns({"gram": gram, "size": size}))
    sizes = [r[0] for r in asked.where("place = 'inside'").select("size").distinct().orderBy("size").collect()]  # GRAM at most
    edges = [r[0] for r in asked.where("place in ('begin', 'end')").select("size").distinct().orderBy("size").collect()]
    length = F.length("run")
    at = lambda start, k: F.col("run").substr(start, F.lit(k))
    key = lambda place, text: F.struct(F.lit(place).alias("place"), text.alias("gram"))
    none = F.array().cast("array<struct<place:string,gram:string>>")
    slices = lambda k: F.transform(F.sequence(F.lit(1), length - k + 1), lambda i: key("inside", at(i, k)))
    inside = [F.when(length >= k, F.array_distinct(slices(k))).otherwise(none) for k in sizes]
    begin = [F.when(length >= k, F.array(key("begin", at(F.lit(1), k)), key("end", at(length - k + 1, k)))).otherwise(none) for k in edges]
    keys = vocabulary.select("scope", "run", "df", F.explode(F.concat(F.array(key("whole", F.col("run"))), *inside, *begin)).alias("k")).select("scope", "run", "df", "k.*")
    fits = F.when(F.col("place") == "inside", F.contains("run", "part")).when(F.col("place") == "begin", F.startswith("run", "part")).when(F.col("place") == "end", F.endswith("run", "part")).otherwise(F.col("run") == F.col("part"))
    hits = scratch.written(keys.join(scratch.sized_by(asked, "part", 128), ["scope", "place", "gram"]).where(fits).select("pid", "scope", "place", "part", "run", "df"))
    counted = hits.groupBy("pid", "place", "part").agg(F.sum("df").alias("n"))
    # A part that no run fits rules its passage out.
    best = asked.join(counted, ["pid", "place", "part"], "left").groupBy("pid").agg(F.count("*").alias("every"), F.count("n").alias("met"), F.min_by(F.struct("place", "part"), F.struct("n", "place", "part")).alias("x"))
    best = best.where("every = met").select("pid", "x.place", "x.part")
    chosen = scratch.written(hits.join(best, ["pid", "place", "part"]).select("pid", "scope", "run").distinct())
    return posts.join(scratch.sized_by(chosen, "run", 96), ["scope", "run"]).select("pid", "tid").distinct()


def _in_slices(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """Matches (pid, tid) of passages that are few enough for every task to have them all, in one pass over the texts.

    A text that contains a passage has all of its runs of three characters. In a slice of texts the rarest of them says which texts are
    looked at; the test on the whole text decides. Passages of one or two characters are looked for in every text.
    """
    named = scratch.written(passages.select("pid", "passage").distinct().withColumn("n", F.monotonically_increasing_id()))
    wanted = named.select("n", "passage").collect()  # SHIPPED bytes at most
    codes = lambda text: np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    def threes(text: str) -> np.ndarray:
        c = codes(text)
        return c[:-2] << 42 | c[1:-1] << 21 | c[2:]

    grams = np.unique(np.concatenate([np.empty(0, np.int64), *(threes(p) for _, p in wanted if len(p) > 2)]))
    place = lambda g: (g * np.int64(-7046029254386353131)) >> 44 & 0xFFFFF

    def matches(found: list[str], seen: np.ndarray, of: list):
        m = len(found)
        g = threes("".join(found))
        at = np.flatnonzero(seen[place(g)]) if len(g) else np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(grams, g[at]), max(len(grams) - 1, 0))
        same = grams[k] == g[at] if len(grams) else np.zeros(len(at), bool)
        ends = np.cumsum([len(t) for t in found])
        pairs = np.unique(k[same] * m + np.searchsorted(ends, at[same], "right"))
        first = np.searchsorted(pairs, np.arange(len(grams) + 1) * m)
        counts = np.diff(first)
        for n, passage, own in of:
            if own is None:
                yield n, [i for i, t in enumerate(found) if passage in t]
            else:
                rare = own[np.argmin(counts[own])]
                yield n, [i for i in (pairs[first[rare] : first[rare + 1]] % m).tolist() if passage in found[i]]

    def run(batches):
        seen = np.zeros(1 << 20, bool)
        seen[place(grams)] = True
        of = [(n, p, np.searchsorted(grams, np.unique(threes(p))) if len(p) > 2 else None) for n, p in wanted]
        for batch in batches:
            every, start = batch["text"].to_pylist(), 0
            while start < len(every):
                stop, size = start, 0
                while stop < len(every) and size < SLICE:
                    size += len(every[stop])
                    stop += 1
                ids, texts_at = [], []
                for n, at in matches(every[start:stop], seen, of):
                    ids += [n] * len(at)
                    texts_at += at
                yield pa.record_batch({"n": pa.array(ids, pa.int64()), "tid": batch["tid"].slice(start).take(pa.array(texts_at, pa.int32()))})
                start = stop

    found = texts.select("tid", "text").mapInArrow(run, f"n long, tid {texts.schema['tid'].dataType.simpleString()}").distinct()
    return found.join(F.broadcast(named.select("n", "pid")), "n").select("pid", "tid")


def contained(passages: DataFrame, passage_id: str, texts: DataFrame, text_id: str, scope: str | None = None) -> DataFrame:
    """(passage_id, text_id) where the text contains the passage; both tables have a column text. Empty passages are in no text.

    scope: a column of both, such as the document, in which a passage is looked for; without it, in all texts.

    A text that contains a passage has its inner words as whole words. So it has KEY_WORDS of them in a row, if there are as many:
    of a passage's keys the rarest over all texts stands for it. Passages of fewer inner words are looked up in the vocabulary of the
    texts, by every task if they are few and have no scope. Texts are fetched for candidates only, and the test on the whole text decides.
    """
    of = F.col(scope) if scope else F.lit(0)
    p = passages.select(F.col(passage_id).alias("pid"), of.alias("scope"), F.col("text").alias("passage")).where("passage <> ''").withColumn("runs", _runs(F.col("passage")))
    p = p.withColumn("inner", F.filter(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 2, F.lit(0))), lambda r: r.rlike(r"\S")))
    p, t = scratch.written(p), texts.select(F.col(text_id).alias("tid"), of.alias("scope"), "text").where("text is not null")
    many = F.size("inner") >= KEY_WORDS
    done = found = None
    short = p.where(~many)
    n, total = short.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    if n and scope is None and n * 64 + total <= SHIPPED:
        done = _in_slices(short, t)
    elif n:
        found = _by_runs(short, t)
    long = p.where(many)
    if not long.isEmpty():
        part = _by_word_keys(long, t)
        found = part if found is None else found.unionByName(part)
    if found is not None:
        met = found.join(scratch.sized_by(p.select("pid", "passage").distinct(), "passage", 64), "pid").join(t.select("tid", "text"), "tid").where(F.contains("text", "passage")).select("pid", "tid").distinct()
        done = met if done is None else done.unionByName(met).distinct()
    if done is None:
        done = p.limit(0).join(t.limit(0), F.col("pid").cast("string") == F.col("tid").cast("string"))
    return done.select(F.col("pid").alias(passage_id), F.col("tid").alias(text_id))
