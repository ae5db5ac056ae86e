"""N-gram Jaccard join: rare-first prefix filtering, then one exact check for each pair.

Input: a table with doc_id (integer) and text; other columns are ignored. Two documents link
when 100 * |A & B| >= threshold * |A | B| for their sets of distinct n-word shingles (words
`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer words is one shingle).

Defined results: null and empty texts have no shingles and link with nothing; rows that
repeat a document all get its result; copies of one text link (unless it has no words); a row
whose doc_id is null gets its n_shingles and a null component_id; an empty table gives an empty one.

How: exact copies are put aside. A fixed-size count sketch over all shingles gives the order,
rare first. Each document's prefix of that order goes to its shingles' partitions; shingles met
once go no further, and of a shingle that very many have each task sends two rows to its partition and
spreads the others. Candidates must pass the length and positional filters. Documents that meet in small runs are
paired by a join, and each tries its least partner first; members of a large run try one pivot each round. What
that links is one component, so the last round takes only pairs between different components and groups of copies
never cost all their pairs. Pairs are verified once, after a suffix filter, on whole sets. A word stands for two hashes
under keys that are drawn anew for each call, so words that share a hash can't be written on purpose.
"""

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .columnar import SPACES, U, both_runs, chunks, fresh_keys

#: Counters of the sketch: 2**SKETCH_BITS, whatever the input's size.
SKETCH_BITS = 18
#: Rounds of pivots; after the first, only for open runs over LARGE documents.
PIVOT_ROUNDS = 3
LARGE = 1024
#: Runs of at most so many documents are paired by a join, larger ones in blocks of BLOCK documents.
SMALL = 32
BLOCK = 256
#: Shingles that a task remembers to have met; forgetting one costs a row, never a result.
MET = 1 << 16


class Shingles(NamedTuple):
    """How a call takes shingles: their words, and the keys of the hashes that stand for words."""

    n: int
    keys: tuple[int, int]


def shingle_sets(texts, how: Shingles):
    """(row, sorted distinct shingle hashes) of each text."""
    n = how.n
    for lo, hi, w in chunks(texts, SPACES, True, how.keys):
        all_runs = both_runs(w.hash, w.second, n)
        for row in range(lo, hi):
            a, b = w.first[row - lo], w.first[row - lo + 1]
            yield row, np.unique(all_runs[a : b - n + 1] if b - a >= n else both_runs(w.hash[a:b], w.second[a:b], max(1, b - a)))


def _least(threshold: int, n: int) -> int:
    """The least overlap of a set of n with any set that it may link with."""
    return -(-threshold * n // 100)


def _counts(docs: DataFrame, how: Shingles) -> tuple[DataFrame, np.ndarray]:
    """The table (doc_id, n_shingles) and the sketch, from one pass."""

    def count(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for row, s in shingle_sets(batch["text"], how):
                sizes[row] = len(s)
                np.add.at(sketch, (s >> U(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.record_batch({"doc_id": batch["doc_id"], "n": pa.array(sizes), "bucket": pa.nulls(batch.num_rows, pa.int32())})
        full = np.flatnonzero(sketch)
        for at in range(0, len(full), 1 << 16):
            some = full[at : at + (1 << 16)]
            yield pa.record_batch({"doc_id": pa.nulls(len(some), pa.int64()), "n": pa.array(sketch[some]), "bucket": pa.array(some.astype(np.int32))})

    both = C.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, bucket int"))
    order = np.zeros(1 << SKETCH_BITS, np.int64)
    found = both.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    order[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return both.where("bucket is null").select("doc_id", "n"), order


class _Met:
    """Tells which rows of a task have a shingle that the task has met twice before or in an earlier batch."""

    def __init__(self):
        self.h = np.zeros(0, U)

    def known(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h, kind="stable")
        x = h[order]
        start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        size = np.diff(np.append(start, len(x)))
        head = x[start]
        met = np.isin(head, self.h, assume_unique=True)
        run = np.repeat(np.arange(len(start)), size)
        out = np.zeros(len(h), bool)
        out[order] = met[run] | (np.arange(len(x)) - start[run] >= 2)
        again = head[(size > 1) & ~met][:MET]
        # When the new ones don't fit, the older ones are forgotten.
        self.h = np.concatenate([self.h, again]) if len(self.h) + len(again) <= MET else again
        return out


def _shared(docs: DataFrame, order: np.ndarray, how: Shingles, threshold: int) -> DataFrame:
    """(h, rep, n, pos) for prefix shingles that at least two documents have in their prefixes."""
    sketch = docs.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches):
        rare, met = sketch.value, _Met()
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            h, rep, size, pos = [], [], [], []
            for row, s in shingle_sets(batch["text"], how):
                k = len(s) - _least(threshold, len(s)) + 1 if len(s) else 0
                if k:
                    first = np.argsort(rare[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:k]
                    h.append(s[first])
                    rep.append(np.full(k, ids[row], np.int64))
                    size.append(np.full(k, len(s), np.int32))
                    pos.append(np.arange(k, dtype=np.int32))
            if h:
                h, rep, size, pos = map(np.concatenate, (h, rep, size, pos))
                known = met.known(h)
                # A known row needs no proof any more; ~pos says so.
                yield pa.record_batch({"h": h.view(np.int64), "rep": rep, "n": size, "pos": np.where(known, ~pos, pos)})

    def met_again(batches):
        held = None  # a last row whose run may go on
        last = None
        for batch in batches:
            known = batch["pos"].to_numpy() < 0
            if known.any():
                some = batch.filter(pa.array(known))
                yield pa.record_batch({"h": some["h"], "rep": some["rep"], "n": some["n"], "pos": ~some["pos"].to_numpy()})
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h = batch["h"].to_numpy()
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            keep = same.copy()
            keep[:-1] |= same[1:]
            if last is not None and h[0] == last:
                keep[0] = True
            # The last row waits, unless it is already known to be of a run.
            held = None if keep[-1] else batch.slice(len(h) - 1)
            last = h[-1] if keep[-1] else None
            if keep.any():
                yield batch.filter(pa.array(keep))

    rows = docs.mapInArrow(prefixes, "h long, rep long, n int, pos int")
    # Known rows are dealt evenly; of the others each run is together, as they are sorted by h.
    deal = F.when(F.col("pos") < 0, F.xxhash64("h", "rep")).otherwise(F.col("h"))
    return C.materialize(rows.repartition(deal).sortWithinPartitions("h").mapInArrow(met_again, "h long, rep long, n int, pos int"))


def _filters(x: str, y: str, threshold: int):
    """The length and positional filters on rows x and y of one shingle."""
    size = F.col(f"{x}.n") + F.col(f"{y}.n")
    inside = F.least(f"{x}.pos", f"{y}.pos") + 1 + F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos")) - 1
    return (100 * F.least(f"{x}.n", f"{y}.n") >= threshold * F.greatest(f"{x}.n", f"{y}.n")) & ((100 + threshold) * inside >= threshold * size)


def suffix_filter(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the Hamming distance of two sorted sets; stops once it is over most."""
    if not depth or len(x) < 8 or len(y) < 8:
        return abs(len(x) - len(y))
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    bound = abs(i - j) + abs((len(x) - i) - (len(y) - j))
    if bound > most:
        return bound
    left = suffix_filter(x[:i], y[:j], most - abs((len(x) - i) - (len(y) - j)), depth - 1)
    if left + abs((len(x) - i) - (len(y) - j)) > most:
        return left + abs((len(x) - i) - (len(y) - j))
    return left + suffix_filter(x[i:], y[j:], most - left, depth - 1)


def _verified(pairs: DataFrame, docs: DataFrame, how: Shingles, threshold: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets are similar enough."""
    ids = C.materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())

    def sets(batches):
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(batch["text"], how)]
            yield pa.record_batch({"id": batch["doc_id"], "s": pa.array(found, pa.binary())})

    def check(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                size = len(x) + len(y)
                least = -(-threshold * size // (100 + threshold))
                if suffix_filter(x, y, size - 2 * least) <= size - 2 * least:
                    good[i] = len(np.intersect1d(x, y, assume_unique=True)) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    rows = docs.join(C.sized(ids, 16), "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sets, "id long, s binary")
    table = C.materialize(rows)
    C.drop(ids)
    joined = pairs.join(table.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(table.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    good = C.materialize(joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))
    C.drop(table)
    return good


def _small_runs(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b), a < b, that meet in runs of rows, each of a bounded size, and pass the filters.

    A pair that meets in large runs too is counted short here, but found there.
    """
    found = rows.alias("x").join(rows.alias("y"), "h").where("x.rep < y.rep").where(_filters("x", "y", threshold))
    pairs = found.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("i"), F.col("y.n").alias("j")).agg(F.count("*").alias("k"))
    # Whatever two sets share outside of both prefixes is behind the prefix of one of them.
    behind = lambda n: F.ceil(threshold * F.col(n) / 100) - 1
    return pairs.where((100 + threshold) * (F.col("k") + F.greatest(behind("i"), behind("j"))) >= threshold * (F.col("i") + F.col("j"))).select("a", "b").distinct()


def _open_runs(rows: DataFrame, step: int) -> DataFrame:
    """(h, m, p) of runs of rows with more than one component: size, and a pivot (c, n, rep, pos) of the least component."""
    first = F.min(F.struct("c", *([F.xxhash64("rep", F.lit(step)).alias("by")] if step else []), "n", "rep", "pos"))
    found = rows.groupBy("h").agg(F.count("*").alias("m"), F.max("c").alias("high"), first.alias("p"))
    return C.materialize(found.where("p.c < high").drop("high"))


def _with_pivots(rows: DataFrame, runs_of: DataFrame, tried: list[DataFrame], threshold: int) -> DataFrame:
    """Pairs (a, b) of members of runs with the pivot that each shares most with; pairs of tried are left out."""
    pivots = runs_of.select("h", "p.rep", "p.n", "p.pos", "p.c")
    found = rows.alias("x").join(pivots.alias("y"), "h").where(F.col("x.c") != F.col("y.c")).where(_filters("x", "y", threshold))
    found = found.groupBy(F.col("x.rep").alias("x"), F.col("y.rep").alias("y")).count()
    found = _without(found.select("x", "y", "count", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), tried)
    return found.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("count", -F.col("y"))).alias("best")).select("best.*").distinct()


def _without(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    for t in tried:
        pairs = pairs.join(C.sized(t, 16), ["a", "b"], "left_anti")
    return pairs


def _large_runs(rows: DataFrame, shared: DataFrame, open_runs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in open runs of rows and pass all filters.

    open_runs: h with its pivot and the pivot's component, main. A document's shared shingles, of all runs, stay together.
    Documents of runs with the same pivot meet in blocks of BLOCK, so no pair is a row before it has passed: from the
    number of shingles that two prefixes share and what is left behind them follows the most their sets can share.
    """
    met = rows.join(open_runs, "h")
    members = C.materialize(met.select("pivot", "rep", "c", (F.col("c") == F.col("main")).alias("main")).groupBy("pivot", "rep", "c").agg(F.min("main").alias("main")))
    size = members.groupBy("pivot").agg(F.ceil(F.count_if(~F.col("main")) / BLOCK).cast("int").alias("n_rest"), F.ceil(F.count_if("main") / BLOCK).cast("int").alias("n_main"))
    whole = shared.join(members.select("rep", "c").distinct(), "rep").groupBy("rep", "n", "c").agg(F.collect_list("h").alias("hs"))
    placed = members.drop("c").join(size, "pivot")
    # Blocks 0 .. n_rest - 1, then those of the pivot's own component, which needn't meet each other.
    own = F.when(F.col("main"), F.col("n_rest") + F.pmod(F.xxhash64("rep"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("n_rest"))).cast("int")
    others = F.when(F.col("main"), F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main"))
    placed = placed.withColumn("own", own).where(others > 0).withColumn("other", F.explode(F.sequence(F.lit(0), others.cast("int") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def pairs(key, table):
        n, c, own, rep = (table[x].to_numpy() for x in ("n", "c", "own", "rep"))
        hs = table["hs"].combine_chunks() if isinstance(table["hs"], pa.ChunkedArray) else table["hs"]
        size = np.diff(hs.offsets.to_numpy())
        _, token = np.unique(hs.flatten().to_numpy(), return_inverse=True)
        doc = np.repeat(np.arange(len(n)), size)
        x, y = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        shared = np.zeros((len(n), len(n)), np.float32)
        # Only shingles that two documents of the group have count; so many columns at a time.
        twice = np.flatnonzero(np.bincount(token) > 1)
        column = np.full(token.max(initial=0) + 1, -1)
        column[twice] = np.arange(len(twice))
        at = column[token]
        for lo in range(0, len(twice), 4096):
            here = (at >= lo) & (at < lo + 4096)
            m = np.zeros((len(n), 4096), np.float32)
            m[doc[here], at[here] - lo] = 1
            shared[np.ix_(x, y)] += m[x] @ m[y].T
        prefix = n - -(-threshold * n // 100) + 1
        i, j = (v[shared[np.ix_(x, y)].nonzero()[k]] for k, v in enumerate((x, y)))
        i, j = i[c[i] != c[j]], j[c[i] != c[j]]
        most = shared[i, j].astype(np.int64) + np.maximum(n[i] - prefix[i], n[j] - prefix[j])
        good = (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & ((100 + threshold) * most >= threshold * (n[i] + n[j]))
        return pa.table({"a": np.minimum(rep[i], rep[j])[good], "b": np.maximum(rep[i], rep[j])[good]})

    grouped = placed.join(whole, "rep").select("pivot", "i", "j", "own", "rep", F.col("n").cast("long").alias("n"), "c", "hs")
    return grouped.groupBy("pivot", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def jaccard_links(docs: DataFrame, n: int = 5, threshold: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, sizes, components).

    copies: (doc_id, key, rep) from common.exact_copies. sizes: (doc_id, n) of representatives.
    components: (node, component) of the representatives that link with another text.
    """
    spark = docs.sparkSession
    docs = C.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = C.exact_copies(docs)
    reps = C.representatives(docs, copies)
    if not copies.where("doc_id is not null").groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        reps = reps.dropDuplicates()
    how = Shingles(n, fresh_keys())
    sizes, order = _counts(reps, how)
    shared = _shared(reps, order, how, threshold)
    large = C.materialize(shared.groupBy("h").count().where(F.col("count") > SMALL).select("h"))
    small = C.materialize(_small_runs(shared.join(C.sized(large, 16), "h", "left_anti"), threshold))
    rows = big = C.materialize(shared.join(C.sized(large, 16), "h"))
    some = not big.isEmpty()
    links, tried, used = [], [], [shared, large, small, big]
    components = None

    def try_pairs(pairs: DataFrame) -> None:
        nonlocal components
        pairs = C.materialize(pairs)
        tried.append(pairs)
        if not pairs.isEmpty():
            links.append(_verified(pairs, reps, how, threshold))
            components = C.connected_components(reduce(DataFrame.unionByName, links))
            used.append(components)

    def of_now(table: DataFrame, node: str, name: str) -> DataFrame:
        """table with the component that its column node is in now."""
        if components is None:
            return table.withColumn(name, F.col(node))
        found = components.select(F.col("node").alias(node), F.col("component").alias(name))
        return table.join(C.sized(found, 24), node, "left").withColumn(name, F.coalesce(name, node))

    for step in range(PIVOT_ROUNDS if some else 1):
        # First each document tries its least partner and a pivot; then only members of very large runs try others.
        pairs = None if step else small.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        if some:
            rows = C.materialize(of_now(big, "rep", "c"))
            runs_of = _open_runs(rows, step)
            used += [rows, runs_of]
            asked = runs_of.where(F.col("m") > LARGE) if step else runs_of
            if step and asked.isEmpty():
                break
            found = _with_pivots(rows, asked, tried, threshold)
            pairs = found if pairs is None else pairs.unionByName(found).distinct()
        try_pairs(pairs)
    pairs = of_now(of_now(small, "a", "c"), "b", "d").where("c <> d").select("a", "b")
    if some:
        rows = C.materialize(of_now(big, "rep", "c"))
        runs_of = _open_runs(rows, 0)
        used += [rows, runs_of]
        pairs = pairs.unionByName(_large_runs(rows, shared, runs_of.select("h", F.col("p.rep").alias("pivot"), F.col("p.c").alias("main")), threshold)).distinct()
    try_pairs(_without(pairs, tried))
    if components is None:
        return copies, sizes, spark.createDataFrame([], "node long, component long")
    C.drop(*[t for t in used if t is not components], *tried, *links)
    return copies, sizes, components


def jaccard_components(docs: DataFrame, n: int = 5, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    copies, sizes, components = jaccard_links(docs, n, threshold)
    spark = docs.sparkSession
    keys = copies.where("doc_id = rep").select("doc_id", "key").distinct()
    per_text = keys.join(sizes.groupBy("doc_id").agg(F.max("n").alias("n_shingles")), "doc_id").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"))
    # A text that only rows without a doc_id have is in no representative.
    alone = copies.groupBy("key").agg(F.min("rep").alias("rep")).where("rep is null").select("key")
    if not alone.isEmpty():
        how = Shingles(n, fresh_keys())

        def count(batches):
            for batch in batches:
                yield pa.record_batch({"key": batch["key"], "n_shingles": pa.array([len(s) for _, s in shingle_sets(batch["text"], how)], pa.int64())})

        rows = docs.select(C.text_key().alias("key"), "text").join(alone, "key", "left_semi").mapInArrow(count, "key binary, n_shingles long")
        per_text = per_text.unionByName(rows.distinct())
    low = F.least(F.coalesce("component", "rep"), "rep")
    rows = copies.join(C.sized(C.materialize(per_text), 48), "key").join(C.sized(components.select(F.col("node").alias("rep"), "component"), 24), "rep", "left")
    return rows.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), low).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
