"""Copies of images by local descriptors.

Input: images (id integer, pixels: bytes row by row with one, three or four channels of one byte each, width and
height; without these two columns images are grey squares). Queries are looked up among all images; a pair is a
copy if LEAST_INLIERS matches agree on one similarity: a turn, scale and shift (mirrored copies are none).

Defined results: null pixels, and those whose number doesn't fit width and height, have no descriptors and match
nothing; equal images are one class whose smallest id stands for it; every image row gets a row, repeated and null ids
too; flat images have no corners; other columns are ignored; an empty table gives an empty one.

How: images are made smaller to at most AREA pixels. Corners by the structure tensor on several scales, the strongest
kept in proportion to the area; the grey centroid of a corner's smoothed patch turns its binary tests; 128 tests,
chosen on noise for how little they tell of each other, make a descriptor. Several tables each take some bits of it as a key;
descriptors that share a table's key meet, and pairs within RADIUS bits stay, once each. From KEY_BITS bits in TABLES tables on,
keys grow with the logarithm of the queries' corners, and tables so that close descriptors still meet.
Matches of two images then vote: each gives a similarity, and the one that most others agree with decides.

An image is one row from end to end. The queries' corners, sorted by key, are an index that images are looked up in: whole in
each task while it is small, else in shards by key, each met by the images that have a corner with a key in it. So no row stands for a pair of
corners or of images: the pairs that an image is found in are an array in its row.
"""

from functools import lru_cache
from itertools import pairwise
from math import ceil, comb, log1p, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

AREA = 256 * 256
SCALES = (1.0, 0.84, 0.71, 0.59, 0.5)
#: Corners of an image of SIDE times SIDE pixels.
SIDE = 96
CORNERS = 80
TABLES = 10
KEY_BITS = 20
RADIUS = 18
LEAST_INLIERS = 9
#: Corners of queries that KEY_BITS and TABLES are for.
MANY = 1 << 16
#: Measured on the images of the check tool's check_l: with 24 bits a table has a fifth of the meetings that it has with 20.
BITS_TO_HALF = 1.75
#: An index of more bytes is split into shards of about as many; a corner takes ENTRY bytes, KEY for each table and POST for each
#: key that is in the index. Shuffled, a corner takes SENT bytes.
INDEX_BYTES = 24 << 20
ENTRY, KEY, POST, SENT = 96, 8, 24, 40
#: Bytes of the images that meet a shard at once.
SLICE_BYTES = 16 << 20
#: Queries whose matches with an image are gathered in one row, if the index is in shards.
BLOCK = 1024
#: Pairs of corners that are compared at once.
AT_ONCE = 1 << 19
#: Pixels that a match may be off the common similarity.
SLACK = 4.0
MARGIN = 9
#: Pixels of images that are described together.
STACK = 64 * SIDE * SIDE

_random = np.random.default_rng(11)
#: Binary tests compare places within REACH of a corner that are APART from each other.
REACH, APART = 13, 4
#: The bits of each table's key.
_CHOSEN = np.stack([_random.choice(128, KEY_BITS, replace=False) for _ in range(TABLES)])
#: The most bits of a key; 2 ** 16 tables fit beside them.
MOST_BITS = 46
_y, _x = np.mgrid[-7:8, -7:8]
_disc = ((_x**2 + _y**2 <= 49) * np.exp(-(_x**2 + _y**2) / (2 * 4.2**2))).astype(np.float32)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r+1 of a stack of images."""
    n = 2 * r + 1
    p = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    return (p[:, n:, n:] - p[:, :-n, n:] - p[:, n:, :-n] + p[:, :-n, :-n]) / (n * n)


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a

    def axis(n):
        at = (np.arange(max(1, round(n * scale))) + 0.5) / scale - 0.5
        low = np.clip(np.floor(at).astype(int), 0, max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), np.clip(at - low, 0, 1).astype(np.float32)

    (y, y1, v), (x, x1, u) = axis(a.shape[1]), axis(a.shape[2])
    rows = a[:, y] * (1 - v)[None, :, None] + a[:, y1] * v[None, :, None]
    return rows[:, :, x] * (1 - u) + rows[:, :, x1] * u


def _peaks(a: np.ndarray, r: int) -> np.ndarray:
    """The largest value of the square around each pixel."""
    for axis in (1, 2):
        most = a
        for d in range(1, r + 1):
            most = np.maximum(most, np.maximum(np.roll(a, d, axis), np.roll(a, -d, axis)))
        a = most
    return a


def _corners(stack: np.ndarray, scale: float) -> tuple:
    """Image, y, x and strength of the corners at a scale, and the smoothed images."""
    a = _box(_resized(stack, scale), 1)
    if min(a.shape[1:]) <= 2 * MARGIN:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.float32), a
    gy, gx = np.gradient(a, axis=(1, 2))
    xx, yy, xy = (_box(v, 2) for v in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    ok = (strength >= _peaks(strength, 3)) & (strength > 1.0)
    ok[:, :MARGIN] = ok[:, -MARGIN:] = ok[:, :, :MARGIN] = ok[:, :, -MARGIN:] = False
    k, y, x = np.nonzero(ok)
    return k, y, x, strength[k, y, x], _box(a, 2)


def _angles(a: np.ndarray, k: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The direction of each corner's grey centroid."""
    k, y, x = k[:, None, None], y[:, None, None], x[:, None, None]
    patch = a[k, np.clip(y + _y, 0, a.shape[1] - 1), np.clip(x + _x, 0, a.shape[2] - 1)] * _disc
    return np.arctan2((patch * _y).sum((1, 2)), (patch * _x).sum((1, 2)))


def _tested(a: np.ndarray, k: np.ndarray, y: np.ndarray, x: np.ndarray, angle: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """The outcome of turned tests (pairs of places) at each corner."""
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    turned_x, turned_y = tests[None, :, :, 0] * c - tests[None, :, :, 1] * s, tests[None, :, :, 0] * s + tests[None, :, :, 1] * c
    value = _sampled(a, k[:, None, None], y[:, None, None] + turned_y, x[:, None, None] + turned_x)
    return value[:, :, 0] < value[:, :, 1]


@lru_cache(1)
def tests() -> np.ndarray:
    """128 tests: of random ones those that divide corners of noise evenly and tell little of those before them.

    The same in every process: noise and tests come from fixed seeds.
    """
    random = np.random.default_rng(11)
    pairs = random.uniform(-REACH, REACH, (6000, 2, 2))
    pairs = pairs[(np.hypot(pairs[:, :, 0], pairs[:, :, 1]) <= REACH).all(axis=1) & (np.hypot(*(pairs[:, 0] - pairs[:, 1]).T) >= APART)][:1000]
    noise = _box(random.normal(0, 1, (12, SIDE, SIDE)), 2) * 5 + _box(random.normal(0, 1, (12, SIDE, SIDE)), 5) * 8
    noise = (20 + 200 * (noise - noise.min()) / np.ptp(noise)).astype(np.float32)
    k, y, x, _, a = _corners(noise, 1.0)
    v = _tested(a, k, y, x, _angles(a, k, y, x), pairs).astype(np.float32)
    even = np.argsort(abs(v.mean(axis=0) - 0.5), kind="stable")
    v = (v - v.mean(axis=0)) / np.maximum(v.std(axis=0), 1e-6)
    alike = abs(v.T @ v) / len(v)
    most, chosen = 0.3, []
    while len(chosen) < 128:
        most, chosen = most + 0.05, []
        for i in even.tolist():
            if len(chosen) < 128 and (alike[i, chosen] < most).all():
                chosen.append(i)
    return pairs[chosen]


def _sampled(a: np.ndarray, k: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels."""
    y, x = np.clip(y, 0, a.shape[1] - 1.001), np.clip(x, 0, a.shape[2] - 1.001)
    i, j = y.astype(int), x.astype(int)
    v, u = (y - i).astype(np.float32), (x - j).astype(np.float32)
    return (a[k, i, j] * (1 - u) + a[k, i, j + 1] * u) * (1 - v) + (a[k, i + 1, j] * (1 - u) + a[k, i + 1, j + 1] * u) * v


def describe(stack: np.ndarray) -> tuple:
    """Of a stack of images: image, x, y, angle, scale and descriptor (two 64-bit halves) of every corner kept."""
    first = min(1.0, (AREA / (stack.shape[1] * stack.shape[2])) ** 0.5)
    stack = _resized(stack.astype(np.float32), first)
    most = int(CORNERS * max(1.0, stack.shape[1] * stack.shape[2] / SIDE**2))
    found = [_corners(stack, scale) for scale in SCALES]
    image, strength = np.concatenate([f[0] for f in found]), np.concatenate([f[3] for f in found])
    order = np.lexsort((np.arange(len(image)), -strength, image))
    rank = np.arange(len(order)) - np.searchsorted(image[order], image[order])
    kept = np.zeros(len(image), bool)
    kept[order[rank < most]] = True
    out, begin = [], 0
    for (k, y, x, _, a), scale in zip(found, SCALES, strict=True):
        mine = kept[begin : begin + len(k)]
        begin += len(k)
        k, y, x = k[mine], y[mine], x[mine]
        angle = _angles(a, k, y, x)
        bits = np.packbits(_tested(a, k, y, x, angle, tests()), axis=1)
        out.append((k, x / scale, y / scale, angle, np.full(len(k), scale), np.ascontiguousarray(bits).view(np.int64).reshape(-1, 2)))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(6))


def _grey(raw, width: int, height: int) -> np.ndarray | None:
    """Grey levels of an image, or None if its bytes don't fit its size."""
    if width < 1 or height < 1 or len(raw) not in (width * height, 3 * width * height, 4 * width * height):
        return None
    levels = np.frombuffer(raw, np.uint8).reshape(height, width, -1)
    return levels[:, :, :3].mean(axis=2, dtype=np.float32)


_CORNERS = "x array<float>, y array<float>, angle array<float>, scale array<float>, d0 array<long>, d1 array<long>"
_LISTS = ("x", "y", "angle", "scale", "d0", "d1")


def _lists(values: tuple, offsets: np.ndarray) -> dict:
    """Columns of lists, one for each of _LISTS."""
    return {c: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for c, v in zip(_LISTS, values, strict=True)}


def _flat(rows) -> tuple:
    """Of rows with _LISTS: the row of every corner, and the corners' values."""
    n = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in _chunks(rows["d0"]))])
    return np.repeat(np.arange(len(n)), n), tuple(np.concatenate([np.zeros(0, np.int64 if c[0] == "d" else np.float32), *(v.flatten().to_numpy() for v in _chunks(rows[c]))]) for c in _LISTS)


def _chunks(column) -> list:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def descriptors(images: DataFrame) -> DataFrame:
    """(id, x, y, angle, scale, d0, d1) of images (id, pixels, width, height) that have corners: arrays with a value for each corner."""

    def run(batches):
        for batch in batches:
            sizes: dict = {}
            for i, (w, h) in enumerate(zip(batch["width"].to_pylist(), batch["height"].to_pylist(), strict=True)):
                sizes.setdefault((w, h), []).append(i)
            ids = batch["id"].to_numpy(zero_copy_only=False)
            for (w, h), rows in sizes.items():
                step = max(1, STACK // max(1, (w or 0) * (h or 0)))
                for lo in range(0, len(rows), step):
                    grey = [(i, _grey(batch["pixels"][i].as_buffer(), w, h)) for i in rows[lo : lo + step]]
                    grey = [g for g in grey if g[1] is not None]
                    if not grey:
                        continue
                    k, x, y, angle, scale, d = describe(np.stack([g[1] for g in grey]))
                    order = np.argsort(k, kind="stable")
                    found, begin = np.unique(k[order], return_index=True)
                    small = [v[order].astype(np.float32) for v in (x, y, angle, scale)]
                    at = np.array([g[0] for g in grey])[found]
                    yield pa.record_batch({"id": ids[at].astype(np.int64)} | _lists((*small, *np.ascontiguousarray(d[order].T)), np.append(begin, len(k))))

    good = images.where("pixels is not null and width is not null and height is not null")
    return good.select("id", "pixels", "width", "height").mapInArrow(run, f"id long, {_CORNERS}")


def tables_for(corners: int) -> tuple[int, int]:
    """Tables and bits of a key for so many corners of queries.

    Bits tell of each other, so one more doesn't halve a table's chance meetings; BITS_TO_HALF do. There are as
    many tables as find descriptors with RADIUS different bits as often as the first ones do.
    """
    more = min(MOST_BITS - KEY_BITS, max(0, ceil(log2(max(corners, 1) / MANY) * BITS_TO_HALF)))
    missed = [log1p(-comb(128 - RADIUS, bits) / comb(128, bits)) for bits in (KEY_BITS, KEY_BITS + more)]
    return ceil(TABLES * missed[0] / missed[1]), KEY_BITS + more


@lru_cache(4)
def _chosen(tables: int, bits: int) -> np.ndarray:
    if (tables, bits) == (TABLES, KEY_BITS):
        return _CHOSEN
    random = np.random.default_rng(11)
    return np.stack([random.choice(128, bits, replace=False) for _ in range(tables)])


def keys_of(d0: np.ndarray, d1: np.ndarray, tables: int = TABLES, bits: int = KEY_BITS) -> np.ndarray:
    """The key of every table (columns) for each descriptor: its number, then its bits."""
    of = np.unpackbits(np.ascontiguousarray(np.stack([d0, d1], axis=1)).view(np.uint8), axis=1).astype(np.int64)
    power = 1 << np.arange(bits)
    return np.stack([of[:, chosen] @ power + (t << bits) for t, chosen in enumerate(_chosen(tables, bits))], axis=1)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


class Index:
    """Corners of queries by the keys of a shard."""

    def __init__(self, queries, size: tuple[int, int], shards: int = 1, shard: int = 0):
        """queries: an Arrow table of id and _LISTS; size: tables and bits of keys."""
        row, values = _flat(queries)
        self.size, self.id = size, queries["id"].to_numpy()[row]
        self.place, (self.d0, self.d1) = np.stack(values[:4], axis=1).astype(np.float64), values[4:]
        self.keys = np.concatenate([np.zeros((0, size[0]), np.int64), *(keys_of(self.d0[lo : lo + 4096], self.d1[lo : lo + 4096], *size) for lo in range(0, len(row), 4096))])
        flat = self.keys.ravel()
        mine = np.nonzero(_shard_of(flat, shards) == shard)[0]
        mine = mine[np.argsort(flat[mine], kind="stable")]
        self.corner = mine // size[0]
        self.known, self.begin, self.count = np.unique(flat[mine], return_index=True, return_counts=True)

    def meet(self, ids: np.ndarray, d0: np.ndarray, d1: np.ndarray):
        """Yield (corners, corners of queries): pairs of other images' that share a key here and are within RADIUS bits.

        A pair is given for the first table in which both have the same key, so once over all shards.
        """
        if not len(self.known):
            return
        for lo in range(0, len(d0), 4096):
            keys = keys_of(d0[lo : lo + 4096], d1[lo : lo + 4096], *self.size)
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            row, table = np.nonzero(self.known[at] == keys)
            at = at[row, table]
            total = np.append(0, np.cumsum(self.count[at]))
            for begin in range(0, int(total[-1]), AT_ONCE):
                # Pairs are numbered key by key; some of a key's may be left to the next piece.
                n = np.arange(begin, min(begin + AT_ONCE, int(total[-1])))
                key = np.searchsorted(total, n, side="right") - 1
                q, r = self.corner[self.begin[at[key]] + n - total[key]], row[key]
                # Unsigned: of negative numbers bitwise_count takes the absolute value.
                differ = sum(np.bitwise_count((mine[lo + r] ^ asked[q]).view(np.uint64)) for mine, asked in ((d0, self.d0), (d1, self.d1)))
                near = (differ <= RADIUS) & (ids[lo + r] != self.id[q])
                q, r, t = q[near], r[near], table[key[near]]
                first = (self.keys[q] == keys[r]).argmax(axis=1) == t
                yield lo + r[first], q[first]

    def matches(self, rows):
        """Of a batch of images: arrays (image, query, place, place in the query) of all pairs of corners that meet, some images at a time."""
        row, values = _flat(rows)
        ids, places = rows["id"].to_numpy(), np.stack(values[:4], axis=1).astype(np.float64)
        left, most = (np.zeros(0, np.int64),) * 2, AT_ONCE
        told = lambda r, q: (ids[row[r]], self.id[q], places[r], self.place[q])
        for r, q in self.meet(ids[row], *values[4:]):
            r, q = left = np.append(left[0], r), np.append(left[1], q)
            if len(r) >= most:
                # Corners come in order, so only the last one's image may have more to come.
                whole = int(np.searchsorted(row[r], row[r[-1]]))
                yield told(r[:whole], q[:whole])
                left = r[whole:], q[whole:]
                most = max(AT_ONCE, 2 * len(left[0]))
        yield told(*left)


def consensus(q: np.ndarray, m: np.ndarray) -> int:
    """The largest number of matches that agree on one similarity; rows are x, y, angle, scale."""
    turn = m[:, 2] - q[:, 2]
    grow = q[:, 3] / m[:, 3]
    c, s = np.cos(turn) * grow, np.sin(turn) * grow
    dx = m[:, 0] - (c * q[:, 0] - s * q[:, 1])
    dy = m[:, 1] - (s * q[:, 0] + c * q[:, 1])

    def agreed(i):
        off_x = c[i, None] * q[:, 0] - s[i, None] * q[:, 1] + dx[i, None] - m[:, 0]
        off_y = s[i, None] * q[:, 0] + c[i, None] * q[:, 1] + dy[i, None] - m[:, 1]
        return np.hypot(off_x, off_y) <= SLACK

    votes = np.concatenate([agreed(np.arange(lo, min(lo + 256, len(q)))).sum(axis=1) for lo in range(0, len(q), 256)])
    best = 0
    for i in np.argsort(-votes, kind="stable").tolist():
        if votes[i] <= best:
            break
        good = agreed(np.array([i]))[0]
        # Corners of one place on several scales count once.
        best = max(best, min(len({(int(a) >> 3, int(b) >> 3) for a, b in p[good, :2]}) for p in (q, m)))
    return best


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in columns that are sorted together, and their length."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.nonzero(first)[0], len(first))


def _voted(ids: np.ndarray, queries: np.ndarray, place: np.ndarray, asked: np.ndarray):
    """A batch (id, found) of the images that are copies by these matches; each pair's must be here whole."""
    order = np.lexsort((queries, ids))
    ids, queries, place, asked = ids[order], queries[order], place[order], asked[order]
    out: dict = {}
    for lo, hi in pairwise(_runs(ids, queries).tolist()):
        if hi - lo >= LEAST_INLIERS and (n := consensus(asked[lo:hi], place[lo:hi])) >= LEAST_INLIERS:
            out.setdefault(int(ids[lo]), []).append({"query": int(queries[lo]), "inliers": n})
    kind = pa.list_(pa.struct({"query": pa.int64(), "inliers": pa.int64()}))
    return pa.record_batch([pa.array(list(out), pa.int64()), pa.array(list(out.values()), kind)], ["id", "found"])


_FOUND = "id long, found array<struct<query: long, inliers: long>>"


def _by_broadcast(every: DataFrame, corners: DataFrame, size: tuple[int, int]) -> DataFrame:
    """_FOUND of all images, which are looked up in one index in every task."""
    sent = every.sparkSession.sparkContext.broadcast(corners.toArrow())

    def run(batches):
        index = None
        for batch in batches:
            index = index or Index(sent.value, size)
            for matches in index.matches(batch):
                yield _voted(*matches)

    return every.mapInArrow(run, _FOUND)


def _sharded(rows: DataFrame, size: tuple[int, int], shards: int) -> DataFrame:
    """A row (shard, id, corners) of each image and each shard that a key of its corners is in, with these corners."""

    def run(batches):
        for batch in batches:
            row, values = _flat(batch)
            pairs = [np.zeros((0, 2), np.int64)]
            for lo in range(0, len(row), 4096):
                shard = _shard_of(keys_of(values[4][lo : lo + 4096], values[5][lo : lo + 4096], *size), shards)
                pairs.append(np.unique(np.stack([np.repeat(np.arange(lo, lo + len(shard)), size[0]), shard.ravel()], axis=1), axis=0))
            corner, shard = np.concatenate(pairs).T
            order = np.lexsort((corner, shard, row[corner]))
            corner, shard = corner[order], shard[order]
            cell = row[corner] * shards + shard
            found, begin = np.unique(cell, return_index=True)
            lists = _lists(tuple(v[corner] for v in values), np.append(begin, len(cell)))
            yield pa.record_batch({"shard": (found % shards).astype(np.int32), "id": batch["id"].take(pa.array(found // shards))} | lists)

    return rows.select("id", *_LISTS).mapInArrow(run, f"shard int, id long, {_CORNERS}")


def _by_shards(every: DataFrame, corners: DataFrame, size: tuple[int, int], shards: int, n_corners: int, n_queries: int) -> DataFrame:
    """_FOUND of all images, in rows by block of queries; the index is shuffled in shards."""
    slices = max(1, -(-n_corners * SENT * min(shards, size[0]) // (shards * SLICE_BYTES)))
    blocks = -(-n_queries // BLOCK)
    images = _sharded(every, size, shards).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    index = _sharded(corners, size, shards).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def meet(key, mine, asked):
        out = []
        for ids, queries, place, other in Index(asked, size, shards, key[0].as_py()).matches(mine):
            block = _shard_of(queries, blocks)
            order = np.lexsort((block, ids))
            ids, block, queries = ids[order], block[order], queries[order]
            match = np.column_stack([place, other])[order].astype(np.float32)
            offsets = _runs(ids, block)
            begin = offsets[:-1]
            lists = {c: pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(v)) for c, n, v in (("q", offsets, queries), ("m", offsets * 8, match.ravel()))}
            out.append(pa.table({"id": ids[begin], "block": block[begin].astype(np.int32)} | lists))
        return pa.concat_tables(out)

    by = ("shard", "slice")
    met = images.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(meet, "id long, block int, q array<long>, m array<float>")
    gathered = met.groupBy("id", "block").agg(F.collect_list(F.struct("q", "m")).alias("all"))

    def vote(batches):
        for batch in batches:
            ids = np.repeat(batch["id"].to_numpy(), batch["q"].value_lengths().to_numpy())
            match = batch["m"].flatten().to_numpy().reshape(-1, 8).astype(np.float64)
            yield _voted(ids, batch["q"].flatten().to_numpy(), match[:, :4], match[:, 4:])

    return gathered.select("id", F.flatten("all.q").alias("q"), F.flatten("all.m").alias("m")).mapInArrow(vote, _FOUND)


def copies(images: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, found) of images that are copies: found has (query, inliers) of each query; images and queries have one row for each class of equal images.

    If there are very many queries, an image found by queries of several blocks has a row for each.
    """
    every = C.materialize(descriptors(images))
    corners = C.materialize(every.join(C.sized(C.materialize(queries.select("id")), 16), "id", "left_semi"))
    n_queries, asked = corners.agg(F.count("*"), F.coalesce(F.sum(F.size("d0")), F.lit(0))).first()
    size = tables_for(asked)
    if asked * (ENTRY + (KEY + POST) * size[0]) <= INDEX_BYTES:
        return _by_broadcast(every, corners, size)
    # With many shards nearly each key of a corner is in another one.
    shards = -(-asked * size[0] * (ENTRY + KEY * size[0] + POST) // INDEX_BYTES)
    return _by_shards(every, corners, size, shards, every.agg(F.sum(F.size("d0"))).first()[0], n_queries)


def find_copies(images: DataFrame, is_query) -> DataFrame:
    """A row for every image row: id, class_id (smallest id of equal pixels), n_queries, best_query, best_inliers.

    is_query: a condition on id. A class is a query if any of its ids is. Queries are named by their class_id;
    best_query is the one with most inliers, the smallest of equals, else null.
    """
    side = F.sqrt(F.octet_length("pixels")).cast("int")
    size = [(F.col(c).cast("int") if c in images.columns else side).alias(c) for c in ("width", "height")]
    rows = C.bounded(images).select(F.col("id").cast("long").alias("id"), "pixels", *size)
    same = F.concat_ws("x", F.coalesce("width", F.lit(-1)), F.coalesce("height", F.lit(-1)))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(same.cast("binary"), "pixels"))))
    keyed = C.materialize(rows.select("id", "key"))
    classes = C.materialize(keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked")).where("key is not null"))
    own = classes.where("class_id is not null").select(F.col("class_id").alias("id"), "asked", "key")
    reps = rows.join(C.sized(own.select("id", "key"), 48), ["id", "key"], "left_semi")
    # Pixels are only dealt out anew where rows are repeated.
    if not keyed.where("id is not null").groupBy("id", "key").count().where("count > 1").isEmpty():
        reps = reps.dropDuplicates(["id"])
    found = copies(reps.select("id", "pixels", "width", "height"), own.where("asked").select("id"))
    most = F.array_max(F.transform("found", lambda f: F.struct(f["inliers"].alias("inliers"), (-f["query"]).alias("least"))))
    best = found.groupBy(F.col("id").alias("class_id")).agg(F.sum(F.size("found")).alias("n_queries"), F.max(most).alias("best"))
    out = keyed.join(classes.select("key", "class_id"), "key", "left").withColumn("class_id", F.coalesce("class_id", "id")).join(best, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), (-F.col("best.least")).alias("best_query"), F.col("best.inliers").alias("best_inliers"))


#: Fixed list: the edits of copies that render() draws.
EDITS = ("quarter turn, cropped, brighter", "turn of 10 degrees", "turn of 30 degrees", "scale 0.85", "cropped to a half", "noise")


def warped(image: np.ndarray, degrees: float, scale: float) -> np.ndarray:
    """An image turned about its middle and scaled, grey where nothing is."""
    h, w = image.shape
    height, width = round(h * scale), round(w * scale)
    y, x = np.mgrid[:height, :width]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    u, v = (x - (width - 1) / 2) / scale, (y - (height - 1) / 2) / scale
    x, y = c * u + s * v + (w - 1) / 2, c * v - s * u + (h - 1) / 2
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    return np.where(inside, _sampled(image[None], np.zeros(x.shape, int), y, x), 128)


def edited(image: np.ndarray, edit: str, seed: int) -> np.ndarray:
    """The image with one of EDITS."""
    if edit == EDITS[0]:
        k = SIDE // 12
        return np.pad(np.rot90(np.minimum(image + 12, 255))[k:, k:], ((0, k), (0, k)), constant_values=128)
    if edit in EDITS[1:3]:
        return warped(image, 10 if edit == EDITS[1] else 30, 1.0)
    if edit == EDITS[3]:
        return warped(image, 0, 0.85)
    if edit == EDITS[4]:
        return image[:, : image.shape[1] // 2]
    return np.clip(image + np.random.default_rng(seed).normal(0, 8, image.shape), 0, 255)


def render(vectors: DataFrame) -> DataFrame:
    """(id, pixels, width, height) from embeddings (vec_id, embedding of 64 numbers): a texture of 8 x 8 waves each, as the tables have no images.

    Of every twentieth vector there is also an edited copy, id -1 - vec_id, the edits of EDITS in turn.
    """

    def draw(batches):
        waves = np.cos(np.pi * np.outer(np.arange(3, 19, 2), 2 * np.arange(SIDE) + 1) / (2 * SIDE))
        for batch in batches:
            rows = []
            for i, v in zip(batch["vec_id"].to_pylist(), batch["embedding"], strict=True):
                v = np.nan_to_num(np.array(v.as_py() if v.is_valid else [], np.float32))
                if len(v) != 64:
                    rows.append((i, None, None, None))
                    continue
                image = waves.T @ v.reshape(8, 8) @ waves
                image = np.floor(20 + 200 * (image - image.min()) / max(float(np.ptp(image)), 1e-9))
                drawn = [(i, image)]
                if i is not None and i % 20 == 0:
                    drawn.append((-1 - i, edited(image, EDITS[i // 20 % len(EDITS)], i)))
                rows += [(k, x.astype(np.uint8).tobytes(), x.shape[1], x.shape[0]) for k, x in drawn]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "pixels", "width", "height"])

    return C.bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(draw, "id long, pixels binary, width int, height int")


def query(spark, sf_dir: str) -> DataFrame:
    """Queries: every image whose id is divisible by 100, against all images and edited copies."""
    images = render(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return find_copies(images, F.col("id") % 100 == 0)
