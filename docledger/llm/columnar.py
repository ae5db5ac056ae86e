"""Words and shingles of Arrow string columns as numpy arrays, without a Python object for each word."""

import hashlib
import secrets as randomness
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are taken in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 20

_code = np.arange(256)
#: `[^\x20\x09-\x0D]+` are the words.
SPACES = (_code == 32) | ((_code >= 9) & (_code <= 13))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` are the words, once A-Z are lower-cased.
NON_ALNUM = (_code < 128) & ~((_code >= 48) & (_code <= 57)) & ~((_code >= 97) & (_code <= 122))
_LOWER = np.where((_code >= 65) & (_code <= 90), _code + 32, _code).astype(np.uint8)

#: What a word's hash begins with, by its length; an arbitrary fixed key.
_KEY = U(0x9E6C63D0876A9A63)
#: Words over so many bytes are hashed one by one.
_LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_PLACE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def fresh_keys() -> tuple[int, int]:
    """Keys of one call of an operator, drawn on the driver: nobody can write words that share hashes before they are drawn."""
    return randomness.randbits(64), randomness.randbits(64)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time go through mix(), each step keyed by the one before, the first by key.

    Spans of one length of at most eight bytes never share a hash.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = ends - starts
    h = mix((size.astype(U) * U(0xD6E8FEB86659FD93) + _KEY) ^ U(key))
    at = np.flatnonzero(size <= _LONG)
    done = 0
    while len(at):
        left = size[at] - done
        h[at] = mix(h[at] ^ (eight[starts[at] + done] & _KEEP[np.minimum(left, 8)]))
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return h


class Words:
    """The words of a chunk of texts: hashes, byte spans, and each text's first word.

    hash and second are 64 bits each, under keys of their own; where both are compared a word stands for 128 bits.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool, keys: tuple[int, int] = (0, 1)):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~separators[self.data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.keys = keys
        self.hash = _hashed(self.data, self.starts, self.ends, keys[0])
        self.first = np.searchsorted(self.starts, offsets)

    @cached_property
    def second(self) -> np.ndarray:
        return _hashed(self.data, self.starts, self.ends, self.keys[1])

    def bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def runs(h: np.ndarray, k: int, more: int = 0) -> np.ndarray:
    """One hash for every k consecutive entries of h (also across texts; callers cut by text).

    Another number `more` gives hashes that are independent of the first.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(k))
    if more:
        h = mix(h + U(more))
    for j in range(k):
        out += h[j : n + j] * _PLACE[j]
    return mix(out)


def both_runs(h: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """As runs(), of words that both hashes stand for: words that share one of them don't share the run's."""
    return mix(runs(h, k) * _PLACE[255] + runs(second, k, 1))


def chunks(texts: pa.Array, separators: np.ndarray, lower: bool, keys: tuple[int, int] = (0, 1)):
    """(first row, end row, Words) over a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separators, lower, keys)
        lo = hi
