"""SentencePiece BPE encoding over a prefix table, and decoding.

Input: a table with text. Ids are those of the sentencepiece library for a BPE model with an
identity normalizer and byte fallback: a space becomes U+2581, one is put before a text that isn't
empty, and only an end id is added. Null and empty texts get the end id alone and decode to nothing.

How: no piece of the model crosses from letters to others or on to U+2581 (checked when it is read), so a
text falls into segments that can be encoded apart and remembered. In a segment every prefix that can be
encoded has one last token: the only automaton match ending there that is compatible with the last
token before it, that is, the two encode to themselves side by side. The ids are read backwards from
the end. Runs of U+2581 have merges of equal score, whose order depends on their place in the
segment; segments with such runs are merged step by step instead. Prefixes are shared only between segments of
at most SHARED characters, and only these are remembered; a longer one has an array of last tokens by position.
"""

import hashlib
import heapq
import re
from array import array
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
#: Letters, digits, or others, with the spaces before them; spaces stand for U+2581 throughout.
_SEGMENT = re.compile(r" *[^\W\d_²³¹¼½¾]+| *(?:[^\w ]|[_²³¹¼½¾])+| *\d+| +")
#: Segments remembered by a worker; when so many are new, the older ones are forgotten.
REMEMBERED = 160_000
#: Compatible pairs, and prefixes, likewise.
PAIRS = 300_000
PREFIXES = 250_000
#: The most characters of a segment whose prefixes go to the shared table, as all of them together grow with its square.
SHARED = 64


class _Known(dict):
    """Segments met lately: their ids as text with a space behind each, and the ids themselves."""

    def __init__(self, owner: "PieceModel", older: dict):
        self.owner, self.older = owner, older

    def __missing__(self, segment: str) -> tuple[str, tuple]:
        found = self.older.get(segment)
        if found is None:
            ids = self.owner.segment_ids(segment)
            found = "".join(map(self.owner.shown.__getitem__, ids)), tuple(ids)
        if len(segment) > SHARED:
            return found
        self[segment] = found
        return found


class PieceModel:
    """Tables of a model, made once for a worker process."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i).replace(SPACE, " "): i for i in plain}
        self.piece = {i: p for p, i in self.ids.items()}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.end = sp.eos_id()
        if any(_SEGMENT.findall(p) != [p] for p in self.ids) or len(self.byte_id) != 256:
            raise ValueError("this model has pieces across segments or no byte fallback")
        self.automaton = ahocorasick.Automaton()
        self.split: dict = {}
        for p in self.ids:
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (self.ids[p], len(p)))
                self.split[p] = self.last_merge
        self.right_edge = {p: self._edge(p, 1) for p in self.split}
        self.left_edge = {p: self._edge(p, 0) for p in self.split}
        self.automaton.make_automaton()
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.text = {i: bytes([b]) for i, b in self.byte_of.items()} | {i: p.encode() for i, p in self.piece.items()} | {self.end: b""}
        self.shown = {i: f"{i} " for i in self.text}
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        self.longest = max(self.length.values())
        self.compatible: dict = {}
        self.prefixes: dict = {}
        self.known = _Known(self, {})

    def merged(self, text: str) -> list[str]:
        """BPE as defined: the best-scored neighbours merge first, the leftmost of equals."""
        part, n = list(text), len(text)
        self.last_merge = None
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not part[i] or not part[j] or right[i] != j or len(part[i]) + len(part[j]) != size:
                continue
            self.last_merge = part[i], part[j]
            part[i] += part[j]
            part[j] = ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p]

    def _edge(self, piece: str, side: int) -> list:
        """The pieces that stand at one end of a piece while it is made, the last first: each with the
        step at which it was made and the step that uses it up. A step is a score, negated."""
        out, until = [], float("inf")
        while True:
            parts = self.split[piece]
            made = -self.score[piece] if parts else float("-inf")
            out.append((piece, made, until))
            if not parts:
                return out
            piece, until = parts[side], made

    def fits(self, first: int, second: int) -> bool:
        """Whether two pieces, side by side, encode to themselves.

        They don't if pieces that meet at the border at some step merge before either is used up;
        of equal steps the one further left comes first.
        """
        for x, made_x, until_x in self.right_edge[self.piece[first]]:
            for y, made_y, until_y in self.left_edge[self.piece[second]]:
                if made_x < until_y and made_y < until_x and (s := self.score.get(x + y)) is not None and -s < until_x and -s <= until_y:
                    return False
        return True

    def compatible_pair(self, pair: int) -> bool:
        good = self.compatible.get(pair)
        if good is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            good = self.compatible[pair] = self.fits(pair >> 20, pair & 0xFFFFF)
        return good

    def by_positions(self, segment: str) -> list[int]:
        """As by_prefixes(), with one array for the segment alone."""
        last, known = array("i", bytes(4 * (len(segment) + 1))), 0
        for end, (piece, size) in self.automaton.iter(segment):
            if end < known:
                continue
            end += 1
            if end == size or self.compatible_pair(last[end - size] << 20 | piece):
                last[end] = piece
                known = end
        out, n = [], len(segment)
        while n:
            out.append(piece := last[n])
            n -= self.length[piece]
        out.reverse()
        return out

    def by_prefixes(self, segment: str) -> list[int]:
        """The ids of a segment whose characters are all pieces.

        The table holds the last token of every prefix met so far, in any segment; only the others are worked out.
        """
        if len(segment) > SHARED:
            return self.by_positions(segment)
        table = self.prefixes
        if len(table) > PREFIXES:
            table.clear()
        n = len(segment)
        known, most = 0, n
        while known < most:
            at = (known + most + 1) >> 1
            if segment[:at] in table:
                known = at
            else:
                most = at - 1
        if known < n:
            for end, (piece, size) in self.automaton.iter(segment, max(0, known - self.longest)):
                if end < known:
                    continue
                end += 1
                if end != size and not self.compatible_pair(table[segment[: end - size]] << 20 | piece):
                    continue
                table[segment[:end]] = piece
                known = end
        out = []
        while n:
            out.append(piece := table[segment[:n]])
            n -= self.length[piece]
        out.reverse()
        return out

    def segment_ids(self, segment: str) -> list[int]:
        if "  " in segment:
            return [x for p in self.merged(segment) for x in ([self.ids[p]] if p in self.ids else [self.byte_id[b] for b in p.encode()])]
        if self.characters.issuperset(segment):
            return self.by_prefixes(segment)
        out, begin = [], 0
        for i, c in enumerate(segment):
            # Nothing merges with a character that is no piece.
            if c not in self.characters:
                out += self.by_prefixes(segment[begin:i])
                out += [self.byte_id[b] for b in c.encode()]
                begin = i + 1
        return out + self.by_prefixes(segment[begin:])

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: control ids stand for nothing, and the space that encoding puts in front is dropped."""
        return b"".join(map(self.text.__getitem__, ids)).removeprefix(b" ")

    def encode(self, text: str) -> tuple[str, list[int]]:
        """All ids with the end id: joined by spaces, and as numbers."""
        if not text:
            return str(self.end), [self.end]
        if len(self.known) > REMEMBERED:
            self.known.older = {}
            self.known = _Known(self, dict(self.known))
        shown, ids = zip(*map(self.known.__getitem__, _SEGMENT.findall(" " + text.replace(SPACE, " "))), strict=True)
        return "".join(shown) + str(self.end), [*chain.from_iterable(ids), self.end]

    def forget(self) -> None:
        """Free what was remembered; a worker process lives on after its task."""
        self.known = _Known(self, {})
        self.compatible.clear()
        self.prefixes.clear()


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns of docs, with ids (array of int, end id last), n_tokens and decoded.

    model_path must name the same file on every executor. A column of docs with one of these names is replaced.
    """
    docs = C.bounded(docs).drop("ids", "n_tokens", "decoded")

    def run(batches):
        m = model(model_path)
        try:
            for batch in batches:
                ids = [m.encode(t.as_py())[1] for t in batch["text"]]
                decoded = [m.decode(x).decode() for x in ids]
                yield pa.record_batch({f.name: batch[f.name] for f in batch.schema} | {"ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array(map(len, ids), pa.int64()), "decoded": pa.array(decoded, pa.string())})
        finally:
            m.forget()

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>", "n_tokens long", "decoded string"]))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns of docs but text, with n_tokens and the digests of ids and decoded text.

    The same as digests over encode_pieces(), without carrying the ids and texts themselves to the JVM.
    """
    docs = C.bounded(docs).drop("n_tokens", "ids_sha256", "decoded_sha256")

    def run(batches):
        m = model(model_path)
        try:
            for batch in batches:
                found = []
                for t in batch["text"]:
                    shown, ids = m.encode(t.as_py())
                    found.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(m.decode(ids)).hexdigest()))
                n, of_ids, of_text = zip(*found, strict=True) if found else ((), (), ())
                yield pa.record_batch({f.name: batch[f.name] for f in batch.schema if f.name != "text"} | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})
        finally:
            m.forget()

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return piece_digests(docs, default_model())
