"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Input: turns with conv_id, turn, role and text. Roles count by their initial; a legal conversation is (s?(ua)+)?. A row's first
fault counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation),
truncated (its last character that isn't white space is none of . ! ?). Edits: Keep (0), Rerole to user or assistant (1), Delete
(2; blank and duplicate rows must go), Insert a user or assistant row with empty text (5). A truncated row that isn't deleted
adds 5. The audit is the edits' initials in order; of equal costs the ASCII-least.

Defined results: rows go by turn (nulls first), then role and text. Null role or text is one space. Rows with a null conv_id
are one conversation. Repeated rows are rows of their own (so duplicates). Roles with another initial can't be kept.
Other columns are not carried.

How: one shuffle by conversation gives positions and faults by windows, which spill. A conversation's signature has one letter for
each row; equal signatures meet once. Distinct signatures are ranged by their reverse, so that those with a
common ending are neighbours: a task walks them in order and keeps the path of the automaton of shared suffixes, whose
nodes get their cost-to-go and best edit for each state of the grammar once, when they are added; an audit follows these
edits from node to node. Nodes of the border between two tasks are made twice. A last shuffle brings each audit in front of
its rows, and the repaired text is hashed as it streams by. Of a single huge conversation only the signature and
audit (a letter a row) are held as a whole; its rows pass one task in order, as its one hash must.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
_FAR = 1 << 60
#: States of the grammar: nothing yet, after system, after user, after assistant. The only role that may be added to each:
_ADDED = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_STATE = {"s": 1, "u": 2, "a": 3}
_NONBLANK = r"[^\x20\x09-\x0D]"


def _settled(direct: list[tuple]) -> tuple[tuple, tuple]:
    """Costs, and (edit, next state), of each state once rows may also be inserted before the node."""
    best = list(direct)
    for q in (2, 3):
        best[q] = min(direct[q], (INSERT + direct[_ADDED[q]][0], "I", _ADDED[q]))
    for q in (0, 1):
        best[q] = min(direct[q], (INSERT + best[2][0], "I", 2))
    return tuple(b[0] for b in best), tuple(b[1:] for b in best)


@lru_cache(1 << 12)
def _before(letter: str, after: tuple) -> tuple[tuple, tuple]:
    """The node of a row in front of a node with costs `after`. Its edits begin with unlike letters, so a tie is settled by the first."""
    role, late = letter.lower(), TRUNCATED * letter.isupper()
    direct = []
    for q in range(4):
        ways = [(DELETE + after[q], "D", q)]
        if role != "d":
            to = _STATE.get(role)
            if to and (to == _ADDED[q] or (to == 1 and q == 0)):
                ways.append((late + after[to], "K", to))
            ways.append((late + REROLE + after[_ADDED[q]], "R", _ADDED[q]))
        direct.append(min(ways))
    return _settled(direct)


_END = _settled([(0, "", 0), (_FAR, "", 1), (_FAR, "", 2), (0, "", 3)])


def suffix_audits(words):
    """(word, cost, audit) of signatures written backwards and sorted: the path of the suffix automaton is kept between them."""
    path, known = [(0, *_END)], ""
    for word in words:
        shared = 0
        while shared < min(len(word), len(known)) and word[shared] == known[shared]:
            shared += 1
        del path[shared + 1 :]
        for letter in word[shared:]:
            base, costs, _ = path[-1]
            costs, edits = _before(letter, costs)
            least = min(costs)
            path.append((base + least, tuple(c - least for c in costs), edits))
        known = word
        at, q, audit = len(word), 0, []
        while path[at][2][q][0]:
            edit, q = path[at][2][q]
            audit.append(edit)
            at -= edit != "I"
        yield word, path[-1][0] + path[-1][1][0], "".join(audit)


def _audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures."""

    def table(rows):
        words, costs, audits = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([w[::-1] for w in words]), pa.array(costs, pa.int64()), pa.array(audits)], ["signature", "cost", "audit"])

    def run(batches):
        rows, size = [], 0
        for row in suffix_audits(w for batch in batches for w in batch.column(0).to_pylist()):
            rows.append(row)
            size += len(row[2]) + 64
            if size > 1 << 20:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    words = signatures.select(F.reverse("signature").alias("word")).repartitionByRange("word").sortWithinPartitions("word")
    return C.materialize(words.mapInArrow(run, "signature string, cost bigint, audit string"))


class _Repair:
    """Follows an audit over a conversation's rows and hashes the repaired conversation."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at, self.state, self.hash, self.lines = head, head["audit"], 0, 0, hashlib.sha256(), 0

    def _line(self, role: str, text: str, state: int) -> None:
        self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines, self.state = self.lines + 1, state

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            to = _ADDED[self.state]
            self._line(_NAMES[to], "", to)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, to = self.audit[self.at], _ADDED[self.state]
        self.at += 1
        if edit == "K":
            self._line(role, text, _STATE[role[:1]])
        elif edit == "R":
            self._line(_NAMES[to], text, to)

    def result(self) -> dict:
        self.inserts()
        return self.head | {"repaired_sha256": self.hash.hexdigest()}


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _repaired(rows: DataFrame, heads: DataFrame, kind: str) -> DataFrame:
    """heads with repaired_sha256; rows has conv_id, pos, role, text."""
    names = ["conv_id", *_COUNTS, "cost", "audit"]
    fields = F.struct(*names[1:]).alias("head")
    both = rows.select("conv_id", "pos", "role", "text", F.lit(None).cast(heads.select(fields).schema["head"].dataType).alias("head"))
    both = both.unionByName(heads.select("conv_id", F.lit(0).alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), fields))
    schema = pa.schema([*[(c, pa.int64()) for c in [*_COUNTS, "cost"]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, of = None, None
        for batch in batches:
            done, ids = [], []
            for conv, pos, role, text, head in zip(*[c.to_pylist() for c in batch.columns]):
                if pos == 0:
                    if now:
                        done.append(now.result())
                        ids.append(of)
                    now, of = _Repair(head), conv
                else:
                    now.row(role, text)
            of_type = batch.schema.field(0).type
            if done:
                yield table(ids, done, of_type)
        if now:
            yield table([of], [now.result()], of_type)

    def table(ids, done, of_type):
        rest = pa.RecordBatch.from_pylist(done, schema)
        return pa.RecordBatch.from_arrays([pa.array(ids, of_type), *rest.columns], ["conv_id", *schema.names])

    out = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in [*_COUNTS, "cost"]) + ", audit string, repaired_sha256 string"
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, out)


def _faults(turns: DataFrame) -> DataFrame:
    """turns with pos, fault, initial, the pair with the row before, and whether the turn is new; dropped rows have them apart."""
    initial = F.substring("role", 1, 1)
    order = Window.partitionBy("conv_id", "dropped").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("pos")
    rows = turns.repartition("conv_id").withColumns({"pos": F.row_number().over(order), "illegal": ~F.concat(F.lag(initial).over(order), initial).isin("su", "ua", "au"), "new": F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn"))})
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(~F.col("text").rlike(_NONBLANK), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    rows = rows.withColumn("fault", F.when(~F.col("dropped"), fault))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return rows.select("conv_id", "turn", "role", "text", "dropped", "pos", "fault", "illegal", "new", letter.alias("letter"))


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    turns has conv_id, turn, role, text; rows with a true column `dropped`, where there is one, are not there but for their conv_id.
    """
    C.bounded(turns)
    kind = dict(turns.dtypes)["conv_id"]
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    turns = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], dropped.alias("dropped"))
    rows = C.materialize(_faults(turns))
    there = ~F.col("dropped")
    turn = F.when(there, F.col("turn"))
    number = lambda what: F.count(F.when(there & what, 1))
    letters = F.array_sort(F.collect_list(F.when(there, F.struct("pos", "letter"))))
    convs = rows.groupBy("conv_id").agg(
        F.coalesce((F.max(turn) - F.min(turn) + 1).cast("long") - number(F.col("new")), F.lit(0).cast("long")).alias("gaps"),
        *[number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        number(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("signature"),
    )
    convs = C.materialize(convs)
    audits = _audits(convs.select("signature").distinct())
    heads = convs.join(C.sized_by(audits, "signature", 100), "signature").select("conv_id", *_COUNTS, "cost", "audit")
    return _repaired(rows.where(there), heads, kind)


def damage(turns: DataFrame) -> DataFrame:
    """turns after the contract's damage: a row is dropped (marked), emptied, stripped of its stops, repeated or given to the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _oracle() -> str:
    """Every conversation by itself, row by row from its end; the candidates of a state are sorted."""
    added = {0: 2, 1: 2, 2: 3, 3: 2}
    line = {2: "user:\n", 3: "assistant:\n"}

    def way(cost: str, edit: str, tail: str, text: str) -> str:
        return f"{{'c': ({cost} + {tail}.c)::bigint, 'a': '{edit}' || {tail}.a, 't': {text} || {tail}.t}}"

    direct = []
    for q in range(4):
        keep = f"case when initial = 'u' then {way('late', 'K', 'b2', 'line')} {'when initial = $$s$$ then ' + way('late', 'K', 'b1', 'line') if q == 0 else ''} end" if q != 2 else f"case when initial = 'a' then {way('late', 'K', 'b3', 'line')} end"
        rerole = way("1 + late", "R", f"b{added[q]}", f"'{line[added[q]][:-1]}' || text || chr(10)")
        direct.append(f"list_sort(list_filter([{way('2', 'D', f'b{q}', repr(''))}, case when not must then {keep} end, case when not must then {rerole} end], lambda x: x is not null))[1] d{q}")
    insert = lambda tail, q: way("5", "I", tail, "'" + line[added[q]].replace("\n", "") + "' || chr(10)")
    two = "list_sort([d2, {0}])[1]".format(insert("d3", 2))
    bests = [f"list_sort([d0, {insert(two, 0)}])[1] b0", f"list_sort([d1, {insert(two, 1)}])[1] b1", f"{two} b2", f"list_sort([d3, {insert('d2', 3)}])[1] b3"]
    end = ["{'c': 0::bigint, 'a': '', 't': ''}", "{'c': 10::bigint, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}", "{'c': 5::bigint, 'a': 'I', 't': 'assistant:' || chr(10)}", "{'c': 0::bigint, 'a': '', 't': ''}"]
    white = r"\x20\x09-\x0D"
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({key}, ''), lambda c: ascii(c)::bigint)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"
    return rf"""with recursive keyed as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, {crc} % 20 k from conversations),
    damaged as (select conv_id, turn, case k when 4 then 'user' else r end as role, case k when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end as text, unnest(case k when 3 then [0, 1] else [0] end) copy from keyed where k <> 0),
    numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos, count(*) over (partition by conv_id) total from damaged),
    marked as (select *, left(role, 1) initial, lag(left(role, 1)) over (partition by conv_id order by pos) before,
        case when not regexp_matches(text, '[^{white}]') then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][{white}]*$') then 'truncated' else '' end fault from numbered),
    steps as (select conv_id, pos, total, initial, text, role || ':' || text || chr(10) line, fault in ('blank', 'duplicate') must, case fault when 'truncated' then 5 else 0 end late from marked),
    walk as (select conv_id, total + 1 pos, {end[0]} b0, {end[1]} b1, {end[2]} b2, {end[3]} b3 from (select distinct conv_id, total from steps)
        union all select conv_id, pos, {', '.join(bests)} from (select s.conv_id, s.pos, {', '.join(direct)} from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.pos = w.pos - 1)),
    counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) illegal from marked group by conv_id)
    select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) illegal, coalesce(w.b0.c, 0)::bigint as cost, coalesce(w.b0.a, '') audit, sha256(coalesce(left(w.b0.t, length(w.b0.t) - 1), '')) repaired_sha256
    from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join walk w on w.conv_id is not distinct from o.conv_id and w.pos = 1"""


ORACLE_SQL = _oracle()
