"""Operator 11: conversation structure repair by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn, and one pass of mapInPandas-like Arrow
batches carries the state of a dynamic program over the roles from row to row, across batches. A
conversation must read (s?(ua)+)?: nothing, or an optional system row and then user and assistant in
turn. A row is kept (cost 0), given another role (1) or deleted (2; a must for blank and duplicate rows),
empty rows are inserted (5), and a truncated row that stays adds 5.

The order within the task is from the last turn to the first, so that the state is the least cost of the
rest of the conversation from each of the four states of that pattern. What is best to do with a row in
each state is then final when it is read - the least letter of the cheapest edits - and takes one byte.
A forward walk along these bytes gives the edits that are ASCII-least among all the cheapest ones.

The bytes and rows of a conversation are held until its first turn is read. Beyond SPILL_BYTES they go,
block by block, to a temporary file of the task, which is read back from its end; so memory is bounded
by the block, and by the largest row, however long a conversation is. A task that is run again starts
anew. Duplicates are found before that by a window over the same partitioning, sorted by role and text,
so that no set of seen rows is held. A conversation is one task's, by the method; its work is a few
operations a row.

repaired() gives a report row for each conversation (position 0) and then a row for each edit, in order;
digests() folds them, without a shuffle, into one row a conversation.

Defined cases: null roles, texts, and ids and turns in the hash that decides on damage, are one space;
the null conversation is one of its own; rows are in order of turn (nulls first), then role, then text,
and a repeated row stands behind its original; a role counts by its first character, and a row of
the empty role is never kept as it is; a conversation without rows is reported with zeros; an empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .line_dedup import SPACE
from .shared import table
from .text import give_back

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States: nothing yet, after system, after user, after assistant; the role that may be inserted in each,
#: and where a role leads. The pattern may end in START and ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
TURN = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
LETTERS = DELETE + INSERT + KEEP + REROLE  # in ASCII order: two bits a state
FAR = 1 << 60
SPILL_BYTES = 4 << 20
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = "conv_id long, position long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Rows of an output batch at most; a batch also ends at OUT_BYTES of text.
OUT_ROWS, OUT_BYTES = 5000, 4 << 20


def stripped(text):
    return F.btrim(text, F.lit(SPACE))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone: one row in five damaged by its hash; those that are dropped stay, marked as gone."""
    number = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20).cast("int")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    hurt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return hurt.select(
        "conv_id", "turn", F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), gone.alias("gone"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form of damaged()."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with their first fault (0: none), each conversation in one partition, from its last row to its first."""
    dealt = rows.repartition("conv_id")
    text = stripped(F.col("text"))
    blank = F.octet_length(text) == 0
    h = F.xxhash64("role", "text")
    earlier = Window.partitionBy("conv_id", "gone", "h", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    nth = dealt.withColumn("h", h).withColumn("nth", F.row_number().over(earlier))
    fault = F.when(blank, BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(text, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    # equal rows stand in the order of nth, which follows turn and copy
    return nth.select("conv_id", "turn", "role", "text", "nth", "gone", fault.alias("fault")).sortWithinPartitions(
        "conv_id", "gone", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")
    )


class Backlog:
    """A stack of small records; beyond SPILL_BYTES its lower part lies in a temporary file."""

    def __init__(self) -> None:
        self.held, self.size, self.blocks, self.file = [], 0, [], None

    def push(self, record: tuple, size: int) -> None:
        self.held.append(record)
        self.size += size
        if self.size > SPILL_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            pickle.dump(self.held, self.file, protocol=pickle.HIGHEST_PROTOCOL)
            self.blocks.append(at)
            self.held, self.size = [], 0

    def popped(self) -> Iterator[tuple]:
        """All records, the last first."""
        yield from reversed(self.held)
        self.held = []
        for at in reversed(self.blocks):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))
        if self.file is not None:
            self.file.close()


def settle(best: list[tuple[int, str]]) -> tuple[list[int], int]:
    """Costs and choices, two bits a state, where a row may be inserted before what best has in each state
    (cost, letter). Two insertions lead round in a circle, so one step is enough behind USER and ASSISTANT."""
    u, a = best[USER], best[ASSISTANT]
    out = [None, None, min(u, (a[0] + COST[INSERT], INSERT)), min(a, (u[0] + COST[INSERT], INSERT))]
    for s in (START, SYSTEM):
        out[s] = min(best[s], (out[USER][0] + COST[INSERT], INSERT))
    return [c for c, _ in out], sum(LETTERS.index(x) << 2 * s for s, (_, x) in enumerate(out))


def before(costs: list[int], role: str, fault: int) -> tuple[list[int], int]:
    """Costs and choices in front of a row, from the costs behind it."""
    best = []
    for s in range(4):
        options = [(costs[s] + COST[DELETE], DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if role[:1] in NEXT[s]:
                options.append((costs[NEXT[s][role[:1]]] + more, KEEP))
            options.append((costs[NEXT[s][TURN[s]]] + COST[REROLE] + more, REROLE))
        best.append(min(options))
    return settle(best)


#: At the end: what it costs to end in each state.
END = settle([(0, KEEP), (FAR, KEEP), (FAR, KEEP), (0, KEEP)])


def letter(choices: int, state: int) -> str:
    return LETTERS[choices >> 2 * state & 3]


class Conversation:
    """The state of one conversation, fed with its rows from the last to the first."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.costs, self.rows = conv_id, END[0], Backlog()
        self.faults, self.illegal, self.after = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.costs, choices = before(self.costs, role, fault)
        self.rows.push((choices, role, text), len(role) + len(text) + 100)
        self.faults[fault] += 1
        if self.after is not None and role[:1] + self.after not in ("su", "ua", "au"):
            self.illegal += 1
        self.after = role[:1]
        if turn is not None and turn != self.low:  # turns come in falling order
            self.turns += 1
            self.high = turn if self.high is None else self.high
            self.low = turn

    def edits(self) -> Iterator[tuple]:
        """The report, then each edit in order, as rows of SCHEMA."""
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        _, blank, duplicate, cut = self.faults
        yield (self.conv_id, 0, None, None, None, gaps, blank, duplicate, cut, self.illegal, self.costs[START])
        state, at = START, 0
        for choices, role, text in self.rows.popped():
            while letter(choices, state) == INSERT:
                at += 1
                yield (self.conv_id, at, INSERT, ROLE[TURN[state]], "", *NONE)
                state = NEXT[state][TURN[state]]
            at, x = at + 1, letter(choices, state)
            if x == DELETE:
                yield (self.conv_id, at, DELETE, None, None, *NONE)
                continue
            first = role[:1] if x == KEEP else TURN[state]
            yield (self.conv_id, at, x, role if x == KEEP else ROLE[first], text, *NONE)
            state = NEXT[state][first]
        while letter(END[1], state) == INSERT:
            at += 1
            yield (self.conv_id, at, INSERT, ROLE[TURN[state]], "", *NONE)
            state = NEXT[state][TURN[state]]


NONE = (None,) * len(COUNTS)


def batches_of(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; strings count as their length."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [pa.int64() if k == "long" else pa.string() for k in kinds]
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == OUT_ROWS or size > OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            some = b.slice(at, 1000)
            yield from zip(*(some.column(n).to_pylist() for n in names))


def repaired(ordered: DataFrame) -> DataFrame:
    """The edits of every conversation of in_order(): a report (position 0, with the counts), then a row for
    each edit K, R, D or I with the role and text that it leaves (none for D)."""

    def rows(batches):
        held = None
        for conv_id, turn, role, text, gone, fault in columns(batches, ("conv_id", "turn", "role", "text", "gone", "fault")):
            if held is None or conv_id != held.conv_id:
                if held is not None:
                    yield from held.edits()
                held = Conversation(conv_id)
            if not gone:
                held.add(turn, role, text, fault)
        if held is not None:
            yield from held.edits()

    def run(batches):
        yield from batches_of(rows(batches), SCHEMA)
        give_back()

    return ordered.mapInArrow(run, SCHEMA)


def repair(conversations: DataFrame) -> DataFrame:
    """repaired() of conversations (conv_id, turn, role, text)."""
    return repaired(in_order(undamaged(conversations)))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation from the rows of repaired(), as they come: the counts, the edits' letters,
    and the SHA-256 of the repaired lines role:text."""

    def rows(batches):
        held = None
        for conv_id, position, edit, role, text, *counts in columns(batches, tuple(f.split()[0] for f in SCHEMA.split(", "))):
            if position == 0:
                if held is not None:
                    yield (*held, audit.decode(), h.hexdigest())
                held, audit, h, joint = (conv_id, *counts), bytearray(), hashlib.sha256(), b""
                continue
            audit += edit.encode()
            if edit != DELETE:
                h.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
        if held is not None:
            yield (*held, audit.decode(), h.hexdigest())

    def run(batches):
        yield from batches_of(rows(batches), DIGEST)

    return edits.mapInArrow(run, DIGEST)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repaired(in_order(damaged(table(spark, sf_dir, "conversations")))))


_BITS = ", -1" * 8
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: crc32 bit by bit: a code is added, a -1 is one shift.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda ch: [unicode(ch)::BIGINT{_BITS}]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20"
_I = "CASE {s} WHEN 0 THEN c{2} WHEN 1 THEN c{2} WHEN 2 THEN c{3} ELSE c{2} END"


def _sql() -> str:
    """The same by recursion over the rows of all conversations at once: least costs from the last row to
    the first, then the walk, which takes the first letter in D, I, K, R whose cost is the least."""
    own = {s: " ".join(f"WHEN rf = '{r}' THEN b.c{t}" for r, t in NEXT[s].items()) for s in range(4)}
    target = [NEXT[s][TURN[s]] for s in range(4)]
    more = f"CASE WHEN fault = {CUT} THEN {TRUNCATED} ELSE 0 END"
    fixed = f"fault IN ({BLANK}, {DUPLICATE})"
    plain = {s: f"least(b.c{s} + 2, CASE WHEN {fixed} THEN {FAR} ELSE least(CASE {own[s]} ELSE {FAR} END, b.c{target[s]} + 1) + {more} END)" for s in range(4)}
    close = f"least(p0, 5 + least(p2, 5 + p3)) AS c0, least(p1, 5 + least(p2, 5 + p3)) AS c1, least(p2, 5 + p3) AS c2, least(p3, 5 + p2) AS c3"
    at = lambda a, s: f"[{', '.join(f'{a}.c{k}' for k in range(4))}][{s} + 1]"
    to = f"[{', '.join(map(str, target))}][w.s + 1]"
    kept = "CASE WHEN rf = 's' AND w.s = 0 THEN 1 WHEN rf = 'u' AND w.s <> 2 THEN 2 WHEN rf = 'a' AND w.s = 2 THEN 3 ELSE -1 END"
    turn = "[" + ", ".join(f"'{ROLE[t]}'" for t in TURN) + "][w.s + 1]"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
z AS (SELECT *, {_CRC} AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE kind <> 0),
o AS (SELECT coalesce(conv_id, -1) AS conv, *, trim(text, {_SPACE}) AS inner_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS rf FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
r AS (SELECT *, CASE WHEN inner_text = '' THEN {BLANK} WHEN nth > 1 THEN {DUPLICATE} WHEN right(inner_text, 1) NOT IN ('.', '!', '?') THEN {CUT} ELSE 0 END AS fault, lag(rf) OVER (PARTITION BY conv_id ORDER BY i) || rf AS pair FROM m),
n AS (SELECT conv, max(i) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
  count(*) FILTER (fault = {CUT}) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
c AS (SELECT conv, n + 1 AS i, 0::BIGINT AS c0, 10::BIGINT AS c1, 5::BIGINT AS c2, 0::BIGINT AS c3 FROM n
  UNION ALL SELECT conv, i, {close} FROM (SELECT r.conv, r.i, {", ".join(f"{plain[s]} AS p{s}" for s in range(4))} FROM c b JOIN r ON r.conv = b.conv AND r.i = b.i - 1)),
w AS (SELECT conv, 1::BIGINT AS i, 0 AS s, '' AS audit, NULL::VARCHAR AS lines FROM n
  UNION ALL SELECT conv, i + (x <> 'I')::INT, CASE x WHEN 'D' THEN s WHEN 'K' THEN keeps ELSE goes END, audit || x, CASE WHEN x = 'D' THEN lines ELSE coalesce(lines || chr(10), '') || CASE x WHEN 'K' THEN role ELSE turns END || ':' || CASE x WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT w.*, r.role, r.text, {kept} AS keeps, {to} AS goes, {turn} AS turns,
    CASE WHEN r.i IS NULL THEN 'I' WHEN {at("b", "w.s")} + 2 = {at("a", "w.s")} THEN 'D' WHEN {at("a", to)} + 5 = {at("a", "w.s")} THEN 'I'
      WHEN NOT {fixed} AND {kept} >= 0 AND {at("b", f"({kept})")} + {more} = {at("a", "w.s")} THEN 'K' ELSE 'R' END AS x
    FROM w JOIN c a ON a.conv = w.conv AND a.i = w.i LEFT JOIN c b ON b.conv = w.conv AND b.i = w.i + 1 LEFT JOIN r ON r.conv = w.conv AND r.i = w.i WHERE r.i IS NOT NULL OR w.s IN (1, 2)) q),
e AS (SELECT w.*, n.* EXCLUDE (conv, n), c.c0 AS cost FROM w JOIN n USING (conv) JOIN c ON c.conv = w.conv AND c.i = 1 WHERE w.i = n.n + 1 AND w.s IN (0, 3))
SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(lines, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN e ON e.conv = coalesce(t.conv_id, -1)
"""


SQL = _sql()
