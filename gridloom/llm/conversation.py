"""Conversation structure repair: the cheapest edits after which roles read (s?(ua)+)?, system first if at all, then user
and assistant in turn, ending with an assistant.

A node is (rows seen, state of that pattern); Keep, Rerole and Delete arcs go to the next row, Insert arcs to the next
state. Two passes over the rows of each conversation find the arcs that lie on some cheapest path: the first, from the
last row to the first, gives each row the least costs from there to the end; the second, from the first row on, adds the
least costs from the start, and an arc is tight if both and its own cost make the cheapest total. A set of nodes walks
along tight arcs and takes the least letter that one of them has at each step.

Both passes stream over sorted rows and hold four numbers a conversation, so a conversation of any length passes through
a task without being held there. It does pass through one: the digest of its repaired text is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, columns_of, shuffle_partitions, slices, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after one more user or assistant.
AFTER = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


def kept_state(state: int, initial: str) -> int:
    """The state after a row that keeps its role, or -1. A role without letters adds nothing to the pattern."""
    if not initial:
        return state
    if initial == "s":
        return SYSTEM if state == START else -1
    after = AFTER[state]
    return after if initial == ROLES[after][0] else -1


#: What is neither s, u nor a stands under a question mark.
KEPT = {initial: [kept_state(s, initial) for s in range(4)] for initial in ("s", "u", "a", "", "?")}


def _row_arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, state after) of a row's arcs from each state, in the order of the letters."""
    out, extra = [], CUT_OFF if fault == 3 else 0
    for s in range(4):
        arcs = [("D", DELETE, s)]
        if fault not in (1, 2):
            if (kept := KEPT[initial][s]) >= 0:
                arcs.append(("K", extra, kept))
            arcs.append(("R", REROLE + extra, AFTER[s]))
        out.append(arcs)
    return out


ARCS = {(i, f): _row_arcs(i, f) for i in KEPT for f in range(4)}


def arcs_of(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    return ARCS[initial if initial in KEPT else "?", fault]


def with_inserts_before(costs: list[int]) -> list[int]:
    """Least costs to the end from each state, if turns may be put in first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


#: To the end after the last row: nothing at all is fine, and so is an assistant's turn.
END = with_inserts_before([0, FAR, FAR, 0])


def before_row(initial: str, fault: int, after: list[int]) -> list[int]:
    """Least costs to the end before a row, from those after it."""
    return with_inserts_before([min(c + after[t] for _, c, t in arcs) for arcs in arcs_of(initial, fault)])


def with_inserts_after(costs: list[int]) -> list[int]:
    """Least costs from the start to each state, if turns may be put in last."""
    user = min(costs[USER], INSERT + min(costs[START], costs[SYSTEM], costs[ASSISTANT]))
    return [costs[START], costs[SYSTEM], user, min(costs[ASSISTANT], INSERT + user)]


class Walk:
    """The frontier of one conversation."""

    def __init__(self, total: int) -> None:
        self.total, self.frontier = total, [START]
        self.costs = with_inserts_after([0, FAR, FAR, FAR])

    def _tight(self, cost: int, s: int, t: int, to_go: list[int]) -> bool:
        return self.costs[s] + cost + to_go[t] == self.total

    def _put_in(self, here: list[int]) -> list[int]:
        return list(dict.fromkeys(AFTER[s] for s in self.frontier if self._tight(INSERT, s, AFTER[s], here)))

    def row(self, initial: str, fault: int, here: list[int], after: list[int]) -> Iterator[tuple[str, int]]:
        """(letter, state after) of the edits up to and with a row; here and after: costs to the end before and after it."""
        arcs = arcs_of(initial, fault)
        while True:
            tight = sorted({(a, t) for s in self.frontier for a, c, t in arcs[s] if self._tight(c, s, t, after)})
            letter = tight[0][0] if tight else "Z"
            if letter > "I" and (put_in := self._put_in(here)):
                self.frontier = put_in
                yield "I", put_in[0]
                continue
            self.frontier = [t for a, t in tight if a == letter]
            break
        nxt = [FAR] * 4
        for s in range(4):
            for _, c, t in arcs[s]:
                nxt[t] = min(nxt[t], self.costs[s] + c)
        self.costs = with_inserts_after(nxt)
        yield letter, self.frontier[0]

    def end(self) -> Iterator[tuple[str, int]]:
        """Turns put in after the last row; a shorter sequence of letters comes before its continuations."""
        while not any(END[s] == 0 and self._tight(0, s, s, END) for s in self.frontier):
            self.frontier = self._put_in(END)
            yield "I", self.frontier[0]


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, times: rows with a fault put in by crc32(conv_id:turn) mod 20: 0 drops it (times 0), 1
    empties the text, 2 removes its sentence ends, 3 repeats it (times 2), 4 sets the role user. Null roles and texts are
    one space, and so are null ids and turns in the checksum."""
    own, at, who, said = columns_of([conv_id, turn, role, text])
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(own.cast("string"), space), F.lit(":"), F.coalesce(at.cast("string"), space)).cast("binary")) % 20
    rows = conversations.select(own.alias("conv_id"), at.cast("long").alias("turn"), F.coalesce(who, space).alias("role"), F.coalesce(said, space).alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), times.cast("long").alias("times"))


def faulty(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, fault (a number of FAULTS) for each turn that is there, in no order.

    Equal rows are one row with a number until their copies are written out, and what was said before is known from the
    least turn of each (conversation, role, text), joined on: a line that a conversation repeats very often is summed in
    each task first. A conversation without turns has one row without a role.
    """
    there = F.col("times") > 0
    rows = turns.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "times")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    at = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    keys = F.struct("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("digest"))
    rows = rows.withColumns({"key": F.to_json(keys), "at": at})
    first = rows.where("role is not null").groupBy(F.col("key").alias("said")).agg(F.min("at").alias("first"))
    blank = F.btrim("text", F.lit(SPACES)) == ""
    cut_off = ~F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1)).isin(".", "!", "?")
    seen = (F.col("at") > F.col("first")) | (F.col("copy") > 1)
    out = rows.join(first, F.col("key") == F.col("said"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("times", F.lit(1).cast("long")))))
    fault = F.when(F.col("role").isNull(), 0).when(blank, 1).when(seen, 2).when(cut_off, 3).otherwise(0)
    return out.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the least costs to the end before and after it; rows come last turn first."""
    known, costs = (), END
    for batch in slices(batches):
        both = []
        for own, role, fault in zip(*[batch.column(k).to_pylist() for k in (0, 2, 5)], strict=True):
            if known != (own,):
                known, costs = (own,), END
            after = costs
            if role is not None:
                costs = before_row(role[:1], fault, after)
            both.append(costs + after)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both, pa.list_(pa.int64()))], names=[*batch.schema.names, "to_go"])


Edit = tuple[int | None, int | None, str | None, str | None, int, str, int]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Edit]]]:
    """(conversation, its edits in order): turn, role and text as found, fault, letter, state after."""

    def rows() -> Iterator[tuple]:
        for batch in slices(batches):
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def edits(own: Iterator[tuple]) -> Iterator[Edit]:
        walk = None
        for _, turn, role, text, _, fault, to_go in own:
            if role is None:
                continue
            here, after = to_go[:4], to_go[4:]
            walk = walk or Walk(here[START])
            for letter, state in walk.row(role[:1], fault, here, after):
                yield (None, None, "", 0, letter, state) if letter == "I" else (turn, role, text, fault, letter, state)
        for letter, state in walk.end() if walk else ():
            yield None, None, "", 0, letter, state

    for conversation, own in groupby(rows(), key=lambda r: r[0]):
        yield conversation, edits(own)


def repaired_role(role: str | None, letter: str, state: int) -> str | None:
    return role if letter == "K" else None if letter == "D" else ROLES[state]


def _walked(turns: DataFrame) -> DataFrame:
    """Rows of faulty() in order, with their costs to the end."""
    small_batches(turns.sparkSession)
    parts = shuffle_partitions(turns.sparkSession)
    rows = faulty(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ascending = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "copy"]
    descending = ["conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("copy")]
    back = rows.repartition(parts, "conv_id").sortWithinPartitions(*descending).mapInArrow(_backward, f"conv_id {kind}, turn long, role string, text string, copy long, fault int, to_go array<long>")
    return back.repartition(parts, "conv_id").sortWithinPartitions(*ascending)


def as_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as they are, for repair() and audit(): null roles and texts are one space."""
    own, at, who, said = columns_of([conv_id, turn, role, text])
    return conversations.select(own.alias("conv_id"), at.cast("long").alias("turn"), F.coalesce(who, F.lit(" ")).alias("role"), F.coalesce(said, F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("times"))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I), turn (null if put in).

    turns: conv_id, turn, role, text, times, as as_turns() and damage() give them. Rows are taken by turn (nulls first),
    those of one turn by role and text; null ids are a conversation of their own; an empty table gives an empty one, and a
    conversation of which all is deleted gives no row.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def leave() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
            out.clear()
            return batch

        schema = None
        names = ("conv_id", "place", "role", "text", "edit", "turn")

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("turn", pa.int64())])
                yield batch

        for conversation, edits in _forward(watched()):
            place = 0
            for turn, role, text, _, letter, state in edits:
                if letter != "D":
                    out.append((conversation, place, repaired_role(role, letter, state), text, letter, turn))
                    place += 1
                if len(out) >= 2000:
                    yield leave()
        if out:
            yield leave()

    return _walked(turns).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string, turn long")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of turns,
    those of which no turn is left included. Order, ties, nulls and empty tables as in repair()."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types: list[pa.DataType] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.schema.field("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
                yield batch

        def leave() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])
            out.clear()
            return batch

        for conversation, edits in _forward(watched()):
            letters, digest, faults, illegal, cost = [], hashlib.sha256(), [0] * 4, 0, 0
            least = last = before = None
            turns, first = 0, True
            for turn, role, text, fault, letter, state in edits:
                letters.append(letter)
                faults[fault] += 1
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (CUT_OFF if fault == 3 and letter != "D" else 0)
                if letter != "I":
                    if turn is not None and turn != last:
                        least, last, turns = turn if least is None else least, turn, turns + 1
                    illegal += before is not None and before + role[:1] not in LEGAL
                    before = role[:1]
                if letter != "D":
                    digest.update(f"{'' if first else chr(10)}{repaired_role(role, letter, state)}:{text}".encode())
                    first = False
            gaps = 0 if least is None else last - least + 1 - turns
            out.append((conversation, gaps, *faults[1:], illegal, cost, "".join(letters), digest.hexdigest()))
            if len(out) >= 2000:
                yield leave()
        if out:
            yield leave()

    return _walked(turns).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT),
  lambda c, b: xor(crc[(xor(c, b) % 256) + 1], c // 256), 4294967295::BIGINT)) % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
e AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, max(i) AS n FROM e GROUP BY conv_id),
l AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM e) WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:'])) t(a, b, c, l, r)),
act AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)) t(a, ini, b)),
rer AS (SELECT * FROM (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)) t(a, role, b)),
s AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM g
 UNION ALL
 SELECT conv_id, i, s, cost, audit, said FROM (
  SELECT s.conv_id, e.i, m.s, s.cost + ins.c + m.cost AS cost, s.audit || ins.l || m.l AS audit, s.said || ins.r || m.r AS said
  FROM s JOIN ins ON ins.a = s.s JOIN e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1,
  LATERAL (SELECT ins.b AS s, 4 AS cost, 'D' AS l, []::VARCHAR[] AS r
   UNION ALL SELECT act.b, CASE fault WHEN 3 THEN 3 ELSE 0 END, 'K', [e.role || ':' || e.text] FROM act WHERE act.a = ins.b AND act.ini = e.ini AND fault NOT IN (1, 2)
   UNION ALL SELECT rer.b, CASE fault WHEN 3 THEN 6 ELSE 3 END, 'R', [rer.role || ':' || e.text] FROM rer WHERE rer.a = ins.b AND fault NOT IN (1, 2)) m)
 QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
z AS (SELECT s.conv_id, s.cost + ins.c AS cost, s.audit || ins.l AS audit, s.said || ins.r AS said FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.n = s.i JOIN ins ON ins.a = s.s AND ins.b IN (0, 3)
 QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + ins.c, s.audit || ins.l) = 1),
q AS (SELECT DISTINCT conv_id FROM conversations)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id
"""
