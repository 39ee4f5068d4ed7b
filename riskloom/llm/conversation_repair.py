"""Least edits that give conversations a legal order of turns, by Knuth's lightest derivations.

The rows of a conversation, in order of turn, are kept, given another role, deleted, or preceded by inserted empty
turns, so that the initials of the roles become ``(s?(ua)+)?``. Items are (rows consumed, place in the order); an
edge derives an item from the one before it and the row that it consumes (insertions consume none). Items carry
(cost, audit), where the audit is the edits' initials so far; every edge adds to the cost and appends to the audit, so
the agenda pops items in their final order of (cost, audit) and ends when the goal is popped. Of equal costs the audit
that is least in ASCII wins.

Long conversations are read as a stream of blocks. At the end of a block each live place (four at most) keeps its cost,
the rank of its audit, its audit as a chain of the blocks' pieces and a running hash of the repaired text; the next
block's agenda begins with them. Memory is a block of rows and a few bytes for each row of one conversation. Rows are
dealt out by conversation once; repeated ones are found by a window within that, which like the sort can spill. A hash
of a conversation's whole text has to read it in order, so one conversation is one task's stream, however long.

Nulls: a null role or text counts as one space; rows without a turn come first; rows without a conversation form one
conversation. Ties of turn are ordered by role and text. Empty texts are blank. Texts of any length are hashed whole.
An empty table gives no rows. Other columns of the input are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from riskloom.session import materialise

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3  #: for a truncated row that is not deleted
#: A row that repeats another of the same turn comes after it.
FINE, CUT, BLANK, DUPLICATE = range(4)
#: Places in the order of turns: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
COMPLETE = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
BLOCK = 256
ORDER = ("turn", "role", "text", "fault")
SPACE, MARKS = r"[\x20\x09-\x0D]", r"[.!?]"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with faults put in by crc32 of ``conv_id:turn``, as long as 20
    allows: rows dropped (``gone``), emptied, stripped of sentence ends, repeated, or given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that the others here take."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", filled("role"), filled("text"), F.lit(False).alias("gone"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``damaged`` or ``whole`` rows, also of those whose rows are all gone."""
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    ordered = _judged(rows.repartition("conv_id")).sortWithinPartitions("conv_id", *ORDER)
    return ordered.mapInArrow(lambda batches: _walk(batches, kind), schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place, role, text, turn, edit); inserted ones have no turn.

    The audits are opened into one row for each letter and joined to the rows by their numbers.
    """
    order = Window.partitionBy("conv_id").orderBy(*ORDER)
    numbered = materialise(_judged(rows).where("NOT gone").withColumn("row", F.row_number().over(order).cast("long")), "turns")
    kind = rows.schema["conv_id"].dataType
    letters = audits(rows).select("conv_id", "audit").mapInArrow(lambda batches: _letters(batches, kind), f"conv_id {kind.simpleString()}, place long, edit string, row long, new_role string")
    left, right = letters.alias("l"), numbered.alias("r")
    both = left.join(right, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.row") == F.col("r.row")), "left")
    return both.select("l.conv_id", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn", "edit")


def _judged(rows: DataFrame) -> DataFrame:
    """Add each row's first fault. Rows that are gone stay, so that their conversation is not lost, without their text."""
    text = F.when(~F.col("gone"), F.col("text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")) > 1
    return rows.withColumn("text", text).withColumn("fault", _fault(F.col("text"), seen))


def _fault(text: Column, seen: Column) -> Column:
    blank, ended = ~text.rlike(r"[^\x20\x09-\x0D]"), text.rlike(rf"{MARKS}{SPACE}*\z")
    return F.when(blank, BLANK).when(seen, DUPLICATE).when(~ended, CUT).otherwise(FINE)


class Live(NamedTuple):
    """The best derivation of an item at the end of a block."""

    cost: int
    rank: int  #: of its audit up to the last row that was consumed, among the live ones
    inserted: int  #: insertions since then
    chain: tuple | None  #: (chain before, piece of the audit)
    sha: Any  #: of the repaired text
    empty: bool


class Conversation:
    """Counts and live derivations of a conversation whose rows come one after another."""

    def __init__(self, key: Any) -> None:
        self.key, self.block = key, []
        self.live = {START: Live(0, 0, 0, None, hashlib.sha256(), True)}
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turns, self.turn = turn if self.low is None else self.low, turn, self.turns + 1, turn
        self.initial = initial
        self.faults[fault] += 1
        self.block.append((role, text, fault))
        if len(self.block) >= BLOCK:
            self.live = derive(self.block, self.live, last=False)
            self.block = []

    def result(self) -> tuple:
        (best,) = derive(self.block, self.live, last=True).values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        pieces, chain = [], best.chain
        while chain:
            chain, piece = chain
            pieces.append(piece)
        faults = [self.faults[k] for k in (BLANK, DUPLICATE, CUT)]
        return (self.key, gaps, *faults, self.illegal, best.cost, "".join(reversed(pieces)), best.sha.hexdigest())


def derive(block: list[tuple[str, str, int]], live: dict[int, Live], last: bool) -> dict[int, Live]:
    """The lightest derivations of the items at the block's end; of the last block, that of the goal alone.

    Weights are (cost, rank, audit): audits of the block follow those of the live items before it, which rank orders.
    An edge's weight is never less than that of the item it starts from, and keeps the order of such items, as of two
    audits for one item neither begins the other.
    """
    n = len(block)
    goal = n + 1
    agenda = [(x.cost, x.rank, "I" * x.inserted, 0, place, place) for place, x in live.items()]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], tuple] = {}
    best: dict[tuple[int, int], tuple] = {}
    open_ends = 1 if last else len(FOLLOWS)
    while agenda and open_ends:
        cost, rank, audit, i, place, origin = heapq.heappop(agenda)
        if (i, place) in final:
            continue
        final[i, place] = (cost, rank, audit, origin)
        if i == goal or (i == n and not last):
            open_ends -= 1
        if i == goal:
            break
        steps = [(i, NEXT[place][0], INSERT, "I")]
        if i < n:
            role, _, fault = block[i]
            steps.append((i + 1, place, DELETE, "D"))
            if fault in (FINE, CUT):
                more = TRUNCATED if fault == CUT else 0
                if (kept := FOLLOWS[place].get(role[:1])) is not None:
                    steps.append((i + 1, kept, KEEP + more, "K"))
                steps.append((i + 1, NEXT[place][0], REROLE + more, "R"))
        elif last and place in COMPLETE:
            steps.append((goal, START, 0, ""))
        for to, there, more, letter in steps:
            weight = (cost + more, rank, audit + letter)
            known = best.get((to, there))
            if known is None or weight < known:
                best[to, there] = weight
                heapq.heappush(agenda, (*weight, to, there, origin))
    ends = {place: x for (i, place), x in final.items() if i == (goal if last else n)}
    # Audits up to the last row consumed, in order; insertions after it are counted apart, as one may begin another.
    bodies = {place: (rank, audit.rstrip("I")) for place, (_, rank, audit, _) in ends.items()}
    ranks = {body: k for k, body in enumerate(sorted(set(bodies.values())))}
    out = {}
    for place, (cost, _, audit, origin) in ends.items():
        before = live[origin]
        new = audit[before.inserted :]
        sha, empty = _hashed(before, origin, new, block)
        out[place] = Live(cost, ranks[bodies[place]], len(audit) - len(bodies[place][1]), (before.chain, new), sha, empty)
    return out


def _hashed(before: Live, place: int, letters: str, block: list[tuple[str, str, int]]) -> tuple[Any, bool]:
    """The running hash after the turns that some edits leave, each on a line of its own."""
    sha, empty, i = before.sha.copy(), before.empty, 0
    for letter in letters:
        role, text = ("", "") if letter == "I" else block[i][:2]
        i += letter != "I"
        if letter == "D":
            continue
        place, role = (FOLLOWS[place][role[0]], role) if letter == "K" else NEXT[place]
        sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
        empty = False
    return sha, empty


def _walk(batches: Iterator[pa.RecordBatch], kind: DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    types = [to_arrow_type(kind), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    talk: Conversation | None = None
    done: list[tuple] = []
    held = 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")]
        for key, turn, role, text, gone, fault in zip(*columns, strict=True):
            if talk is None or key != talk.key:
                if talk is not None:
                    done.append(talk.result())
                    held += len(done[-1][-2])
                talk = Conversation(key)
            if not gone:
                talk.add(turn, role, text, fault)
            if len(done) >= 5000 or held > 1 << 22:
                yield made(done)
                done, held = [], 0
    if talk is not None:
        done.append(talk.result())
        yield made(done)


def _letters(batches: Iterator[pa.RecordBatch], kind: DataType, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """One row for each turn that an audit leaves: its place, edit, the row that it comes from and its new role."""
    types = {"conv_id": to_arrow_type(kind), "place": pa.int64(), "edit": pa.string(), "row": pa.int64(), "new_role": pa.string()}
    out: list[tuple] = []
    for batch in batches:
        for key, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Roles alternate from the end, which is the assistant's; a kept row keeps its own.
            places = len(audit) - audit.count("D")
            at = row = 0
            for letter in audit:
                row += letter != "I"
                if letter == "D":
                    continue
                at += 1
                role = None if letter == "K" else ("assistant", "user")[(places - at) % 2]
                out.append((key, at, letter, None if letter == "I" else row, role))
                if len(out) >= size:
                    yield _batch(out, types)
                    out = []
    if out:
        yield _batch(out, types)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))
