"""Operator 10, chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn is followed by user and assistant turns in
turn, ending with an assistant turn.  Dynamic programming over that automaton (nothing yet,
system, user, assistant) picks for each turn the cheapest of: keep it, merge it into
the turn before (``MERGE``), give it another role (``RELABEL``), each after inserting
empty turns where needed (``INSERT`` each).  Of equally cheap repairs the one listed first wins, so the
result is fixed.

Turns are dealt out by range of (conversation, turn), so a conversation that holds
a third of all rows lies in many tasks.  Each task reduces its stretch of a conversation to a
table of 4 x 4 costs (from each state to each state); the tables of one conversation,
at most one per task, are chained in order, which gives every stretch its state at
either end, and each stretch is then repaired by itself.  The text is rendered per turn: joined in
order, the ``rendered`` strings of a conversation are its text, so no task holds a long one whole.

Turns with equal numbers keep the order in which they are read; null numbers come first; a null
conversation id is a conversation.  Roles are trimmed and lower-cased; ``ALIASES`` count as their
role, other and null roles must be relabelled.  Null texts are empty.  Repeated rows are turns of their own
(and are merged like any two turns of one role).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import HandOver, known_to_workers

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: States: 0 nothing yet, else 1 + the role of the turn that stands last.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 60


@lru_cache(maxsize=1)
def inserts() -> list[list[tuple[int, ...] | None]]:
    """The fewest empty turns (user or assistant) that lead from one state to another."""
    table: list[list[tuple[int, ...] | None]] = [[() if a == b else None for b in range(4)] for a in range(4)]
    for a in range(4):
        edge = [a]
        while edge:
            s = edge.pop(0)
            for b in NEXT[s]:
                if b != 1 and table[a][b] is None:
                    table[a][b] = (*table[a][s], b)
                    edge.append(b)
    return table


@lru_cache(maxsize=1)
def steps() -> list[list[list[tuple]]]:
    """For an observed role (0 unknown, else as in states), from and to state: cost, inserted turns, merged, relabelled."""
    out = []
    for seen in range(4):
        table = [[(FAR, (), False, False)] * 4 for _ in range(4)]
        for a in range(4):
            for b in range(1, 4):
                options = []
                for middle in range(4):
                    before = inserts()[a][middle]
                    if before is None:
                        continue
                    base = INSERT * len(before) + RELABEL * (seen != b)
                    if b in NEXT[middle]:
                        options.append((base, before, False, seen != b))
                    if middle == b:
                        options.append((base + MERGE, before, True, seen != b))
                if options:
                    table[a][b] = min(options, key=lambda o: (o[0], len(o[1]), o[2]))
        out.append(table)
    return out


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return 1 + ROLES.index(name) if name in ROLES else 0


def reduced(seen: list[int]) -> list[int]:
    """Costs of a stretch from each state to each state, row by row."""
    cost = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for r in seen:
        step = steps()[r]
        cost = [[min(row[m] + step[m][b][0] for m in range(4)) for b in range(4)] for row in cost]
    return [min(FAR, c) for row in cost for c in row]


def chained(tables: list[list[int]], last: bool = True) -> list[tuple[int, int]]:
    """State before and after each stretch of a conversation, cheapest in all."""
    best, back = [0, FAR, FAR, FAR], []
    for t in tables:
        came = [min(range(4), key=lambda a: best[a] + t[4 * a + b]) for b in range(4)]
        best = [best[came[b]] + t[4 * came[b] + b] for b in range(4)]
        back.append(came)
    end = min(range(4), key=lambda s: best[s] + (INSERT * len(inserts()[s][LAST]) if inserts()[s][LAST] is not None else FAR))
    out = []
    for came in reversed(back):
        out.append((came[end], end))
        end = came[end]
    return out[::-1]


def repaired(seen: list[int], start: int, end: int) -> list[tuple[int, int, tuple]]:
    """From state, to state and what is done, for each turn of a stretch between two states."""
    best, back = [0 if s == start else FAR for s in range(4)], []
    for r in seen:
        step = steps()[r]
        came = [min(range(4), key=lambda a: best[a] + step[a][b][0]) for b in range(4)]
        best = [best[came[b]] + step[came[b]][b][0] for b in range(4)]
        back.append(came)
    out = []
    for r, came in zip(reversed(seen), reversed(back)):
        out.append((came[end], end, steps()[r][came[end]][end]))
        end = came[end]
    return out[::-1]


def head(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSE, JOIN = "<|end|>\n", "\n\n"


def _stretches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Runs of rows of one stretch: (part, conversation number) and its rows."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    return groupby(rows, key=lambda r: r[:2])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, place, action, role, inserted_before, inserted_after, cost, rendered.

    ``place`` orders the turns of a conversation.
    """
    spark, over = turns.sparkSession, HandOver(turns.sparkSession)
    known_to_workers(spark)
    given = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("read"),
    )
    given = over.settle(given, "given")
    dealt = given.repartitionByRange("conv_id", "turn", "read").sortWithinPartitions("conv_id", "turn", "read")
    rows = over.settle(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "rows")
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, _), own in _stretches(batches, ["part", "conv_id", "place", "role"]):
            own = list(own)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "conv_id": pa.array([own[0][1]], conv_type), "first": pa.array([own[0][2]], pa.int64()),
                 "costs": pa.array([reduced([role_number(r[3]) for r in own])], pa.list_(pa.int64()))},
            )

    conv_type = _arrow(rows, "conv_id")
    # whole stretches: rows of one (part, conversation) in one task, in order
    by_stretch = rows.select("part", "conv_id", "place", "role").repartition("part", "conv_id").sortWithinPartitions("part", "conv_id", "place")
    tables = over.settle(by_stretch.mapInArrow(reduce, f"part int, conv_id {conv}, first bigint, costs array<bigint>"), "tables")

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        states = chained(table.column("costs").to_pylist())
        return pa.table({
            "part": table.column("part"), "conv_id": table.column("conv_id"), "start": pa.array([a for a, _ in states], pa.int32()),
            "end": pa.array([b for _, b in states], pa.int32()), "closes": pa.array([i == len(states) - 1 for i in range(len(states))], pa.bool_()),
        })

    ends = over.settle(tables.groupBy("conv_id").applyInArrow(chain, f"part int, conv_id {conv}, start int, end int, closes boolean"), "ends")
    ends = ends.select(F.col("part").alias("of_part"), F.col("conv_id").alias("of_conv"), "start", "end", "closes")
    told = rows.join(ends, (rows["part"] == ends["of_part"]) & rows["conv_id"].eqNullSafe(ends["of_conv"]))
    told = told.select("part", "conv_id", "turn", "place", "role", "text", "start", "end", "closes")

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _stretches(batches, ["part", "conv_id", "turn", "place", "role", "text", "start", "end", "closes"]):
            own = list(own)
            done = repaired([role_number(r[4]) for r in own], own[0][6], own[0][7])
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn", "place", "action", "role", "inserted_before", "inserted_after", "cost", "rendered")}
            for i, (row, (a, b, (cost, before, merged, other))) in enumerate(zip(own, done)):
                closing = row[8] and i == len(own) - 1
                after = inserts()[b][LAST] if closing else ()
                text = "".join((CLOSE if k or a else "") + head(s) for k, s in enumerate(before))
                open_now = bool(a) or bool(before)
                text += JOIN + row[5] if merged else (CLOSE if open_now else "") + head(b) + row[5]
                text += "".join(CLOSE + head(s) for s in after) + (CLOSE if closing else "")
                action = "+".join(n for n, on in (("relabel", other), ("merge", merged)) if on) or "keep"
                for k, v in zip(out, (row[1], row[2], row[3], action, ROLES[b - 1], [ROLES[s - 1] for s in before], [ROLES[s - 1] for s in after], cost + INSERT * len(after), text)):
                    out[k].append(v)
            kinds = [conv_type, turn_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    turn_type = _arrow(rows, "turn")
    return told.repartition("part", "conv_id").sortWithinPartitions("part", "conv_id", "place").mapInArrow(
        act, f"conv_id {conv}, turn {turn}, place bigint, action string, role string, inserted_before array<string>, inserted_after array<string>, cost bigint, rendered string"
    )


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
