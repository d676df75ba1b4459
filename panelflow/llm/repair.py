"""Cheapest repair of damaged conversations, and what was wrong with them.

A repaired conversation is nothing, or an optional system turn followed by pairs of user and assistant turns.  The
edits are found by a dynamic program over the turns with four states (what the last turn was).
Backward costs are kept at every square root of the number of turns only; the walk forward
computes those between two checkpoints again and takes the ASCII-least edit that is tight.

One shuffle by conversation; within it turns come sorted, first without their texts, from which the costs follow,
then with them.  So a task holds a byte per turn of one conversation, the checkpoints and
one batch of texts, whatever the length of the conversation; sorts and windows spill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1  # more, for a turn left truncated
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last turn was
OTHER, MUST_GO, CUT_OFF = 3, 4, 8  # code of a turn: initial (u, a, s, other), then two bits
INITIALS = {"u": 0, "a": 1, "s": 2}
AFTER = {(START, 0): USER, (START, 2): SYSTEM, (SYSTEM, 0): USER, (USER, 1): ASSISTANT, (ASSISTANT, 0): USER}
#: The one role that can follow each state by insertion or a new role, and the state then.
FORCED = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
NEVER = 1 << 60
FLUSH_ROWS, FLUSH_BYTES = 10_000, 8 << 20

Costs = tuple[int, int, int, int]


def _with_insertions(costs: list[int]) -> Costs:
    after_user, after_assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + after_user), min(costs[SYSTEM], INSERT + after_user), after_user, after_assistant


END = _with_insertions([0, NEVER, NEVER, 0])


def before(code: int, after: Costs) -> Costs:
    """Cheapest cost from each state before a turn, from those after it."""
    costs = [DELETE + c for c in after]
    if not code & MUST_GO:
        more = TRUNCATED if code & CUT_OFF else 0
        for state in range(4):
            costs[state] = min(costs[state], REROLE + more + after[FORCED[state][0]])
            if (kept := AFTER.get((state, code & 3))) is not None:
                costs[state] = min(costs[state], KEEP + more + after[kept])
    return _with_insertions(costs)


class Plan:
    """Edits of one conversation, in order, from the codes of its turns."""

    def __init__(self, codes: bytes | bytearray):
        self.codes = codes
        self.block = max(1, isqrt(len(codes)))
        self.checkpoints = {len(codes): END}
        costs = END
        for k in range(len(codes) - 1, -1, -1):
            costs = before(codes[k], costs)
            if k % self.block == 0:
                self.checkpoints[k] = costs
        self.cost = costs[START]
        self.at, self.state = 0, START
        self.costs: list[Costs] = []
        self.base = 0
        self._enter()

    def _enter(self) -> None:
        """Costs within the block that begins at the turn reached."""
        self.base = self.at
        end = min(len(self.codes), self.at + self.block)
        back = [self.checkpoints[end]]
        for k in range(end - 1, self.at - 1, -1):
            back.append(before(self.codes[k], back[-1]))
        self.costs = back[::-1]

    def _inserted(self) -> Iterator[tuple[str, str, int]]:
        state, role = FORCED[self.state]
        self.state = state
        yield "I", role, INSERT

    def turn(self) -> Iterator[tuple[str, str | None, int]]:
        """(edit, new role or None, cost) of insertions before the next turn, then of the turn itself."""
        code, here, after = self.codes[self.at], self.costs[self.at - self.base], self.costs[self.at - self.base + 1]
        more = TRUNCATED if code & CUT_OFF else 0
        while True:
            best, forced = here[self.state], FORCED[self.state]
            if best == DELETE + after[self.state]:
                edit = "D", None, DELETE
                break
            if best == INSERT + here[forced[0]]:
                yield from self._inserted()
                continue
            kept = AFTER.get((self.state, code & 3))
            if kept is not None and not code & MUST_GO and best == KEEP + more + after[kept]:
                edit, self.state = ("K", None, KEEP + more), kept
            else:
                edit, self.state = ("R", forced[1], REROLE + more), forced[0]
            break
        self.at += 1
        if self.at - self.base == self.block and self.at < len(self.codes):
            self._enter()
        yield edit

    def rest(self) -> Iterator[tuple[str, str | None, int]]:
        """Insertions after the last turn."""
        while END[self.state]:
            yield from self._inserted()


FAULTS = (None, "blank", "duplicate", "truncated")


class _Conversation:
    def __init__(self, name: Any):
        self.name = name
        self.codes = bytearray()
        self.turns: list[int | None] = [None, None, 0]  # smallest, last and number of different ones
        self.last = ""
        self.illegal = 0
        self.step = 0
        self.plan: Plan | None = None

    def seen(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if self.codes and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.codes.append(INITIALS.get(initial, OTHER) | (MUST_GO if fault in (1, 2) else 0) | (CUT_OFF if fault == 3 else 0))

    def head(self) -> tuple:
        low, high, different = self.turns
        gaps = 0 if low is None else high - low + 1 - different
        return self.name, -1, None, None, None, None, None, self.plan.cost, gaps, self.illegal


def _walk(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size, now = 0, None

    def planned() -> None:
        if now.plan is None:
            now.plan = Plan(now.codes)
            rows.append(now.head())

    def edits(found, turn=None, role=None, text=None, fault=0) -> None:
        for edit, new, cost in found:
            own = edit != "I"
            rows.append((now.name, now.step, edit, FAULTS[fault] if own else None, turn if own else None, new or role, text if own else "", cost, None, None))
            now.step += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        rows.clear()
        return done

    for batch in batches:
        for name, again, gone, turn, initial, fault, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or name != now.name:
                if now is not None:
                    planned()
                    edits(now.plan.rest())
                now = _Conversation(name)
            if not again:
                if not gone:
                    now.seen(turn, initial, fault)
            elif not gone:
                planned()
                edits(now.plan.turn(), turn, role, text, fault)
                size += len(text)
            if len(rows) >= FLUSH_ROWS or size >= FLUSH_BYTES:
                yield flush()
                size = 0
    if now is not None:
        planned()
        edits(now.plan.rest())
    yield flush()


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """One row per edit, and one that leads each conversation.

    Columns: conv_id, step, edit (K keep, R new role, D delete, I insert), fault (blank, duplicate,
    truncated or null), turn, role and text (after the edit; for a deletion those of the deleted turn), cost, gaps, illegal.  The
    leading row has step -1 and the conversation's cost, gaps and illegal pairs.  A conversation's rows are
    contiguous and ordered by step within a partition.

    Turns are ordered by turn (nulls first), role, text; null roles and texts count as one space; rows that
    are the same are duplicates but for the first.  A role whose first letter is not s, u or a (the empty role
    too) cannot be kept.  A null conv_id is one conversation.  Rows with a true ``gone_col`` are no turns; they
    name a conversation of which nothing may be left.  Other columns play no part; texts of any
    length pass through; without rows there is no result.  Turn numbers are whole numbers.
    """
    turn = F.col(turn_col).cast("long")
    gone = F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    plain = turns.select(
        F.col(conv_col).alias("conv_id"), turn.alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), gone.alias("gone")
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    marked = plain.withColumn("repeat", F.row_number().over(same)).withColumn(
        "place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "repeat", "gone"))
    )
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("repeat") > 1, 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    )
    twice = marked.withColumn("fault", fault).withColumn("again", F.explode(F.array(F.lit(False), F.lit(True))))
    late = lambda c: F.when(F.col("again"), F.col(c))
    ready = twice.select(
        "conv_id", "again", "gone", "turn", F.substring("role", 1, 1).alias("initial"), "fault", late("role").alias("role"), late("text").alias("text"), "place"
    ).sortWithinPartitions("conv_id", "again", "place").drop("place")
    kind = ready.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([
        ("conv_id", to_arrow_type(kind)), ("step", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()),
        ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64()), ("gaps", pa.int64()), ("illegal", pa.int64()),
    ])
    return ready.mapInArrow(
        lambda batches: _walk(batches, schema),
        f"conv_id {kind.simpleString()}, step long, edit string, fault string, turn long, role string, text string, cost long, gaps long, illegal long",
    )


def _sum_up(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done: list[dict] = []
    now: dict | None = None

    def close() -> None:
        now["audit"] = "".join(now["audit"])
        now["repaired_sha256"] = now["repaired_sha256"].hexdigest()
        done.append(now)

    def flush() -> pa.RecordBatch:
        ready = pa.RecordBatch.from_pylist(done, schema=schema)
        done.clear()
        return ready

    for batch in batches:
        for row in batch.to_pylist():
            if row["step"] < 0:
                if now is not None:
                    close()
                now = {"conv_id": row["conv_id"], "gaps": row["gaps"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": row["illegal"], "cost": row["cost"], "audit": [], "repaired_sha256": hashlib.sha256()}
                joint = b""
                continue
            now["audit"].append(row["edit"])
            if row["fault"]:
                now[row["fault"]] += 1
            if row["edit"] != "D":
                now["repaired_sha256"].update(joint + f"{row['role']}:{row['text']}".encode())
                joint = b"\n"
        if len(done) >= FLUSH_ROWS:
            yield flush()
    if now is not None:
        close()
    yield flush()


def conversation_audit(repaired: DataFrame) -> DataFrame:
    """One row per conversation from what ``repair_turns`` returns, which must come directly, in its order.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' letters in order), and
    the SHA-256 of the repaired ``role:text`` lines.  No shuffle; lines go into the digest one by one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = repaired.schema["conv_id"].dataType
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return repaired.mapInArrow(
        lambda batches: _sum_up(batches, schema),
        f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string",
    )


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with the faults that the CRC-32 of ``conv_id:turn``, modulo 20, asks for.

    0 drops the row (``gone`` is then true), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes
    it the user's.  Nulls count as one space, but for the conversation's and the turn's own columns.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
