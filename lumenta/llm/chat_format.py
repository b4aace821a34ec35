"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn.  Dynamic
programming over this automaton finds the cheapest way to make the turns legal: keep a
turn, merge it into the one before, relabel it, or put an empty turn in front of it.  The
repaired turns are then rendered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

ROLES = ("system", "user", "assistant")
START = "start"
#: What may follow what; a conversation may end after any role but system.
NEXT = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MERGE, RELABEL, NAME, INSERT = 2, 3, 1, 4  # NAME: give an unknown role a known one
TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"
#: What opens a marker; in a text it gets one backslash more, so that no turn can forge another.
OPENING = re.compile(r"<(\\*)\|")


def escaped(text: str) -> str:
    return OPENING.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@dataclass(frozen=True)
class Move:
    cost: int
    state: str
    op: str
    roles: tuple[str, ...]  # turns it opens; none for a merge


def _moves(state: str, role: str | None) -> list[Move]:
    """What can be done with a turn of this role after state, cheapest kinds first."""
    known = role in ROLES
    out = []
    for as_role in ROLES:
        price, op = (0, "keep") if as_role == role else (RELABEL if known else NAME, "relabel")
        if as_role in NEXT[state]:
            out.append(Move(price, as_role, op, (as_role,)))
        if as_role == state:
            out.append(Move(price + MERGE, state, "merge", ()))
        for empty in NEXT[state]:
            if as_role in NEXT[empty]:
                out.append(Move(price + INSERT, as_role, "insert" if op == "keep" else "insert+relabel", (empty, as_role)))
    return out


MOVES = {(s, r): _moves(s, r) for s in (START, *ROLES) for r in (*ROLES, None)}


def repair(roles: list[str | None]) -> tuple[int, list[Move]]:
    """The cheapest moves, one per turn; of equal ones the first in the order of _moves."""
    best: dict[str, int] = {START: 0}
    trail: list[dict[str, tuple[str, Move]]] = []
    for role in roles:
        role = role if role in ROLES else None
        step: dict[str, tuple[int, str, Move]] = {}
        for state, cost in best.items():
            for move in MOVES[state, role]:
                if move.state not in step or cost + move.cost < step[move.state][0]:
                    step[move.state] = (cost + move.cost, state, move)
        best = {s: c for s, (c, _, _) in step.items()}
        trail.append({s: (before, move) for s, (_, before, move) in step.items()})
    closing = {s: c + (INSERT if s == "system" else 0) for s, c in best.items()}
    state = min(closing, key=lambda s: closing[s])
    cost, moves = closing[state], []
    for step in reversed(trail):
        state, move = step[state]
        moves.append(move)
    return cost, moves[::-1]


def render(turns: list[tuple[str | None, str | None]]) -> tuple[int, list[str], list[tuple[str, str]], str]:
    """(cost, operations, repaired turns, rendered text) of (role, text) turns in order."""
    cost, moves = repair([r for r, _ in turns])
    out: list[tuple[str, list[str]]] = []
    for (_, text), move in zip(turns, moves, strict=True):
        if move.roles:
            out.extend((r, []) for r in move.roles)
        out[-1][1].append(text or "")
    if out and out[-1][0] == "system":
        out.append(("user", []))
    repaired = [(r, "\n".join(t)) for r, t in out]
    return cost, [m.op for m in moves], repaired, "".join(TEMPLATE.format(role=r, text=escaped(t)) for r, t in repaired)


SCHEMA = "conv_id long, n_turns long, n_out long, cost long, n_merged long, n_relabelled long, n_inserted long, roles string, rendered string"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; one conversation is held at a time."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    done: list[tuple] = []

    def close(conv, turns):
        cost, ops, repaired, text = render(turns)
        inserted = len(repaired) - sum(o != "merge" for o in ops)
        done.append((conv, len(turns), len(repaired), cost, ops.count("merge"), sum("relabel" in o for o in ops), inserted, ",".join(r for r, _ in repaired), text))

    def batch():
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("roles", "rendered") else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    open_conv, turns = None, []
    for got in batches:
        for *conv, role, text in zip(*(got.column(c).to_pylist() for c in ("conv_id", "solo", "role", "text")), strict=True):
            if turns and conv != open_conv:
                close(open_conv[0], turns)
                turns = []
                if len(done) >= 512:
                    yield batch()
            open_conv = conv
            turns.append((role, text))
    if turns:
        close(open_conv[0], turns)
    if done:
        yield batch()


def chat_format(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, repaired roles and the rendered text.

    Turns are ordered by turn (null first), then role and text, so ties have one order.  A
    null or unknown role takes the cheapest known one; a null text counts as empty; a turn
    without a conv_id belongs with no other and is a conversation of its own, so such turns
    spread over all tasks.  Repeated rows are turns of their own.  No rows give no rows.  Texts
    of any length are rendered whole, with what would open a marker in them escaped.  A
    conversation is rendered in one task, since its text is one value, which must fit into
    2 GB.  Other columns of turns are not read, whatever their names.
    """
    small_batches(turns.sparkSession)
    solo = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), solo.alias("solo"), F.col("turn").cast("long").alias("turn"), F.trim(F.lower("role")).alias("role"), "text")
    sorted_rows = rows.repartition("conv_id", "solo").sortWithinPartitions("conv_id", "solo", "turn", "role", "text")
    return sorted_rows.select("conv_id", "solo", "role", "text").mapInArrow(_conversations, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))
