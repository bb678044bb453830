"""Chat formatting: minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Each
turn may keep its role or be relabelled, may be merged into the turn before it, and an empty turn may be inserted
before it; dynamic programming over the automaton's states (the role last written) finds the cheapest repair, of
equal ones the one with fewest turns. Conversations are cut in blocks of at most `block` turns by their rank: each is first
reduced to its cost from every state to every state, the blocks of a conversation then settle their end states,
and each block finds its own repair between them. No task has to hold a whole conversation.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.llm.common import ranked

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 5
    insert: int = 3


def role_of(text: str | None) -> int | None:
    return ALIASES.get((text or "").strip().lower())


@functools.cache
def moves(role: int | None, costs: Costs) -> list[tuple[int, int, int, int, str]]:
    """Ways to write a turn: (state before, state after, cost, turns written, action)."""
    out = []
    for before, after in itertools.product(range(4), (SYSTEM, USER, ASSISTANT)):
        base, name = (0, "keep") if after == role else (costs.relabel, "relabel")
        if after in NEXT[before]:
            out.append((before, after, base, 1, name))
        if after == before:
            out.append((before, after, base + costs.merge, 0, f"{name}+merge"))
        for middle in NEXT[before]:
            if after in NEXT[middle]:
                out.append((before, after, base + costs.insert, 2, f"{name}+insert {ROLES[middle - 1]}"))
    return out


def reach(roles: list[int | None], costs: Costs) -> dict[tuple[int, int], tuple[int, int]]:
    """(first state, last state) -> (cost, turns written) of the best repair of a run of turns."""
    best = {(s, s): (0, 0) for s in range(4)}
    for role in roles:
        following: dict[tuple[int, int], tuple[int, int]] = {}
        for before, after, cost, turns, _ in moves(role, costs):
            for s in range(4):
                if (s, before) in best:
                    c, t = best[s, before]
                    if (s, after) not in following or (c + cost, t + turns) < following[s, after]:
                        following[s, after] = (c + cost, t + turns)
        best = following
    return best


def endings(costs: Costs) -> dict[int, tuple[int, int]]:
    """Last state -> (cost, empty turns) to end there: after a user turn an empty assistant turn is inserted, after
    a system turn both."""
    return {START: (0, 0), ASSISTANT: (0, 0), USER: (costs.insert, 1), SYSTEM: (2 * costs.insert, 2)}


def settle(blocks: list[dict[tuple[int, int], tuple[int, int]]], costs: Costs) -> list[tuple[int, int, int]]:
    """For each block in order: its first and last state and the turns written before it."""
    best, steps = {START: (0, 0)}, []
    for block in blocks:
        following, back = {}, {}
        for (s, e), (c, t) in sorted(block.items()):
            if s in best:
                score = (best[s][0] + c, best[s][1] + t)
                if e not in following or score < following[e]:
                    following[e], back[e] = score, (s, best[s][1])
        best = following
        steps.append(back)
    end = endings(costs)
    state = min(best, key=lambda e: (best[e][0] + end[e][0], best[e][1] + end[e][1], e))
    out = []
    for back in reversed(steps):
        out.append((back[state][0], state, back[state][1]))
        state = back[state][0]
    return out[::-1]


def repair(roles: list[int | None], first: int, last: int, costs: Costs) -> list[tuple[int, int, str]]:
    """For each turn the state after it, the turns written by it, and the action, of the best repair from first to last."""
    best, steps = {first: (0, 0)}, []
    for role in roles:
        following, back = {}, {}
        for before, after, cost, turns, action in moves(role, costs):
            if before in best:
                score = (best[before][0] + cost, best[before][1] + turns)
                if after not in following or score < following[after]:
                    following[after], back[after] = score, (before, turns, action)
        best = following
        steps.append(back)
    out, state = [], last
    for back in reversed(steps):
        before, turns, action = back[state]
        out.append((state, turns, action))
        state = before
    return out[::-1]


OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def render(turn_role: int, action: str, text: str, begins: bool, ends: bool) -> str:
    """The turn's share of the rendered conversation; all shares in order are the whole.

    A "<|" in the text becomes "< |", so that no text can open or close a turn.
    """
    text = text.replace("<|", "< |")
    if "+merge" in action:
        out = "\n" + text
    else:
        out = "" if begins else "\n" + CLOSE
        if "+insert " in action:
            out += OPEN.format(action.rpartition(" ")[2]) + "\n" + CLOSE
        out += OPEN.format(ROLES[turn_role - 1]) + text
    if ends:
        out += "\n" + CLOSE + "".join(OPEN.format(r) + "\n" + CLOSE for r in {SYSTEM: ("user", "assistant"), USER: ("assistant",)}.get(turn_role, ()))
    return out


def chat_format(turns: DataFrame, costs: Costs = Costs(), block: int = 512) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, position and rendered.

    action: keep or relabel, with +merge (joined to the turn before) or +insert ROLE (an empty turn comes before).
    position: number of the written turn, from 0, empty ones included. rendered: the turn's share of the
    conversation's text; its shares in order of turn are the whole, which ends with the assistant.

    Unknown and null roles always count as relabelled; a null text is empty; "<|" in a text becomes "< |"; a null turn
    number comes first; turns with one number are in order of role and text. All turns with a null conv_id are one conversation. Rows that
    repeat stay, as turns of their own. Other columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # the last order key deals out turns that are equal in all columns
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    rows = ranked(rows.withColumn("_tie", F.monotonically_increasing_id()), [*order, F.col("_tie")]).drop("_tie")
    rows = rows.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    key, order = ["conv_id", "block"], ["conv_id", "block", "rank"]
    sent = rows.repartition(*key).sortWithinPartitions(*order)

    def groups(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple]:
        """Runs of rows with one key (at most a block)."""
        stream = (x for b in batches for x in zip(zip(*(b.column(c).to_pylist() for c in key), strict=True), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True))
        for k, g in itertools.groupby(stream, key=lambda x: x[0]):
            yield k, [x[1] for x in g]

    def batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(rows, 2000):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, number), run in groups(batches, key, ["role"]):
            best = sorted(reach([role_of(r) for (r,) in run], costs).items())
            yield conv, number, [x for (s, e), (c, t) in best for x in (s, e, c, t)]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), run in groups(batches, ["conv_id"], ["block", "best"]):
            blocks = [{(b[i], b[i + 1]): (b[i + 2], b[i + 3]) for i in range(0, len(b), 4)} for _, b in run]
            path = settle(blocks, costs)
            for i, ((number, _), (first, last, before)) in enumerate(zip(run, path, strict=True)):
                yield conv, number, first, last, before, i == 0, i == len(run) - 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, _), run in groups(batches, key, ["turn", "role", "text", "first", "last", "before", "begins", "ends"]):
            first, last, position, begins, ends = run[0][3:]
            for i, ((turn, role, text, *_), (state, turns, action)) in enumerate(zip(run, repair([role_of(r[1]) for r in run], first, last, costs), strict=True)):
                position += turns
                yield conv, turn, role, ROLES[state - 1], action, position - 1, render(state, action, text, begins and i == 0, ends and i == len(run) - 1)

    long, text, flag = pa.int64(), pa.string(), pa.bool_()
    best = sent.select(*key, "role").mapInArrow(lambda b: batched(reduce(b), ["conv_id", "block", "best"], [long, long, pa.list_(long)]), "conv_id long, block long, best array<long>")
    paths = best.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(lambda b: batched(decide(b), ["conv_id", "block", "first", "last", "before", "begins", "ends"], [*[long] * 5, flag, flag]), "conv_id long, block long, first long, last long, before long, begins boolean, ends boolean")
    paths = paths.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    met = rows.join(paths, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")
    return met.repartition(*key).sortWithinPartitions(*order).mapInArrow(lambda b: batched(write(b), ["conv_id", "turn", "role", "new_role", "action", "position", "rendered"], [long, long, text, text, text, long, text]), "conv_id long, turn long, role string, new_role string, action string, position long, rendered string")
