"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message and then user and assistant messages in turn,
from user to assistant. The automaton's states are what the last message was (0 none, 1 system,
2 user, 3 assistant). A turn takes a role, its own or another one (a relabel), and opens a message,
joins the previous message of the same role (a merge), or opens one after an empty message that is
inserted before it. The cheapest sequence of these is found by dynamic programming and rendered.

Conversations are cut into segments, so that a long one is spread over tasks. A segment of roles is
a matrix of costs from state to state; matrices of one conversation are chained to get the exact
costs on entry to each segment; with these each segment states, for every state it may end in, the
state it began in; the chain is walked back; then each segment's turns are repaired and rendered on
their own. The result does not depend on the cuts.

Order: turn (null last), then role, then a hash of the text, then the text. Ties of cost prefer,
at each turn from the end backwards, the smaller previous state, the kept role, and opening over
merging over inserting.

Defined results: null text renders as empty; an unknown or null role can become any role at the
lowest relabel cost; rows with a null conv_id form one conversation; rows that repeat are turns of
their own; an empty table gives an empty result; other columns are ignored. Each row is one turn
with its part of the rendered conversation; the parts in order make the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import written

ROLES = ("system", "user", "assistant")
NEW, MERGE, INSERT = 0, 1, 2
KINDS = ("open", "merge", "insert")
BIG = 1 << 40


@dataclass(frozen=True)
class RepairOptions:
    merge: int = 2
    relabel: int = 5
    relabel_unknown: int = 1
    insert: int = 4
    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    segment_rows: int = 4096
    task_turns: int = 8192


def steps(role: int, options: RepairOptions) -> list[list[tuple[int, int, int, int]]]:
    """For a turn of a role number (3: unknown) and each state: (cost, new role, kind, next state), in order of preference."""
    out = []
    for state in range(4):
        ways = []
        for to in sorted(range(3), key=lambda r: (r != role, r)):
            cost = 0 if to == role else options.relabel_unknown if role == 3 else options.relabel
            opens = state == 0 if to == 0 else state != 2 if to == 1 else state == 2
            if opens:
                ways.append((cost, to, NEW, to + 1))
            if state == to + 1:
                ways.append((cost + options.merge, to, MERGE, to + 1))
            if to and not opens:  # one empty message of the other role makes room
                ways.append((cost + options.insert, to, INSERT, to + 1))
        out.append(ways)
    return out


def end_costs(options: RepairOptions) -> list[int]:
    """Cost of ending in each state: after a user message an empty answer is inserted, after a system message both."""
    return [0, 2 * options.insert, options.insert, 0]


def tables(options: RepairOptions) -> list[list[list[tuple[int, int, int, int]]]]:
    return [steps(role, options) for role in range(4)]


def forward(codes: Iterable[int], entry: list[int], table) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """Costs of each state at the end, and for each turn and state the way there: (previous state, role, kind)."""
    costs, trace = list(entry), []
    for code in codes:
        after, ways = [BIG] * 4, [(-1, 0, 0)] * 4
        for state in range(4):
            if costs[state] < BIG:
                for cost, to, kind, target in table[code][state]:
                    if costs[state] + cost < after[target]:
                        after[target], ways[target] = costs[state] + cost, (state, to, kind)
        costs = after
        trace.append(ways)
    return costs, trace


def walk_back(trace: list[list[tuple[int, int, int]]], state: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The state at the start, and (state before, role, kind) of each turn, for a state at the end."""
    out = []
    for ways in reversed(trace):
        out.append(ways[state])
        state = ways[state][0]
    return state, out[::-1]


def _codes(text: str) -> list[int]:
    return [ord(c) - 48 for c in text]


def ordered_turns(turns: DataFrame, tasks: int, options: RepairOptions) -> DataFrame:
    """The turns in order, cut into segments: written (conv_id, turn, code, text, part, segment, place)."""
    known = F.lower(F.trim(F.col("role").cast("string")))
    code = F.when(known == "system", 0).when(known == "user", 1).when(known == "assistant", 2).otherwise(3)
    base = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), code.cast("int").alias("code"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("hash", F.xxhash64("text"))
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("hash")]
    # Ranges of the whole order: a long conversation goes to as many tasks as its rows fill.
    dealt = base.repartitionByRange(tasks, *order).sortWithinPartitions(*order, F.asc("text")).withColumn("part", F.spark_partition_id())

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, places], names=[*batch.schema.names, "place"])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", place bigint"
    numbered = dealt.mapInArrow(number, typed)
    return written(numbered.withColumn("segment", F.floor(F.col("place") / options.segment_rows)).drop("hash"), "chat-turns")


def _mapped(segments: DataFrame, fn, schema: str) -> DataFrame:
    """Adds columns that `fn(row dict) -> tuple` computes, segment by segment."""
    names = [part.split(" ")[0] for part in schema.split(", ")]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + ", " + schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(row) for row in batch.to_pylist()]
            kinds = [pa.string() if "string" in p else pa.list_(pa.int64()) for p in schema.split(", ")]
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return segments.mapInArrow(run, typed)


def _chained(segments: DataFrame, tasks: int, columns: str, fn, backwards: bool) -> DataFrame:
    """Runs `fn(values, state) -> (value for the row, next state)` along each conversation's segments.

    A conversation has one small row per segment_rows turns here; rows are streamed in order.
    """
    order = [F.desc("part"), F.desc("segment")] if backwards else [F.asc("part"), F.asc("segment")]
    dealt = segments.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", *order)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + f", {columns}"
    name, kind = columns.split(" ")[0], pa.int64() if "bigint" in columns and "array" not in columns else pa.list_(pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    current, state = row["conv_id"], None
                value, state = fn(row, state)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, name])

    return dealt.mapInArrow(run, typed)


def repaired(turns: DataFrame, options: RepairOptions = RepairOptions()) -> DataFrame:
    """conv_id, turn, role (repaired), action, inserted_before, inserted_after, rendered; one row per turn."""
    # The rows that go from task to task are small, and adaptive execution would join them into one.
    tasks = 1 + turns.count() // options.task_turns
    rows = ordered_turns(turns, tasks, options)
    key = ["conv_id", "part", "segment"]
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"].cast("string")), "")
    # At most segment_rows one-digit roles per group.
    segments = rows.select(*key, "place", "code").repartition(tasks, *key).groupBy(*key).agg(digits.alias("codes"), F.min("place").alias("first_place"))
    table, ends, begin = tables(options), end_costs(options), [0, BIG, BIG, BIG]

    def matrix_of(row):
        return ([c for s in range(4) for c in forward(_codes(row["codes"]), [0 if i == s else BIG for i in range(4)], table)[0]],)

    def enter(row, state):
        now, m = state or begin, row["matrix"]
        return now, [min(BIG, min(now[s] + m[4 * s + e] for s in range(4))) for e in range(4)]

    def origins(row):
        costs, trace = forward(_codes(row["codes"]), row["entry"], table)
        return ([walk_back(trace, e)[0] if costs[e] < BIG else -1 for e in range(4)], costs)

    def leave(row, state):
        if state is None:  # the conversation's last segment
            costs = row["costs"]
            state = min(range(4), key=lambda s: (costs[s] + ends[s], s))
            return state + 10, row["origins"][state]
        return state, row["origins"][state]

    def actions(row):
        _, trace = forward(_codes(row["codes"]), row["entry"], table)
        _, path = walk_back(trace, row["exit"] % 10)
        return ("".join(f"{before}{role}{kind}" for before, role, kind in path),)

    segments = _chained(_mapped(segments, matrix_of, "matrix array<bigint>"), tasks, "entry array<bigint>", enter, False).drop("matrix")
    segments = _chained(_mapped(segments, origins, "origins array<bigint>, costs array<bigint>"), tasks, "exit bigint", leave, True).drop("origins", "costs")
    segments = written(_mapped(segments, actions, "actions string").select(*key, "first_place", "exit", F.length("codes").alias("turns"), "actions"), "chat-actions")
    on = rows["conv_id"].eqNullSafe(segments["conv_id"]) & (rows["part"] == segments["part"]) & (rows["segment"] == segments["segment"])
    at = (F.col("place") - F.col("first_place")).cast("int") * 3
    digit = lambda i: F.substring(F.col("actions"), at + i + 1, F.lit(1)).cast("int")
    both = rows.join(segments, on).select(rows["conv_id"], "turn", "code", "text", digit(0).alias("before"), digit(1).alias("to"), digit(2).alias("kind"), "exit", ((F.col("exit") >= 10) & (F.col("place") - F.col("first_place") == F.col("turns") - 1)).alias("last"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("to") + 1)
    head = lambda name: F.replace(F.lit(options.head), F.lit("{role}"), name)
    tail, empty = F.lit(options.tail), lambda name: F.concat(head(name), F.lit(options.tail))
    other = F.when(F.col("to") == 1, "assistant").otherwise("user")
    # A turn that opens a message closes the one before; the last turn closes its own.
    opening = F.concat(F.when(F.col("before") > 0, tail).otherwise(""), F.when(F.col("kind") == INSERT, empty(other)).otherwise(""), head(role))
    missing = F.when(F.col("last") & (F.col("to") == 0), 2).when(F.col("last") & (F.col("to") == 1), 1).otherwise(0)
    closing = F.when(F.col("last"), F.concat(tail, F.when(missing == 2, empty(F.lit("user"))).otherwise(""), F.when(missing > 0, empty(F.lit("assistant"))).otherwise(""))).otherwise("")
    rendered = F.concat(F.when(F.col("kind") == MERGE, "\n").otherwise(opening), "text", closing)
    return both.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.when(F.col("code") == F.col("to"), "").otherwise("+relabel")).alias("action"),
        (F.col("kind") == INSERT).cast("int").alias("inserted_before"),
        missing.alias("inserted_after"),
        rendered.alias("rendered"),
    )


__all__ = ["RepairOptions", "end_costs", "forward", "repaired", "steps", "tables", "walk_back"]
