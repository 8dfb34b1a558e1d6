"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is an optional system turn, then user and assistant in turn, ending
with the assistant.  A turn may be kept, given another role, or joined to the turn
before it, and empty turns may be put in; dynamic programming over the four states of
this automaton finds the cheapest repair.

Turns are range-partitioned by conversation and place, so a conversation of any length
is split over tasks.  One that fits into a partition is solved there.  For the others
(one or two a partition) each piece gives the 4 x 4 matrix of its cheapest paths; the
costs at its beginning follow from the matrices before it, and the way back through the
pieces fixes where each path leaves it.  The result is that of one long program.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinset.llm.tables import stored

MERGE, RELABEL, INSERT = 1, 2, 3      # cost of each repair of a turn
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
FIRST = (0, FAR, FAR, FAR)


def _insertions() -> list[list[tuple[int, tuple[int, ...]]]]:
    """Cost and states of the empty user and assistant turns between any two states."""
    out = []
    for begin in range(4):
        best = {begin: ()}
        line = [begin]
        for state in line:
            for after in NEXT[state]:
                if after != SYSTEM and after not in best:
                    best[after] = (*best[state], after)
                    line.append(after)
        out.append([(INSERT * len(best[s]), best[s]) if s in best else (FAR, ()) for s in range(4)])
    return out


INSERTIONS = _insertions()
Move = tuple[int, tuple[int, ...], bool]   # cost, empty turns before, joined to the turn before


def _moves(role: int | None) -> list[list[Move | None]]:
    """The cheapest way of each state to each state over one turn of this role."""
    table: list[list[Move | None]] = [[None] * 4 for _ in range(4)]
    for begin in range(4):
        for end in (SYSTEM, USER, ASSISTANT):
            change = 0 if role == end else RELABEL
            ways: list[Move] = [(change + MERGE, (), True)] if begin == end else []
            for between in range(4):
                cost, empty = INSERTIONS[begin][between]
                if cost < FAR and end in NEXT[between]:
                    ways.append((cost + change, empty, False))
            table[begin][end] = min(ways, default=None, key=lambda w: (w[0], len(w[1]), w[2]))
    return table


MOVES = {role: _moves(state) for role, state in (*zip(ROLES, (SYSTEM, USER, ASSISTANT)), (None, None))}
FINISH = [INSERTIONS[s][ASSISTANT] for s in range(4)]


def forward(roles: list[str], costs: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost of every state before the first turn and after each."""
    out = [tuple(costs)]
    for role in roles:
        table, now = MOVES.get(role, MOVES[None]), out[-1]
        out.append(tuple(min(now[b] + table[b][e][0] if table[b][e] else FAR for b in range(4)) for e in range(4)))
    return out


def backward(roles: list[str], costs: list[tuple[int, ...]], end: int) -> list[int]:
    """States before the first turn and after each of a cheapest path to ``end``; of
    equally cheap ways the one from the lower state."""
    path = [end]
    for i in range(len(roles) - 1, -1, -1):
        table = MOVES.get(roles[i], MOVES[None])
        now = costs[i]
        path.append(min(range(4), key=lambda b: (now[b] + table[b][path[-1]][0] if table[b][path[-1]] else FAR, b)))
    return path[::-1]


def last_state(costs: tuple[int, ...]) -> int:
    return min(range(4), key=lambda s: (costs[s] + FINISH[s][0], s))


def pieces(turns: list[tuple[str, str]], path: list[int], ends: bool) -> list[dict]:
    """What each turn (role, text) of a path becomes; ``ends`` closes the conversation."""
    out = []
    for i, (role, text) in enumerate(turns):
        cost, empty, joined = MOVES.get(role, MOVES[None])[path[i]][path[i + 1]]
        final = ROLES[path[i + 1] - 1]
        shown = ("\n\n" + text) if joined else "".join(
            [CLOSE if path[i] != START else "", *(OPEN.format(ROLES[s - 1]) + CLOSE for s in empty), OPEN.format(final), text])
        after: tuple[int, ...] = ()
        if ends and i == len(turns) - 1:
            more, after = FINISH[path[-1]]
            cost += more
            shown += CLOSE + "".join(OPEN.format(ROLES[s - 1]) + CLOSE for s in after)
        out.append({"final_role": final, "joined": joined, "inserted_before": len(empty),
                    "inserted_after": len(after), "cost": cost, "rendered": shown})
    return out


OUTPUT = ("conv_id long, place long, turn long, role string, final_role string, joined boolean, "
          "inserted_before int, inserted_after int, cost long, rendered string")
_INPUT = ("conv_id", "piece", "place", "turn", "role", "text")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of one (conv_id, piece) after another; the input is sorted by these."""
    held: list[tuple] = []
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in names))
        for _, run in groupby(rows, key=lambda r: r[:2]):
            run = list(run)
            if held and held[0][:2] != run[0][:2]:
                yield held
                held = []
            held += run
    if held:
        yield held


def _rows(run: list[tuple], costs: tuple[int, ...], end: int | None, ends: bool) -> pa.RecordBatch:
    roles = [r[4] for r in run]
    table = forward(roles, costs)
    path = backward(roles, table, last_state(table[-1]) if end is None else end)
    made = pieces([(r[4], r[5]) for r in run], path, ends)
    rows = [{"conv_id": r[0], "place": r[2], "turn": r[3], "role": r[4]} | m for r, m in zip(run, made)]
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                        ("final_role", pa.string()), ("joined", pa.bool_()), ("inserted_before", pa.int32()),
                        ("inserted_after", pa.int32()), ("cost", pa.int64()), ("rendered", pa.string())])
    return pa.RecordBatch.from_pylist(rows, schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, _INPUT):
        yield _rows(run, FIRST, None, True)


def _solve_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, (*_INPUT, "costs", "leaves", "last")):
        yield _rows(run, tuple(run[0][6]), run[0][7], run[0][8])


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least cost from each state before a piece to each state after it."""
    for run in _runs(batches, _INPUT):
        roles = [r[4] for r in run]
        flat = [c for b in range(4) for c in forward(roles, tuple(0 if s == b else FAR for s in range(4)))[-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([run[0][0]], pa.int64()), pa.array([run[0][1]], pa.int64()), pa.array([flat], pa.list_(pa.int64()))],
            ["conv_id", "piece", "matrix"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state a path enters a piece in, for each state it may leave it in."""
    for run in _runs(batches, (*_INPUT, "costs")):
        roles = [r[4] for r in run]
        table = forward(roles, tuple(run[0][6]))
        enters = [backward(roles, table, end)[0] for end in range(4)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([run[0][0]], pa.int64()), pa.array([run[0][1]], pa.int64()), pa.array([enters], pa.list_(pa.int64()))],
            ["conv_id", "piece", "enters"])


def _costs(group: pd.DataFrame) -> pd.DataFrame:
    """Costs at the beginning of each piece of a conversation, and after its last."""
    group = group.sort_values("piece")
    now, out = FIRST, []
    for flat in group["matrix"]:
        out.append(list(now))
        now = tuple(min(min(now[b] + int(flat[4 * b + e]), FAR) for b in range(4)) for e in range(4))
    return pd.DataFrame({"conv_id": group["conv_id"], "piece": group["piece"], "costs": out,
                         "end": [last_state(now)] * len(out)})


def _leaves(group: pd.DataFrame) -> pd.DataFrame:
    """The state the path leaves each piece in, from the last piece back."""
    group = group.sort_values("piece", ascending=False)
    state, out = int(group["end"].iloc[0]), []
    for enters in group["enters"]:
        out.append(state)
        state = int(enters[state])
    return pd.DataFrame({"conv_id": group["conv_id"], "piece": group["piece"], "costs": group["costs"],
                         "leaves": out, "last": [i == 0 for i in range(len(out))]})


def repair_roles(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text, ...), see OUTPUT.

    ``rendered`` of a conversation's rows, joined in order of ``place``, is the repaired
    conversation; ``cost`` sums to the cost of the repair.  Turns stand in order of turn
    (null first), then role, then text; repeated rows are turns of their own.  A role
    other than the three, or null, counts as unknown and is given one.  A null text is
    empty; a null conv_id is a conversation of its own.  Texts and conversations may
    have any length; other columns are not read; an empty table gives no rows.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.lower(F.trim(F.col("role").cast("string"))).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(rows.select("conv_id", F.spark_partition_id().cast("long").alias("piece"),
                              F.monotonically_increasing_id().alias("place"), "turn", "role", "text"), "turns")
    # A partition's border splits one conversation at most.
    counts = rows.groupBy("conv_id").agg(F.min("piece").alias("x"), F.max("piece").alias("y")).where("x <> y")
    split = stored(counts.select(F.col("conv_id").alias("_id")), "split")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")

    match = rows["conv_id"].eqNullSafe(split["_id"])
    whole = dealt(rows.join(F.broadcast(split), match, "left_anti").select(*_INPUT)).mapInArrow(_solve, OUTPUT)
    long_ = stored(rows.join(F.broadcast(split), match, "left_semi").select(*_INPUT), "long")
    matrices = dealt(long_).mapInArrow(_matrix, "conv_id long, piece long, matrix array<long>")
    begins = stored(matrices.groupBy("conv_id").applyInPandas(
        _costs, "conv_id long, piece long, costs array<long>, end long"), "begins")

    def beside(right: DataFrame, *names: str) -> DataFrame:
        right = right.withColumnsRenamed({"conv_id": "_id", "piece": "_piece"})
        same = long_["conv_id"].eqNullSafe(right["_id"]) & (long_["piece"] == right["_piece"])
        return dealt(long_.join(right, same).select(*_INPUT, *names))

    enters = beside(begins, "costs").mapInArrow(_entries, "conv_id long, piece long, enters array<long>")
    enters = enters.withColumnsRenamed({"conv_id": "_id", "piece": "_piece"})
    both = begins.join(enters, begins["conv_id"].eqNullSafe(enters["_id"]) & (begins["piece"] == enters["_piece"]))
    leaves = stored(both.select("conv_id", "piece", "costs", "end", "enters").groupBy("conv_id").applyInPandas(
        _leaves, "conv_id long, piece long, costs array<long>, leaves long, last boolean"), "leaves")
    return whole.union(beside(leaves, "costs", "leaves", "last").mapInArrow(_solve_piece, OUTPUT))
