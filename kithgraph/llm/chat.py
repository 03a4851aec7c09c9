"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the assistant. Dynamic
programming over this automaton picks the cheapest repair: a turn is kept, merged into the turn before, given another
role, or preceded by an empty turn of the missing role. The repaired sequence is then rendered.

The automaton has four states, so a stretch of turns is a 4 x 4 matrix of costs (minimum, plus), and stretches combine by
matrix product. A conversation of any length is cut into stretches of ``STRETCH`` turns, stretches are combined in a tree,
and each stretch is then repaired between its known first and last state. No task holds a whole long conversation, and the
rendered text is one piece per turn; the pieces of a conversation in order are its rendering.

Defined results: rows with a NULL conversation id form one conversation; turns are ordered by (turn, role, text) with NULL
first, so repeated rows are turns of their own; a NULL or unknown role must be relabelled; a NULL text is empty; among
repairs of equal cost the earlier state in ``STATES`` wins, stretch by stretch; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import with_rank_within
from ..session import durable

# States are the role of the last turn written; legal next roles; costs.
STATES = ["start", "system", "user", "assistant"]
ROLES = STATES[1:]
NEXT = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}
MERGE, RELABEL, INSERT = 1, 2, 3
LAST = "assistant"
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
STRETCH = 1000
_FAR = 1 << 40


def _fill(state: str, role: str) -> list[str] | None:
    """Fewest empty turns that make ``role`` legal after ``state``."""
    paths: list[tuple[str, list[str]]] = [(state, [])]
    seen = {state}
    for at, path in paths:
        if role in NEXT[at]:
            return path
        for step in NEXT[at]:
            if step not in seen:
                seen.add(step)
                paths.append((step, [*path, step]))
    return None


# For each state and new role: empty turns to write first; None where nothing helps.
FILLS = {(s, r): _fill(s, r) for s in STATES for r in ROLES}
# Empty turns that end a conversation legally in each state.
ENDINGS = {s: [] if s in ("start", LAST) else [*_fill(s, LAST), LAST] for s in STATES}


def moves(role: str | None) -> list[list[tuple[int, str]]]:
    """Cost and action from each state (row) to each state for a turn of ``role``."""
    table = [[(_FAR, "")] * len(STATES) for _ in STATES]
    for s, state in enumerate(STATES):
        for t, target in enumerate(ROLES, 1):
            changed = RELABEL * (target != role)
            options = []
            if target == state:
                options.append((MERGE + changed, "merge"))
            if FILLS[state, target] is not None:
                fill = FILLS[state, target]
                options.append((INSERT * len(fill) + changed, "insert" if fill else "open"))
            if options:
                table[s][t] = min(options, key=lambda x: x[0])
    return table


_MOVES = {role: moves(role) for role in ROLES}
_UNKNOWN = moves(None)
_COST = {role: np.array([[c for c, _ in row] for row in m]) for role, m in [*_MOVES.items(), (None, _UNKNOWN)]}


def _cost(role: str | None) -> np.ndarray:
    return _COST.get(role, _COST[None])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _FAR)


def states_through(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The cheapest states before, between and after the matrices, with given ends."""
    costs = [np.where(np.arange(len(STATES)) == first, 0, _FAR)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), _FAR))
    path = [last]
    for before, m in zip(reversed(costs[:-1]), reversed(matrices), strict=True):
        path.append(int(np.argmin(before + m[:, path[-1]])))
    return path[::-1]


def best_end(matrix: np.ndarray) -> int:
    return int(np.argmin(matrix[0] + np.array([INSERT * len(ENDINGS[s]) for s in STATES])))


def _plain(text: str | None) -> str:
    """A text cannot open or close turns of its own."""
    return (text or "").replace("<|im_", "<| im_")


def repair(rows: list[tuple[str | None, str | None]], first: int, last: int, ends: bool) -> Iterator[tuple[str, str, str, int, str]]:
    """Out role, action, inserted roles, cost and rendered piece for each (role, text) between two states."""
    path = states_through([_cost(role) for role, _ in rows], first, last)
    for i, (role, text) in enumerate(rows):
        s, t = path[i], path[i + 1]
        cost, action = (_MOVES.get(role) or _UNKNOWN)[s][t]
        state, out, fill = STATES[s], STATES[t], []
        if action == "merge":
            piece = JOIN + _plain(text)
        else:
            fill = FILLS[state, out] or []
            piece = (CLOSE if s else "") + "".join(OPEN.format(r) + CLOSE for r in fill) + OPEN.format(out) + _plain(text)
        if ends and i + 1 == len(rows):
            piece += CLOSE + "".join(OPEN.format(r) + CLOSE for r in ENDINGS[out])
            cost += INSERT * len(ENDINGS[out])
            fill = fill + ENDINGS[out]
        yield out, action + ("+relabel" if out != role else ""), ",".join(fill), cost, piece


def _groups(batches, key: slice):
    """Rows of sorted batches by key; the rows of one key are a stretch, so they fit."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[key])


def _laid(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def _boundaries(turns: DataFrame) -> DataFrame:
    """``no_id, id, stretch, first, last``: the states at both ends of every stretch of long conversations."""
    schema = "no_id boolean, id bigint, stretch bigint, matrix binary"

    def summed(batches):
        for (no_id, key, stretch), rows in _groups(batches, slice(0, 3)):
            total = None
            for r in rows:
                m = np.frombuffer(r[4], np.int64).reshape(4, 4) if isinstance(r[4], bytes) else _cost(r[4])
                total = m if total is None else product(total, m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([no_id]), pa.array([key], pa.int64()), pa.array([stretch], pa.int64()), pa.array([total.astype(np.int64).tobytes()], pa.binary())],
                ["no_id", "id", "stretch", "matrix"],
            )

    def between(batches):
        for (no_id, key, _), rows in _groups(batches, slice(0, 3)):
            rows = list(rows)
            path = states_through([np.frombuffer(r[4], np.int64).reshape(4, 4) for r in rows], rows[0][5], rows[0][6])
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([no_id] * n), pa.array([key] * n, pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(path[:-1], pa.int32()), pa.array(path[1:], pa.int32())],
                ["no_id", "id", "stretch", "first", "last"],
            )

    keys = ["no_id", "id", "stretch"]
    levels = [durable(_laid(turns, keys, "position").select(*keys, "position", "role").mapInArrow(summed, schema), "stretches")]
    while levels[-1].agg(F.max("stretch")).first()[0]:
        up = levels[-1].select("no_id", "id", F.expr(f"stretch div {STRETCH}").alias("stretch"), F.col("stretch").alias("position"), "matrix")
        levels.append(durable(_laid(up, keys, "position").mapInArrow(summed, schema), "stretches"))

    def ends(batches):
        for batch in batches:
            last = [best_end(np.frombuffer(m, np.int64).reshape(4, 4)) for m in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([0] * len(last), pa.int32()), pa.array(last, pa.int32())], ["no_id", "id", "stretch", "first", "last"])

    known = levels.pop().mapInArrow(ends, "no_id boolean, id bigint, stretch bigint, first int, last int")
    while levels:
        below = levels.pop().select("no_id", "id", F.expr(f"stretch div {STRETCH}").alias("stretch"), F.col("stretch").alias("position"), "matrix")
        met = _laid(below.join(known, keys).select(*keys, "position", "matrix", "first", "last"), keys, "position")
        known = met.mapInArrow(between, "no_id boolean, id bigint, stretch bigint, first int, last int")
    return known


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, position, out_role, action, inserted, cost, piece``: one row per turn of ``turns``."""
    known = turns.select(
        F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("id"), "turn", "role", "text"
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    ranked = with_rank_within(known, ["no_id", "id"], order)
    ranked = ranked.withColumn("stretch", F.expr(f"(position - 1) div {STRETCH}"))
    keys = ["no_id", "id", "stretch"]
    long = ranked.agg(F.max("stretch")).first()[0]
    columns = [*keys, "position", "turn", "role", "text"]
    if long:
        ends = _boundaries(ranked)
        final = ranked.groupBy("no_id", "id").agg(F.max("stretch").alias("end"))
        rows = ranked.join(ends, keys).join(final, ["no_id", "id"]).select(*columns, "first", "last", (F.col("stretch") == F.col("end")).alias("ends"))
    else:
        rows = ranked.select(*columns, F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(True).alias("ends"))

    def run(batches):
        for (no_id, key, _), group in _groups(batches, slice(0, 3)):
            group = list(group)
            first, last, ends = group[0][7:10]
            if last < 0:
                total = _cost(group[0][5])
                for r in group[1:]:
                    total = product(total, _cost(r[5]))
                last = best_end(total)
            out = list(zip(*repair([(r[5], r[6]) for r in group], first, last, ends), strict=True))
            given = [[None if no_id else key] * len(group), [r[4] for r in group], [r[5] for r in group], [r[3] for r in group]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*given, *out], kinds, strict=True)], names)

    names = ["conv_id", "turn", "role", "position", "out_role", "action", "inserted", "cost", "piece"]
    schema = "conv_id bigint, turn bigint, role string, position bigint, out_role string, action string, inserted string, cost bigint, piece string"
    return _laid(rows, keys, "position").mapInArrow(run, schema)
