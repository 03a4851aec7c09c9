"""Exact top-k search by inner product, one block of documents at a time.

Rows are laid out in ranges of ``vec_id``. A range of 256 rows is a block with a forward index (its whole vectors) and
the maximum and minimum of every term (component). For a query the terms' extremes add up to a bound on any score in the
block. Blocks are scored in the order of their bounds until the bound falls below the k-th score found; a block whose
bound equals it is still scored, because of ties. Each query starts with the k-th score of its own block as a floor.

Blocks are packed into shards of bounded size, queries into batches of bounded size; every batch meets every shard, a
shard keeps k rows a query at most, and a group-limited window merges them. Nothing is kept whole in one task.

Defined results: rows with a NULL id, a NULL vector or a NULL or non-finite component take no part; shorter vectors count
as filled with zeros; repeated rows (same id and vector) count once; rows with the query's own id are never its answers;
components and scores beyond a long are clipped to it; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable

BLOCK = 256
SHARD = 16384
BATCH = 512
TOP = 5
_LONG = (1 << 63) - 1


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as doubles; None for NULL vectors and those holding NULL or non-finite components."""
    found: list[np.ndarray | None] = []
    for value in column:
        values = value.values
        if values is None or values.null_count:
            found.append(None)
            continue
        vector = values.to_numpy(zero_copy_only=False).astype(np.float64)
        found.append(vector if np.isfinite(vector).all() else None)
    return found


def scaled(rows: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """``id, cells``: integer components floor(scale * x) as packed longs, of the rows that take part."""

    def run(batches):
        for batch in batches:
            ids, cells = [], []
            for key_value, v in zip(batch.column(0).to_pylist(), vectors_of(batch.column(1)), strict=True):
                if v is not None:
                    ids.append(key_value)
                    whole = np.floor(scale * v)
                    cells.append(np.where(np.abs(whole) < 2.0**62, whole, np.sign(whole) * 2.0**62).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.binary())], ["id", "cells"])

    chosen = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).filter("id is not null")
    return chosen.mapInArrow(run, "id bigint, cells binary")


def _matrix(cells: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(c, np.int64) for c in cells]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))  # type: ignore[return-value]


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every sum of products stays exact in doubles."""
    return not a.size or not b.size or a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**52


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T as longs: in doubles while every sum stays exact, else in Python's integers."""
    a, b = _same_width(a, b)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if _exact(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each query, by score, then id."""
    order = np.lexsort((ids, ~score, query))  # ~ turns the order round and cannot overflow
    first = np.r_[True, query[order][1:] != query[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


def _encode(m: np.ndarray) -> bytes:
    small = np.int16 if m.size and np.abs(m).max() < 1 << 15 else np.int64
    return np.int64(small().itemsize).tobytes() + np.int64(len(m)).tobytes() + m.astype(small).tobytes()


def _decode(data: bytes) -> np.ndarray:
    size, rows = np.frombuffer(data, np.int64, 2)
    cells = np.frombuffer(data, np.int16 if size == 2 else np.int64, offset=16).astype(np.int64)
    return cells.reshape(int(rows), -1) if rows else cells.reshape(0, 0)


def build_shards(rows: DataFrame, every: int, k: int) -> DataFrame:
    """``shard, ids, cells, queries, query_cells, floors``: one row per shard of blocks in order of id."""
    shards = max(1, -(-rows.count() // SHARD))
    laid = rows.withColumn("salt", F.xxhash64("cells")).repartitionByRange(shards, "id", "salt").sortWithinPartitions("id", "cells")

    def run(batches):
        last, ids, cells = None, [], []
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row != last:
                    ids.append(row[0])
                    cells.append(row[1])
                last = row
        if not ids:
            return
        names, m, floors = np.array(ids, np.int64), _matrix(cells), []
        asks = np.flatnonzero(names % every == 0)
        for i in asks:
            block = slice(i // BLOCK * BLOCK, i // BLOCK * BLOCK + BLOCK)
            own = np.sort(inner(m[i : i + 1], m[block])[0][names[block] != names[i]])
            floors.append(own[-k] if len(own) >= k else -_LONG - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([x], pa.binary()) for x in (
                names.tobytes(), _encode(m), names[asks].tobytes(), _encode(m[asks]), np.array(floors, np.int64).tobytes()))],
            ["shard", "ids", "cells", "queries", "query_cells", "floors"],
        )

    return laid.select("id", "cells").mapInArrow(run, "shard bigint, ids binary, cells binary, queries binary, query_cells binary, floors binary")


def search_shard(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, ids: np.ndarray, cells: np.ndarray, k: int):
    """Query numbers, ids and scores of the k best rows of a shard for each query, none below its floor."""
    queries, cells = _same_width(queries, cells)
    starts = np.arange(0, len(cells), BLOCK)
    upper, lower = np.maximum.reduceat(cells, starts), np.minimum.reduceat(cells, starts)
    if _exact(queries, cells):
        bounds = inner(np.maximum(queries, 0), upper) + inner(np.minimum(queries, 0), lower)
    else:  # scores may be clipped, and sums of clipped parts bound nothing
        bounds = np.full((len(queries), len(starts)), _LONG)
    order = np.argsort(~bounds, axis=1, kind="stable")
    everyone, kth = np.arange(len(queries)), floors.copy()
    found = (np.zeros(0, np.int64),) * 3
    for turn in range(len(starts)):
        block = order[:, turn]
        active = bounds[everyone, block] >= kth
        if not active.any():
            break
        pieces = [found]
        for b in np.unique(block[active]):
            asked = np.flatnonzero(active & (block == b))
            names, scores = ids[starts[b] : starts[b] + BLOCK], inner(queries[asked], cells[starts[b] : starts[b] + BLOCK])
            q, at = np.nonzero((scores >= kth[asked, None]) & (names[None] != own[asked, None]))
            pieces.append((asked[q], names[at], scores[q, at]))
        q, names, scores = (np.concatenate(x) for x in zip(*pieces, strict=True))
        keep = _best(q, scores, names, k)
        found = q, names, scores = q[keep], names[keep], scores[keep]
        counts = np.bincount(q, minlength=len(queries))
        full = np.flatnonzero(counts >= k)
        kth[full] = np.maximum(kth[full], scores[np.cumsum(counts)[full] - 1])
    return found


def top_k(rows: DataFrame, k: int = TOP, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row whose id is divisible by ``every``."""
    shards = durable(build_shards(scaled(rows, scale, key, vector), every, k), "shards")
    last = shards.agg(F.max("shard")).first()[0]

    def ask(batches):
        """Query batches of bounded size."""
        for batch in batches:
            for names, cells, floors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, m, floors = np.frombuffer(names, np.int64), _decode(cells), np.frombuffer(floors, np.int64)
                for i in range(0, len(names), BATCH):
                    part = slice(i, i + BATCH)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.binary()) for x in (names[part].tobytes(), _encode(m[part]), floors[part].tobytes())],
                        ["queries", "query_cells", "floors"],
                    )

    def run(batches):
        for batch in batches:
            for names, cells, floors, ids, store in zip(*(batch.column(i) for i in range(5)), strict=True):
                own = np.frombuffer(names.as_py(), np.int64)
                q, found, score = search_shard(
                    _decode(cells.as_py()), own, np.frombuffer(floors.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int64), _decode(store.as_py()), k
                )
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    asked = shards.select("queries", "query_cells", "floors").mapInArrow(ask, "queries binary, query_cells binary, floors binary")
    spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last or 0).cast("bigint"))))
    met = spread.join(shards.select("shard", "ids", "cells"), "shard").select("queries", "query_cells", "floors", "ids", "cells")
    local = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with cells as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id,
    cast(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) as bigint) as score
    from cells q join cells c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
