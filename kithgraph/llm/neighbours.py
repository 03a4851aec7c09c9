"""Near duplicates of embeddings through a robust-pruned flat graph.

Equal vectors of one label are taken together first. Each label is split, level by level, around pivots into cells of
bounded size, and a vector goes to its ``overlap`` nearest pivots, so the cells are overlapping cluster shards. In every
shard each vector gets robust-pruned neighbours; the lists of all shards are united. Then a beam search over the united
lists starts from the shard's medoid and the vector itself, and once it is within range it expands through everything in
range. A search leaves its shard: round by round it goes on in the other shards of what is in range and of the best
points that it met, entering by these points, until there is no such shard left. Of the best points only those are
followed that are within twice the angle, since others are in range of nothing in range; instead a search also visits the
shards next in line to its own, ``PROBES`` at each level, from their medoids. Pairs are verified by cosine in double
precision. Last, the links of a fixed-size sample of vectors, drawn by hash whatever was found, are compared with brute
force over all rows; if too few were found, by vector or by link, the shards are rebuilt with more overlap.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components, and rows without a label, link with
nothing and are kept; vectors of different length do not link; repeated rows (same id, label, vector) count once; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import connected_components
from ..session import durable
from .search import vectors_of

LEAST_COSINE = 0.93
CELL = 2048
PIVOTS = 64
CANDIDATES = 48
DEGREE = 24
ALPHA = 1.2
BEAM = 16
HOPS = 60
SEARCHES = 64
OVERLAPS = (2, 4, 8)
PROBES = 1
AUDIT_ROWS = 4096
LEAST_RECALL = 0.95


def _valid(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: distinct rows that can link, vectors as packed doubles."""

    def run(batches):
        for batch in batches:
            vectors = vectors_of(batch.column(2))
            packed = [v.tobytes() if v is not None and np.isfinite(n := float(v @ v)) and n > 0 else None for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "vector"])

    columns = [F.col("vec_id").cast("bigint"), F.col("label").cast("string"), "embedding"]
    return rows.select(*columns).filter("label is not null and vec_id is not null").mapInArrow(run, "vec_id bigint, label string, vector binary").filter("vector is not null")


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_cell(batches):
    """Rows of batches sorted by cell, cell by cell."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for cell, group in groupby(rows, key=lambda r: r[0]):
        yield cell, list(group)


def shards_of(points: DataFrame, overlap: int) -> DataFrame:
    """``cell, id, vector``: cells of at most ``CELL`` points; each level sends a point to its nearest pivots."""
    return placed(points, overlap).filter("member").drop("member")


def placed(points: DataFrame, overlap: int) -> DataFrame:
    """``cell, id, vector, member``: the members of each cell, and the points that only visit it.

    A member visits the cells of the next ``PROBES`` pivots; a visitor of a large cell visits the nearest of its cells.
    """
    wide = F.concat_ws("/", "label", F.length("vector").cast("string"))
    laid = durable(points.select(wide.alias("cell"), "id", "vector", F.lit(True).alias("member")), "cells")
    done, before = None, None
    while True:
        counts = laid.filter("member").groupBy("cell").agg(F.count("*").alias("n"))
        size = counts.agg(F.max("n")).first()[0] or 0
        # Rows that no pivot can part any more (nearly all at one point) stay together.
        if size <= CELL or (before and size > 0.9 * before):
            return laid if done is None else done.unionByName(laid)
        before = size
        rows = laid.join(counts, "cell")
        done = rows.filter(F.col("n") <= CELL).drop("n") if done is None else done.unionByName(rows.filter(F.col("n") <= CELL).drop("n"))
        large = rows.filter(F.col("n") > CELL)
        wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(4), F.ceil(F.col("n") * overlap * 2 / CELL)))
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
        chosen = large.filter("member").withColumn("at", F.row_number().over(order)).filter((F.col("at") <= PIVOTS) & (F.col("at") <= wanted))
        pivots = chosen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "vector"))).alias("pivots"))

        def deal(batches):
            for batch in batches:
                out: list[list] = [[], [], [], []]
                cells = {}
                for cell, key, vector, member, near in zip(*(batch.column(i) for i in range(5)), strict=True):
                    cell, member = cell.as_py(), member.as_py()
                    if cell not in cells:
                        cells[cell] = _unit([p["vector"] for p in near.as_py()])
                    x = np.frombuffer(vector.as_py(), np.float64)
                    line = np.argsort(-(cells[cell] @ x), kind="stable")[: overlap + PROBES * member]
                    for turn, p in enumerate(line.tolist()):
                        for column, value in zip(out, (f"{cell}.{p}", key.as_py(), vector.as_py(), member and turn < overlap), strict=True):
                            column.append(value)
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["cell", "id", "vector", "member"])

        met = large.join(pivots, "cell").select("cell", "id", "vector", "member", F.col("pivots").alias("near"))
        laid = durable(met.mapInArrow(deal, "cell string, id bigint, vector binary, member boolean"), "cells")


def robust_prune(unit: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Neighbours (-1: none) of the points ``own`` from their candidates, nearest first.

    A candidate is dropped when a chosen neighbour is nearer to it, by the factor ALPHA, than the point itself is.
    """
    gap = lambda s: np.sqrt(np.maximum(0.0, 2 - 2 * s))
    sims = unit @ unit.T if len(unit) <= 2560 else None
    sim = (lambda p, c: sims[p[:, None], c]) if sims is not None else (lambda p, c: np.einsum("ij,ikj->ik", unit[p], unit[c]))
    mine = gap(sim(own, candidates))
    alive = np.ones(candidates.shape, bool)
    chosen = np.full((len(own), DEGREE), -1)
    rows = np.arange(len(own))
    for turn in range(DEGREE):
        at = alive.argmax(axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        picked = candidates[rows, at]
        chosen[some, turn] = picked[some]
        alive[rows, at] = False
        alive &= ~some[:, None] | (ALPHA * gap(sim(picked, candidates)) > mine)
    return chosen


def _prune_slice(unit: np.ndarray, near: np.ndarray, at: int) -> np.ndarray:
    """robust_prune for a slice of the points, which bounds its memory."""
    part = near[at : at + 512]
    names, local = np.unique(np.concatenate([np.arange(at, at + len(part)), part.ravel()]), return_inverse=True)
    base = unit[names]
    own, candidates = local[: len(part)], local[len(part) :].reshape(part.shape)
    found = robust_prune(base, own, candidates)
    return np.where(found >= 0, names[found], -1)


def build_shard(unit: np.ndarray) -> list[np.ndarray]:
    """Adjacency of one shard: pruned neighbours both ways."""
    n, k = len(unit), min(CANDIDATES, len(unit) - 1)
    if not k:
        return [np.zeros(0, int)]
    near = np.empty((n, k), int)
    for i in range(0, n, 512):
        part = unit[i : i + 512] @ unit.T
        part[np.arange(len(part)), np.arange(i, i + len(part))] = -2
        top = np.argpartition(-part, k - 1, axis=1)[:, :k]
        near[i : i + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(part, top, 1), axis=1, kind="stable"), 1)
    chosen = np.concatenate([_prune_slice(unit, near, i) for i in range(0, n, 512)])
    a, b = np.nonzero(chosen >= 0)
    one, two = a, chosen[a, b]
    pairs = np.unique(np.concatenate([one * n + two, two * n + one]))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def search_range(unit: np.ndarray, lists: list[np.ndarray], least: float, asked: np.ndarray, entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list]:
    """Pairs (asked vector, point in range) met by a range-expanding greedy search from the entries; the best points of each with scores."""
    n = len(unit)
    sizes = np.array([len(x) for x in lists])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(lists).astype(int)

    def neighbours(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in v and neighbour, for all neighbours of all of v."""
        at = np.repeat(np.arange(len(v)), sizes[v])
        return at, flat[np.arange(len(at)) - np.repeat(np.cumsum(sizes[v]) - sizes[v], sizes[v]) + starts[v][at]]

    asks, others, best_of = [], [], []
    for low in range(0, len(asked), SEARCHES):
        q = asked[low : low + SEARCHES]
        met = np.zeros((len(q), n), bool)
        rows = np.arange(len(q))
        beam, score, opened = np.zeros((len(q), 0), int), np.zeros((len(q), 0)), np.zeros((len(q), 0), bool)
        inside = []
        first = entries[low : low + SEARCHES]
        r, v = np.repeat(rows, [len(x) for x in first]), np.concatenate(first).astype(int)
        for hop in range(HOPS + 1):
            if hop:
                at = np.where(opened, -9.0, score).argmax(axis=1)
                go = ~opened[rows, at]
                if not go.any():
                    break
                opened[rows[go], at[go]] = True
                r, v = neighbours(beam[rows[go], at[go]])
                r = rows[go][r]
            new = ~met[r, v]
            r, v = r[new], v[new]
            met[r, v] = True
            value = np.einsum("ij,ij->i", q[r], unit[v])
            inside.append((r[value >= least], v[value >= least]))
            counts = np.bincount(r, minlength=len(q))
            column = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            fresh, values = np.zeros((len(q), counts.max(initial=0)), int), np.full((len(q), counts.max(initial=0)), -9.0)
            fresh[r, column], values[r, column] = v, value
            beam, score = np.concatenate([beam, fresh], 1), np.concatenate([score, values], 1)
            opened = np.concatenate([opened, values < -2], 1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
            beam, score, opened = (np.take_along_axis(x, best, 1) for x in (beam, score, opened))
        best_of += [[(float(s), int(v)) for s, v in zip(x, y, strict=True) if s > -2] for x, y in zip(score, beam, strict=True)]
        r, v = (np.concatenate(x) for x in zip(*inside, strict=True))
        while len(r):  # in range: go on through all neighbours of what is in range
            asks.append(low + r)
            others.append(v)
            at, b = neighbours(v)
            pairs = np.unique(r[at] * n + b)
            a, b = pairs // n, pairs % n
            new = ~met[a, b]
            a, b = a[new], b[new]
            met[a, b] = True
            hit = np.einsum("ij,ij->i", q[a], unit[b]) >= least
            r, v = a[hit], b[hit]
    empty = [np.zeros(0, int)]
    return np.concatenate(asks or empty), np.concatenate(others or empty), best_of


VISIT = "cell string, q bigint, entries array<bigint>, inside array<bigint>, beam array<struct<score: double, id: bigint, homes: array<string>>>, moves array<struct<cell: string, ids: array<bigint>>>"


def visit_cells(laid: DataFrame, least: float) -> DataFrame:
    """One row for each search in a cell: what is in range, the best points, and the other cells of what is in range.

    ``laid`` has ``cell, part, asks, id, vector, near, homes``: the points of a cell, then the vectors that ask there with the
    points they enter by (none: the medoid). A point that asks in its own cell enters by itself and the medoid.
    """

    def answer(cell, names, raw, unit, lists, homes, place, asks):
        medoid = int(np.argmax(unit @ unit.mean(axis=0)))
        asked = _unit([r[4] for r in asks])
        entries = [np.unique([medoid, place[r[3]]]) if r[5] is None else np.array([place[x] for x in r[5]] or [medoid], int) for r in asks]
        a, b, best = search_range(unit, lists, least - 1e-9, asked, entries)
        own = np.array([r[3] for r in asks])
        keep = names[b] != own[a]
        a, b = a[keep], b[keep]
        keep = np.zeros(len(a), bool)
        given = [np.frombuffer(r[4], np.float64) for r in asks]
        for i in range(0, len(a), 4096):
            x, y = np.stack([given[j] for j in a[i : i + 4096]]), np.stack([raw[j] for j in b[i : i + 4096]])
            keep[i : i + 4096] = cosines(x, y) >= least
        inside: list[list] = [[] for _ in asks]
        moves: list[dict] = [{} for _ in asks]
        for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            inside[i].append(int(names[j]))
            for home in homes[j]:
                moves[i].setdefault(home, []).append(int(names[j]))
        rows = [
            {
                "cell": cell, "q": r[3], "entries": r[5] or [], "inside": inside[i],
                "beam": [{"score": round(s, 9), "id": int(names[v]), "homes": homes[v]} for s, v in best[i]],
                "moves": [{"cell": c, "ids": ids} for c, ids in moves[i].items()],
            }
            for i, r in enumerate(asks)
        ]
        return pa.RecordBatch.from_pylist(rows, VISIT_ARROW)

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (cell, _), group in groupby(rows, key=lambda r: r[:2]):
            points, asks, shard = [], [], None
            for r in group:
                if r[2] != 1:
                    points.append(r)
                if r[2] == 0:
                    continue
                asks.append(r if r[2] == 1 else (*r[:5], None))
                if r[2] == 1 and len(asks) == 512:
                    shard = shard or _shard(cell, points)
                    yield answer(cell, *shard, asks)
                    asks = []
            shard = shard or _shard(cell, points)
            for i in range(0, len(asks), 512):
                yield answer(cell, *shard, asks[i : i + 512])

    return laid.select("cell", "part", "asks", "id", "vector", "near", "homes").mapInArrow(run, VISIT)


VISIT_ARROW = pa.schema([
    ("cell", pa.string()), ("q", pa.int64()), ("entries", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64())),
    ("beam", pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64()), ("homes", pa.list_(pa.string()))]))),
    ("moves", pa.list_(pa.struct([("cell", pa.string()), ("ids", pa.list_(pa.int64()))]))),
])


def _shard(cell, points):
    names, unit = np.array([r[3] for r in points]), _unit([r[4] for r in points])
    raw = [np.frombuffer(r[4], np.float64) for r in points]
    place = {name: i for i, name in enumerate(names.tolist())}
    lists = [np.array([place[x] for x in r[5] if x in place], int) for r in points]
    homes = [[h for h in r[6] if h != cell] for r in points]
    return names, raw, unit, lists, homes, place


def next_visits(state: DataFrame, last: DataFrame, least: float) -> DataFrame:
    """``q, cell, entries``: where searches go on in other cells.

    A point in range is entered in each of its cells where it was not met. Of all points that a vector met, the ``BEAM``
    best, if within twice the angle of ``least``, are entered in each of their cells that the vector has not asked yet.
    """
    far = 2 * least * least - 1 - 1e-6 if least > 0 else -1.0
    done = state.groupBy("q", "cell").agg(F.flatten(F.collect_list(F.concat("inside", "entries"))).alias("done"))
    moves = last.select("q", F.explode("moves").alias("m")).select("q", "m.cell", F.col("m.ids").alias("ids"))
    inside = moves.groupBy("q", "cell").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).join(done, ["q", "cell"], "left")
    ranged = inside.select("q", "cell", F.array_except("ids", F.coalesce("done", F.array().cast("array<bigint>"))).alias("entries")).filter("size(entries) > 0")
    mine = state.join(last.select("q").distinct(), "q", "left_semi").groupBy("q")
    best = mine.agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("beam"))), False), 1, BEAM).alias("beam"))
    # The cell that met a point is left out of its homes; the vector has asked there.
    near = best.select("q", F.explode("beam").alias("b")).filter(F.col("b.score") >= far).select("q", "b.id", F.explode("b.homes").alias("cell"))
    greedy = near.join(state.select("q", "cell").distinct(), ["q", "cell"], "left_anti").groupBy("q", "cell").agg(F.collect_set("id").alias("entries"))
    return ranged.unionByName(greedy).groupBy("q", "cell").agg(F.array_distinct(F.flatten(F.collect_list("entries"))).alias("entries"))


def link_pairs(points: DataFrame, overlap: int, least: float = LEAST_COSINE) -> DataFrame:
    """``a, b`` (a < b): linked points of one label, found by the graph and verified."""
    dealt = durable(placed(points, overlap).repartition("cell").sortWithinPartitions("cell", "id"), "shards")
    cells = dealt.filter("member").drop("member")
    probes = dealt.filter("not member").select(F.col("id").alias("q"), "cell", F.array().cast("array<bigint>").alias("entries"))

    def build(batches):
        for cell, rows in _by_cell(batches):
            names = np.array([r[1] for r in rows])
            lists = [names[x].tolist() for x in build_shard(_unit([r[2] for r in rows]))]
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(rows)), pa.array(names), pa.array(lists, pa.list_(pa.int64()))], ["cell", "id", "near"])

    laid = cells.repartition("cell").sortWithinPartitions("cell", "id")
    lists = laid.mapInArrow(build, "cell string, id bigint, near array<bigint>")
    # At most overlap x levels lists of bounded length come together for a point.
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_set("cell").alias("homes"))
    members = durable(cells.join(united, "id").select("cell", "id", "vector", "near", "homes"), "members")
    order = ["cell", "part", "asks", "id"]
    own = members.withColumn("part", F.lit(0)).withColumn("asks", F.lit(2))
    last = durable(visit_cells(own.repartition("cell").sortWithinPartitions(*order), least), "visits")
    state = last
    first = True
    while True:
        moves = next_visits(state, last, least)
        if first:  # a cell that is entered by points too needs no other entry
            moves = moves.unionByName(probes.join(moves, ["q", "cell"], "left_anti"))
        visits, first = durable(moves, "moves"), False
        # A cell that many ask is searched in several tasks of bounded size.
        parts = visits.groupBy("cell").agg(F.expr(f"cast((count(*) + {CELL - 1}) div {CELL} as int)").alias("parts"))
        if visits.isEmpty():
            break
        base = members.join(parts, "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("asks", F.lit(0)).drop("parts")
        parted = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
        asking = parted.join(points.select(F.col("id").alias("q"), "vector"), "q").select(
            "cell", F.col("q").alias("id"), "vector", F.col("entries").alias("near"), F.lit(None).cast("array<string>").alias("homes"), "part", F.lit(1).alias("asks")
        )
        last = durable(visit_cells(base.unionByName(asking).repartition("cell", "part").sortWithinPartitions(*order), least), "visits")
        state = state.unionByName(last)
    met = state.select("q", F.explode("inside").alias("v"))
    return durable(met.select(F.least("q", "v").alias("a"), F.greatest("q", "v").alias("b")).distinct(), "links")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def recall(points: DataFrame, pairs: DataFrame, least: float = LEAST_COSINE, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of ``rows`` sampled points, by brute force over all points, that ``pairs`` has.

    The sample does not look at ``pairs``. The lesser of the mean over the sampled points with links and the share of all
    their links counts, so neither small nor large groups hide the other.
    """
    label = F.concat_ws("/", "label", F.length("vector").cast("string"))
    sample = points.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(rows).select(label.alias("l"), "id", "vector").distinct().collect()
    if not sample:
        return 1.0
    asked = {}
    for r in sample:
        asked.setdefault(r["l"], []).append((r["id"], r["vector"]))
    asked = {k: (np.array([i for i, _ in v]), _unit([x for _, x in v])) for k, v in asked.items()}

    def run(batches):
        counts = {k: np.zeros(len(names), np.int64) for k, (names, _) in asked.items()}
        for batch in batches:
            by: dict = {}
            for label, key, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if label in asked:
                    by.setdefault(label, []).append((key, vector))
            for label, met in by.items():
                names, unit = asked[label]
                for i in range(0, len(met), 512):
                    part = met[i : i + 512]
                    near = unit @ _unit([x for _, x in part]).T >= least + 1e-12
                    near &= names[:, None] != np.array([k for k, _ in part])[None]
                    counts[label] += near.sum(axis=1)
        names, n = (np.concatenate(x) for x in zip(*((asked[k][0], c) for k, c in counts.items()), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(names[n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], ["id", "n"])

    # All pairs are verified, so counts by point tell how many are missing without a row for each true link.
    truth = points.select(label.alias("l"), "id", "vector").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).join(F.broadcast(truth.select("id")), "id", "left_semi")
    met = truth.join(ends.groupBy("id").agg(F.count("*").alias("m")), "id", "left").withColumn("m", F.least(F.coalesce("m", F.lit(0)), "n"))
    counts = met.agg(F.avg(F.col("m") / F.col("n")).alias("points"), (F.sum("m") / F.sum("n")).alias("links")).first()
    return 1.0 if counts["links"] is None else min(counts["points"], counts["links"])


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    rows = durable(_valid(embeddings).distinct(), "vectors")
    points = durable(rows.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies")), "points")
    for overlap in OVERLAPS:
        pairs = link_pairs(points, overlap, least)
        share = recall(points, pairs, least)
        if share >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"only {share:.3f} of the sampled links were found")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = both.join(points.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    group = connected_components(pairs, ["a", "b"]).select(F.col("customer_id").alias("id"), "component_id")
    known = points.join(weight.withColumnRenamed("a", "id"), "id", "left").join(group, "id", "left").select(
        "label", "vector", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    linked = rows.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    found = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct().join(
        linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vec_id", "left"
    )
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
