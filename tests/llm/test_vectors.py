"""Top-k search and near duplicates of embeddings against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kithgraph.llm import neighbours, search
from kithgraph.llm.common import prepare, table

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell string"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def odd(extra=()):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, [-1.0, 0.5, 3.0], 1), (1, None, 1), (2, [], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1),
            (5, [None, 1.0], 1), (6, [0.0, 0.0], 1), (7, [1.0, 2.0], None), (8, [2.0, 4.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (-50, [3.0, 1.0], 2)]
    return [(*r, "x", "y") for r in [*rows, *extra]]


def test_top_k_odd_rows(session):
    rows = session.createDataFrame(odd(), SCHEMA)
    vectors = {i: [int(np.floor(256 * x)) for x in v] for i, v, *_ in odd() if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (0, 50, -50):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, search.top_k(rows).collect())) == sorted(expected)
    assert search.top_k(rows.limit(0)).collect() == []


@given(st.integers(0, 1000), st.integers(1, 6), st.booleans())
@settings(max_examples=40, deadline=None)
def test_pruned_shard_search_is_exact(seed, k, large):
    rng = np.random.default_rng(seed)
    cells = rng.integers(-3, 4, (int(rng.integers(1, 900)), 4)) * (1 << 40 if large else 1)
    queries = cells[: min(5, len(cells))]
    ids = rng.permutation(5 * len(cells))[: len(cells)].astype(np.int64)
    q, found, score = search.search_shard(queries, ids[:5], np.full(len(queries), -(1 << 63), np.int64), ids, cells, k)
    exact = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for y in cells] for x in queries]
    for i in range(len(queries)):
        want = sorted((-s, j) for s, j in zip(exact[i], ids.tolist()) if j != ids[i])[:k]
        assert [(-s, j) for s, j in zip(score[q == i].tolist(), found[q == i].tolist())] == want


def brute_links(rows, least):
    links = set()
    for a, u, g, *_ in rows:
        for b, v, h, *_ in rows:
            if a < b and g == h and len(u) == len(v):
                x, y = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.add((a, b))
    return links


def test_near_duplicates_against_brute_force(session):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(600):
        v = base[i % 60] + rng.normal(size=16) * (0.12 if i % 3 else 0.3)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2, "x", "y"))
    rows += [(1000 + i, rows[0][1], 0, "x", "y") for i in range(30)]
    links = brute_links(rows, 0.93)
    found = {r["vec_id"]: r for r in neighbours.near_duplicates(session.createDataFrame(rows, SCHEMA)).collect()}
    degree = {i: 0 for i in found}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert sum(r["n_links"] for r in found.values()) >= 0.95 * sum(degree.values())
    assert all(found[i]["n_links"] <= degree[i] for i in found)
    assert found[1000]["component_id"] == 0 and not found[1000]["kept"] and found[1000]["n_links"] >= 30


def test_near_duplicates_odd_rows(session):
    found = {r["vec_id"]: r for r in neighbours.near_duplicates(session.createDataFrame(odd(), SCHEMA)).collect()}
    assert found[0]["n_links"] == 2 and found[8]["component_id"] == 0 and found[9]["n_links"] == 2
    for alone in (1, 2, 3, 4, 5, 6, 7, 50, -50):
        assert (found[alone]["n_links"], found[alone]["component_id"], found[alone]["kept"]) == (0, alone, True)
    assert neighbours.near_duplicates(session.createDataFrame([], SCHEMA)).collect() == []


def test_recall_on_given_vectors(session, sf):
    points = neighbours._valid(table(session, sf, "embeddings")).distinct().withColumnRenamed("vec_id", "id")
    assert neighbours.recall(points, neighbours.link_pairs(points, 2, 0.3), 0.3) >= 0.9


def test_search_leaves_its_cell(session, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 40)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(150, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 150] + rng.normal(size=8) * 0.2], 0, "x", "y") for i in range(900)]
    points = neighbours._valid(session.createDataFrame(rows, SCHEMA)).withColumnRenamed("vec_id", "id")
    at = {}
    for r in neighbours.shards_of(points, 2).collect():
        at.setdefault(r["id"], set()).add(r["cell"])
    links = brute_links(rows, 0.93)
    apart = {(a, b) for a, b in links if not at[a] & at[b]}
    found = {tuple(r) for r in neighbours.link_pairs(points, 2).collect()}
    assert found <= links and apart
    assert len(found & apart) >= 0.95 * len(apart) and len(found) >= 0.95 * len(links)


def test_audit_sees_missing_isolated_pairs(session):
    rng = np.random.default_rng(4)
    group = np.ones(16) + rng.normal(size=(120, 16)) * 0.01
    pairs = np.repeat(rng.normal(size=(200, 16)), 2, axis=0) + rng.normal(size=(400, 16)) * 0.01
    rows = [(i, [float(np.float32(x)) for x in v], 0, "x", "y") for i, v in enumerate([*group, *pairs])]
    points = neighbours._valid(session.createDataFrame(rows, SCHEMA)).withColumnRenamed("vec_id", "id")
    links = brute_links(rows, 0.93)
    whole = neighbours.recall(points, session.createDataFrame(sorted(links), "a long, b long"))
    # All links of the large group and one isolated pair of ten.
    some = [(a, b) for a, b in sorted(links) if b < 120 or a % 20 == 0]
    assert whole == 1.0 and len(some) > 0.95 * len(links)
    assert neighbours.recall(points, session.createDataFrame(some, "a long, b long")) < 0.5


def test_far_points_are_not_followed_and_next_shards_are_visited(session, monkeypatch):
    beam = [(0.95, 2, ["c"]), (0.8, 3, ["d", "a"]), (0.5, 4, ["b"])]
    state = session.createDataFrame([("a", 1, [], [2], beam, [("c", [2])])], neighbours.VISIT)
    assert {(r["q"], r["cell"]): r["entries"] for r in neighbours.next_visits(state, state, 0.93).collect()} == {(1, "c"): [2], (1, "d"): [3]}
    monkeypatch.setattr(neighbours, "CELL", 60)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    both = np.concatenate([base, 0.95 * base + np.sqrt(1 - 0.95**2) * side])
    rows = [(i, [float(np.float32(x)) for x in v], 0, "x", "y") for i, v in enumerate(both)]
    points = neighbours._valid(session.createDataFrame(rows, SCHEMA)).withColumnRenamed("vec_id", "id")
    laid = [tuple(r) for r in neighbours.placed(points, 2).select("cell", "id", "member").collect()]
    assert len(laid) == len({r[:2] for r in laid}) and {r[1] for r in laid if not r[2]} == set(range(300))
    links = brute_links(rows, 0.93)
    found = {tuple(r) for r in neighbours.link_pairs(points, 2).collect()}
    assert found <= links and len(found) >= 0.97 * len(links) and len(links) >= 150
