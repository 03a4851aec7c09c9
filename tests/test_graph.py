"""Edges, components, communities, rings and neighbourhoods against small brute-force answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import communities as CM, components as C, edges as E, features as FT, neighbourhood as N, rings as R

SCHEMA = "customer_id string, attribute_type string, attribute_id string, attribute_value string"


def links(spark, rows):
    return spark.createDataFrame([(c, t, f"{t}:{x}", x.upper()) for c, t, x in rows], SCHEMA)


def edge_frame(spark, pairs, weight=1):
    return spark.createDataFrame([(min(a, b), max(a, b), weight) for a, b in pairs], "source_customer_id string, target_customer_id string, shared_attribute_count int")


def brute_edges(rows, cap):
    holders, found = {}, {}
    for c, t, x in set(rows):
        holders.setdefault((t, x), set()).add(c)
    for (t, _), who in holders.items():
        if len(who) <= cap:
            for pair in itertools.combinations(sorted(who), 2):
                found.setdefault(pair, set()).add(t)
    return found


@pytest.mark.parametrize("cap", [2, 5, 50])
def test_edges_match_brute_force(spark, cap):
    draw = random.Random(cap)
    rows = [(f"c{draw.randrange(60):03d}", draw.choice(["phone", "email", "ip"]), f"v{draw.randrange(40)}") for _ in range(300)]
    rows += [(f"c{i:03d}", "ip", "office") for i in range(60)]  # one value held by every customer
    types = E.edge_types(links(spark, rows))
    assert types == ["phone", "email", "address", "device", "ip"]
    got = {
        (r[0], r[1]): {t for t in types if r[f"shared_{t}"]} for r in E.identity_edges(links(spark, rows), types, cap).collect()
    }
    assert got == brute_edges(rows, cap)


def test_stars_connect_what_pairs_connect(spark):
    draw = random.Random(9)
    rows = [(f"c{draw.randrange(90):03d}", "phone", f"v{draw.randrange(60)}") for _ in range(150)]
    groups = E.linking_groups(links(spark, rows), 20)
    stars, edges = E.stars_from_groups(groups), E.edges_from_groups(groups, ["phone"])
    found = [{r[0]: r[1] for r in C.connected_components(x).collect()} for x in (stars, edges)]
    assert found[0] == found[1] and stars.count() <= edges.count()


def test_two_values_of_one_type_count_once(spark):
    rows = [(c, "phone", x) for c in "ab" for x in ("1", "2")]
    edge = E.identity_edges(links(spark, rows), ["phone"]).first()
    assert edge["shared_phone"] == 1 and edge["shared_attribute_count"] == 1


def brute_components(pairs):
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_of_paths_stars_and_random_graphs(spark):
    draw = random.Random(3)
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(70)]
    star = [("s000", f"s{i:03d}") for i in range(1, 60)]
    inverse = [("z999", f"w{i:03d}") for i in range(40)]
    loose = [(f"r{draw.randrange(80):03d}", f"r{draw.randrange(80):03d}") for _ in range(60)]
    pairs = [p for p in path + star + inverse + loose if p[0] != p[1]]
    got = {r[0]: r[1] for r in C.connected_components(edge_frame(spark, pairs)).collect()}
    assert got == brute_components(pairs)


def cliques(sizes):
    out = []
    for k, size in enumerate(sizes):
        members = [f"k{k}_{i:02d}" for i in range(size)]
        out += list(itertools.combinations(members, 2))
    return out


def test_bridged_cliques_split_in_two(spark):
    pairs = cliques([20, 20]) + [("k0_00", "k1_00")]
    edges = edge_frame(spark, pairs)
    groups = R.candidate_groups(edges, max_size=30)
    found = {frozenset(r[0]) for r in groups.groupBy("group_id").agg(F.collect_list("customer_id")).select("collect_list(customer_id)").collect()}
    assert found == {frozenset(f"k{k}_{i:02d}" for i in range(20)) for k in (0, 1)}


def test_communities_refine_components_and_repeat_under_other_partitioning(spark):
    draw = random.Random(5)
    blocks = [[f"b{k}_{i:02d}" for i in range(15)] for k in range(4)]
    pairs = {tuple(sorted(draw.sample(b, 2))) for b in blocks for _ in range(70)}
    pairs |= {tuple(sorted((draw.choice(blocks[k]), draw.choice(blocks[(k + 1) % 4])))) for k in range(4)}
    edges = edge_frame(spark, sorted(pairs))
    component = C.connected_components(edges)
    first = {r[0]: r[1] for r in CM.communities(edges, component).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        second = {r[0]: r[1] for r in CM.communities(edges.repartition(5), component).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert first == second
    inside = [p for p in pairs if first.get(p[0]) == first.get(p[1]) and p[0] in first]
    assert brute_components(inside) == first  # connected, named by the smallest member
    assert 2 <= len(set(first.values())) < len(first)


def modularity(pairs, community):
    """Twice the squared number of links times the modularity, as a whole number; all weights are one."""
    strength = {}
    for a, b in pairs:
        strength[a] = strength.get(a, 0) + 1
        strength[b] = strength.get(b, 0) + 1
    mass = {}
    for node, k in strength.items():
        mass[community[node]] = mass.get(community[node], 0) + k
    inside = sum(community[a] == community[b] for a, b in pairs)
    return 2 * len(pairs) * 2 * inside - sum(m * m for m in mass.values())


def level_zero(spark, pairs):
    adjacency = CM._adjacency(edge_frame(spark, pairs))
    strength = adjacency.groupBy("node").agg(F.sum("weight").alias("strength"))
    nodes = strength.select("node", F.col("node").alias("community"), F.lit("c").alias("component_id"), "strength", F.lit(2 * len(pairs)).cast("bigint").alias("total"))
    return nodes.cache(), adjacency.cache()


@pytest.mark.parametrize("movers", [1, 3, 1000])
def test_moves_made_together_gain_in_every_round(spark, movers):
    """Random graphs with a hub: each round gains, a giver never takes, and the loop ends where no move gains."""
    draw = random.Random(movers)
    pairs = {tuple(sorted(draw.sample([f"n{i:02d}" for i in range(60)], 2))) for _ in range(110)} | {("a", f"n{i:02d}") for i in range(60)}
    pairs = sorted(pairs)
    nodes, adjacency = level_zero(spark, pairs)
    place = {r["node"]: r["community"] for r in nodes.collect()}
    for _ in range(200):
        moves = CM.best_moves(nodes, adjacency).cache()
        chosen = {r["node"]: r["to"] for r in CM.joint_moves(moves, movers).collect()}
        if not chosen:
            break
        assert not {place[n] for n in chosen} & set(chosen.values())
        best = max(moves.collect(), key=lambda r: (r["gain"],))["gain"]
        moved = {**place, **chosen}
        assert modularity(pairs, moved) - modularity(pairs, place) > 0 and best > 0
        place = moved
        table = spark.createDataFrame(list(place.items()), "node string, to string")
        nodes = nodes.drop("community").join(table.withColumnRenamed("to", "community"), "node").select("node", "community", "component_id", "strength", "total").cache()
    assert not chosen
    for node in place:
        for other in set(place.values()) - {place[node]}:
            assert modularity(pairs, {**place, node: other}) <= modularity(pairs, place)


def test_one_large_component_ends_in_few_rounds(spark):
    """2,000 accounts in one component, with dense blocks, a chain through all, and a hub."""
    draw = random.Random(11)
    names = [f"x{i:04d}" for i in range(2000)]
    pairs = set(zip(names, names[1:]))
    for k in range(0, 2000, 20):
        pairs |= {tuple(sorted(draw.sample(names[k : k + 20], 2))) for _ in range(40)}
    pairs |= {(names[0], x) for x in names[1::7]}
    edges = edge_frame(spark, sorted(pairs))
    component = spark.createDataFrame([(n, names[0]) for n in names], "customer_id string, component_id string")
    nodes, rounds = CM.modularity_partition(edges, component)
    place = {r["node"]: r["community"] for r in nodes.collect()}
    assert len(place) == 2000 and rounds <= 40
    inside = [p for p in pairs if place[p[0]] == place[p[1]]]
    joined = {n: c for n, c in brute_components(inside).items()}
    assert all(place[n] == joined.get(n, n) for n in names)
    # 100 blocks of 20: the planted partition is a bar that a sensible result passes.
    assert modularity(pairs, place) > 0.9 * modularity(pairs, {n: int(n[1:]) // 20 for n in names})


def test_ring_numbers_and_summary(spark):
    rows = [(c, "phone", "1") for c in "abc"] + [(c, "email", "m") for c in "ab"] + [(c, "phone", "2") for c in "xy"] + [(c, "ip", "w") for c in "abcxyq"]
    ls = links(spark, rows)
    edges = E.identity_edges(ls, ["phone", "email", "address", "device", "ip"], cap=3)
    membership = R.number_rings(R.candidate_groups(edges))
    customers = spark.createDataFrame(
        [("a", 1, "t1", "2024-01-01"), ("b", 1, "t1", "2024-01-31"), ("c", 0, None, None), ("x", None, "t2", None), ("y", None, "t2", "2024-01-01"), ("q", 0, None, None)],
        "customer_id string, label int, truth_ring string, open_date string",
    ).withColumn("open_date", F.col("open_date").cast("date"))
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.1), ("x", 0.2), ("y", 0.3), ("q", 0.0)], "customer_id string, risk double")
    rings = {r["ring_id"]: r for r in R.summarise_rings(membership, edges, ls, customers, scores, 0.7).collect()}
    one, two = rings["R-0001"], rings["R-0002"]
    assert (one["size"], one["n_edges"], one["density"], one["n_high"], one["suspected"], one["open_span_days"]) == (3, 3, 1.0, 2, True, 30)
    assert [(t["type"], t["edges"]) for t in one["shared_types"]] == [("phone", 3), ("email", 1)]
    assert [(e["value"], e["members"]) for e in one["evidence"]] == [("W", 3), ("1", 3), ("M", 2)]
    assert (one["dominant_truth_ring"], one["dominant_count"], one["n_fraud"]) == ("t1", 2, 2)
    assert (two["size"], two["suspected"], two["open_span_days"]) == (2, False, None)
    order = [r["customer_id"] for r in R.members_in_order(membership, scores).filter("ring_id = 'R-0001'").orderBy("position").collect()]
    assert order == ["a", "b", "c"]


def test_ego_network_is_nearest_first_and_bounded(spark):
    pairs = [("m", f"n{i:02d}") for i in range(20)] + [("n00", "far"), ("far", "farther")]
    edges = edge_frame(spark, pairs)
    nodes, truncated = N.ego_network(edges, "m", hops=2, max_nodes=100)
    assert {r[0]: r[1] for r in nodes.collect()} == {"m": 0, **{f"n{i:02d}": 1 for i in range(20)}, "far": 2} and not truncated
    nodes, truncated = N.ego_network(edges, "m", hops=2, max_nodes=10)
    assert {r[0] for r in nodes.collect()} == {"m", *(f"n{i:02d}" for i in range(9))} and truncated


def test_adjacency_is_symmetric_with_self_loops(spark):
    customers = spark.createDataFrame([(c,) for c in "abcd"], "customer_id string")
    rows = {(r[0], r[1]): r[2] for r in FT.normalised_adjacency(customers, edge_frame(spark, [("a", "b"), ("b", "c")])).collect()}
    assert all(abs(w - rows[(b, a)]) < 1e-12 for (a, b), w in rows.items())
    assert rows[("d", "d")] == 1.0 and abs(rows[("a", "b")] - 1 / 6**0.5) < 1e-12


def test_packing_stops_at_the_first_ring_that_does_not_fit(spark):
    rings = spark.createDataFrame([("R-1", 0.9, 4), ("R-2", 0.8, 9), ("R-3", 0.7, 2)], "ring_id string, score double, size long")
    assert [r["ring_id"] for r in N.packed_rings(rings, 10).collect()] == ["R-1"]


def test_rounds_of_moves_see_numbers_and_results_see_ids(spark, monkeypatch):
    seen = []
    moves = CM.local_moves
    monkeypatch.setattr(CM, "local_moves", lambda nodes, adjacency: seen.append(dict(nodes.dtypes + adjacency.dtypes)) or moves(nodes, adjacency))
    edges = edge_frame(spark, [("b", "c"), ("b", "d"), ("c", "d"), ("d", "w"), ("w", "x"), ("w", "y"), ("x", "y")])
    component = spark.createDataFrame([(n, "b") for n in "bcdwxy"], "customer_id string, component_id string")
    place = {r["node"]: (r["community"], r["component_id"]) for r in CM.modularity_partition(edges, component)[0].collect()}
    assert {x[c] for x in seen for c in ("node", "community", "other")} == {"bigint"}
    assert place == {**dict.fromkeys("bcd", ("b", "b")), **dict.fromkeys("wxy", ("w", "b"))}
