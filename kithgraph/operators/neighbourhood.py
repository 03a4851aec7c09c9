"""Neighbours, ego networks and the network view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import settings
from ..session import durable
from .edges import ENDS, both_directions, induced_subgraph, type_array

BOUNDARY_ROWS = 40


def neighbours(edges: DataFrame, customer_id: str) -> DataFrame:
    """Accounts linked to one account with the shared types; both filters reach the edge scan."""
    a, b = F.col(ENDS[0]), F.col(ENDS[1])
    mine = edges.filter((a == customer_id) | (b == customer_id))
    other = F.when(a == customer_id, b).otherwise(a)
    return mine.select(other.alias("other_id"), type_array(edges).alias("types"), F.col("shared_attribute_count").alias("weight"))


def high_risk_neighbours(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """``customer_id, high_neighbors`` for linked customers, from ``customer_id, level``."""
    far = levels.select(F.col("customer_id").alias("other_id"), (F.col("level") == "high").alias("high"))
    return both_directions(edges.select(*ENDS)).join(far, "other_id").groupBy("customer_id").agg(
        F.count_if("high").alias("high_neighbors")
    )


def ego_network(edges: DataFrame, customer_id: str, hops: int = 2, max_nodes: int = 120) -> tuple[DataFrame, bool]:
    """``customer_id, hop`` of the accounts within ``hops`` links, nearest first, then by id.

    Each hop asks only for the places still free (plus one, to know whether any were left out), so a frontier has at most
    ``max_nodes`` rows however many links an account has. Frontiers are written tables; only their sizes reach the driver.
    """
    spark = edges.sparkSession
    found = spark.createDataFrame([(customer_id, 0)], "customer_id string, hop int")
    both = both_directions(edges.select(*ENDS))
    frontier, free, truncated = found, max_nodes - 1, False
    for hop in range(1, hops + 1):
        near = both.join(frontier.select("customer_id"), "customer_id", "left_semi").select(F.col("other_id").alias("customer_id")).distinct()
        fresh = near.join(found.select("customer_id"), "customer_id", "left_anti")
        # The list is as short as the node limit, so one task numbers it.
        reached = durable(fresh.orderBy("customer_id").limit(free + 1).withColumn("_n", F.expr("row_number() over (order by customer_id)")), "reached")
        n = reached.count()
        truncated = truncated or n > free
        frontier = reached.filter(F.col("_n") <= free).select("customer_id", F.lit(hop).alias("hop"))
        found, free = found.unionByName(frontier), free - min(n, free)
        if not n:
            break
    return found, truncated


def boundary_accounts(membership: DataFrame, edges: DataFrame, ring_id: str, top: int | None = BOUNDARY_ROWS) -> DataFrame:
    """The ``top`` outside accounts (all for None) with the most links into a ring (ties by id)."""
    inside = membership.filter(F.col("ring_id") == ring_id).select("customer_id")
    links = both_directions(edges.select(*ENDS)).join(inside, "customer_id", "left_semi")
    outside = links.join(inside.withColumnRenamed("customer_id", "other_id"), "other_id", "left_anti")
    counted = outside.groupBy(F.col("other_id").alias("customer_id")).agg(F.count("*").alias("links"))
    ordered = counted.orderBy(F.desc("links"), "customer_id")
    return ordered if top is None else ordered.limit(top)


def ring_graph(membership: DataFrame, edges: DataFrame, ring_id: str, top: int | None = BOUNDARY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Members and the ``top`` boundary accounts (all for None) with a member flag, and the edges among them."""
    inside = membership.filter(F.col("ring_id") == ring_id).select("customer_id", F.lit(True).alias("member"))
    outside = boundary_accounts(membership, edges, ring_id, top).select("customer_id", F.lit(False).alias("member"))
    nodes = inside.unionByName(outside)
    return nodes, induced_subgraph(nodes, edges)


def queue_order() -> list[Column]:
    return [F.desc("score"), F.desc("size"), F.asc("ring_id")]


def packed_rings(rings: DataFrame, max_nodes: int = settings.MAX_GRAPH_NODES) -> DataFrame:
    """Rings in queue order up to the first that would exceed ``max_nodes`` accounts.

    A ring has at least two members, so only the first max_nodes / 2 + 1 rings can matter. They are
    taken by top-k, and the running size runs over this short list.
    """
    short = rings.orderBy(*queue_order()).limit(max_nodes // 2 + 1)
    so_far = Window.orderBy(*queue_order()).rowsBetween(Window.unboundedPreceding, 0)
    return short.withColumn("running", F.sum("size").over(so_far)).filter(F.col("running") <= max_nodes)


def network_view(
    rings: DataFrame, membership: DataFrame, edges: DataFrame, suspected_only: bool = True, min_score: float = 0.0,
    status: str | None = None, types: list[str] | None = None, max_nodes: int = settings.MAX_GRAPH_NODES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rings shown, their accounts and the edges among them; ``rings`` carries a status."""
    chosen = rings.filter(F.col("score") >= min_score)
    if suspected_only:
        chosen = chosen.filter("suspected")
    if status:
        chosen = chosen.filter(F.col("status") == status)
    shown = packed_rings(chosen, max_nodes)
    nodes = membership.join(F.broadcast(shown.select("ring_id")), "ring_id", "left_semi").select("customer_id", "ring_id")
    inner = induced_subgraph(nodes, edges).withColumn("types", type_array(edges))
    if types:
        inner = inner.filter(F.arrays_overlap("types", F.array(*[F.lit(t) for t in types])))
        ends = inner.select(F.explode(F.array(*ENDS)).alias("customer_id")).distinct()
        nodes = nodes.join(ends, "customer_id", "left_semi")
    return shown, nodes, inner
