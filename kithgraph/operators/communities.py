"""Weighted modularity communities inside large components (Blondel et al., 2008), as joins, with moves that add up.

All nodes judge the same snapshot of the communities at once. Moves made together disturb each other only through the pairs of
nodes that share a community before or after. Two rules keep the sum of their gains below the gain of the whole round:

* A community either gives or takes in a round, as its best move says. So no move counts on a member that leaves.
* Moves with a common source or a common target are ranked; each must gain more than what the movers ranked before it can
  cost it, which is the product of their strengths (links between movers only add to the gain).

The best move of a component always meets both rules. So modularity rises in every round in which anything can move, nothing
is ever taken back, and the loop ends by itself, with no cap on rounds.

All sums are whole numbers: a gain is multiplied by half the square of the component's total strength, so results do not
depend on the order of addition. They need total strength times strength of a node below 2^63.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable
from .components import connected_components
from .edges import ENDS
from .ordered import with_rank

# Movers of one source or target that a round looks at, best first; the others may move in the next round. It bounds the rows
# that meet in one task.
MOVERS = 1000


def best_moves(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``node, now, to, gain, strength`` of every node that gains by moving; ties go to the smaller community.

    ``nodes``: ``node, community, component_id, strength, total``; ``adjacency``: ``node, other, weight``, both directions.
    """
    placed = nodes.select("node", "community")
    near = (
        adjacency.join(placed.withColumnRenamed("node", "other"), "other").select("node", "community", "weight")
        .unionByName(placed.withColumn("weight", F.lit(0).cast("bigint")))
        .groupBy("node", "community").agg(F.sum("weight").alias("inside"))
    )
    mass = nodes.groupBy("community").agg(F.sum("strength").alias("mass"))
    own = F.col("community") == F.col("now")
    others_mass = F.col("mass") - F.when(own, F.col("strength")).otherwise(0)
    worth = F.col("total") * F.col("inside") - F.col("strength") * others_mass
    judged = near.join(mass, "community").join(nodes.withColumnRenamed("community", "now"), "node").groupBy("node", "now", "strength").agg(
        F.max(F.when(own, worth)).alias("stay"), F.min(F.when(~own, F.struct((-worth).alias("loss"), "community"))).alias("best")
    )
    gain = -F.col("best.loss") - F.col("stay")
    return judged.select("node", "now", F.col("best.community").alias("to"), gain.alias("gain"), "strength").filter("gain > 0")


def joint_moves(moves: DataFrame, movers: int = MOVERS) -> DataFrame:
    """The moves of one round that are made together (``node, to``)."""
    place = F.struct((-F.col("gain")).alias("loss"), "to", "node")
    ranked = moves.withColumn("place", place)
    ends = F.explode(F.array(
        F.struct(F.col("now").alias("community"), F.lit(False).alias("takes")), F.struct(F.col("to").alias("community"), F.lit(True).alias("takes"))
    )).alias("e")
    roles = ranked.select("place", ends).groupBy("e.community").agg(F.min(F.struct("place", "e.takes"))["takes"].alias("takes"))
    gives = roles.filter("not takes").select(F.col("community").alias("now"))
    takes = roles.filter("takes").select(F.col("community").alias("to"))
    able = ranked.join(gives, "now", "left_semi").join(takes, "to", "left_semi")
    for end in ("now", "to"):
        order = Window.partitionBy(end).orderBy("place")
        able = able.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= movers).drop("_n")
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        able = able.withColumn(f"before_{end}", F.coalesce(F.sum("strength").over(earlier), F.lit(0)))
    return able.filter(F.col("gain") > F.col("strength") * (F.col("before_now") + F.col("before_to"))).select("node", "to")


def local_moves(nodes: DataFrame, adjacency: DataFrame) -> tuple[DataFrame, int]:
    """Move nodes until no single move gains; the nodes, and the rounds that moved any."""
    rounds = 0
    while True:
        chosen = joint_moves(best_moves(nodes, adjacency))
        moved = durable(
            nodes.join(chosen, "node", "left").select(
                "node", F.coalesce("to", "community").alias("community"), "component_id", "strength", "total", F.col("to").isNotNull().alias("moved")
            ),
            "moves",
        )
        if moved.filter("moved").isEmpty():
            return nodes, rounds
        nodes, rounds = moved.drop("moved"), rounds + 1


def _adjacency(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(
        F.struct(F.col(ENDS[0]).alias("node"), F.col(ENDS[1]).alias("other")),
        F.struct(F.col(ENDS[1]).alias("node"), F.col(ENDS[0]).alias("other")),
    )).alias("e")
    return edges.select(ends, F.col("shared_attribute_count").cast("bigint").alias("weight")).select("e.node", "e.other", "weight")


def _merged(nodes: DataFrame) -> DataFrame:
    """Each community as one node of its own."""
    return nodes.groupBy(F.col("community").alias("node")).agg(
        F.first("component_id").alias("component_id"), F.sum("strength").alias("strength"), F.first("total").alias("total")
    ).select("node", F.col("node").alias("community"), "component_id", "strength", "total")


def _between(adjacency: DataFrame, step: DataFrame) -> DataFrame:
    """Links between communities, summed."""
    return (
        adjacency.join(step.withColumnRenamed("community", "a"), "node")
        .join(step.select(F.col("node").alias("other"), F.col("community").alias("b")), "other")
        .filter("a <> b")
        .groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("weight").alias("weight"))
    )


def _connected_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, part``: communities cut into their connected parts, which never lowers modularity."""
    a = nodes.select(F.col("node").alias(ENDS[0]), F.col("community").alias("a"))
    b = nodes.select(F.col("node").alias(ENDS[1]), F.col("community").alias("b"))
    inner = edges.select(*ENDS).join(a, ENDS[0]).join(b, ENDS[1]).filter("a = b")
    parts = connected_components(inner).withColumnRenamed("component_id", "part").withColumnRenamed("customer_id", "node")
    return nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part"))


def _with_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbers of customers and communities turned back into ids; a community is named by a member."""
    node = ids.select(F.col("nr").alias("node"), F.col("id").alias("_node"))
    community = ids.select(F.col("nr").alias("community"), F.col("id").alias("_community"))
    return nodes.join(node, "node").join(community, "community").select(
        F.col("_node").alias("node"), F.col("_community").alias("community"), "component_id", "strength", "total"
    )


def modularity_partition(edges: DataFrame, component: DataFrame) -> tuple[DataFrame, int]:
    """``node, community, component_id, strength, total`` of every linked customer, and the rounds it took.

    Levels of ever larger communities first; then single customers move again until none gains, and communities that fell
    apart on the way are cut, until both hold: every community is connected and no customer gains by moving. The rounds see
    customers as numbers in the order of their ids, so ties go as they go among ids.
    """
    ids = durable(with_rank(edges.select(F.explode(F.array(*ENDS)).alias("id")).filter("id is not null").distinct(), [F.asc("id")], "nr"), "ids")
    known = edges.select(*ENDS, "shared_attribute_count")
    for end in ENDS:
        known = known.join(ids.select(F.col("id").alias(end), F.col("nr").alias(f"_{end}")), end)
    edges = durable(known.select(*[F.col(f"_{end}").alias(end) for end in ENDS], "shared_attribute_count"), "numbered")
    adjacency = durable(_adjacency(edges), "adjacency")
    strength = adjacency.groupBy(F.col("node").alias("nr")).agg(F.sum("weight").alias("strength"))
    owned = component.join(ids.withColumnRenamed("id", "customer_id"), "customer_id").select(F.col("nr"), "component_id")
    placed = strength.join(owned, "nr").withColumnRenamed("nr", "customer_id")
    total = placed.groupBy("component_id").agg(F.sum("strength").alias("total"))
    first = durable(
        placed.join(total, "component_id").select(
            F.col("customer_id").alias("node"), F.col("customer_id").alias("community"), "component_id", "strength", "total"
        ),
        "nodes",
    )
    nodes, links, member, rounds = first, adjacency, None, 0
    while True:
        nodes, made = local_moves(nodes, links)
        rounds += made
        if not made and member is not None:
            break
        step = nodes.select("node", "community")
        member = step if member is None else durable(member.withColumnRenamed("community", "_at").join(
            step.select(F.col("node").alias("_at"), "community"), "_at"
        ).select("node", "community"), "membership")
        if not made:
            break
        links = durable(_between(links, step), "adjacency")
        nodes = durable(_merged(nodes), "nodes")
    nodes = first.drop("community").join(member, "node").select("node", "community", "component_id", "strength", "total")
    while True:
        nodes, made = local_moves(durable(nodes, "nodes"), adjacency)
        rounds += made
        parts = durable(_connected_parts(nodes, edges), "parts")
        named = nodes.join(parts, "node").select("node", F.col("part").alias("community"), "component_id", "strength", "total")
        kept, cut = nodes.select("community").distinct().count(), parts.select("part").distinct().count()
        if kept == cut:
            return _with_ids(named, ids), rounds
        nodes = named


def communities(edges: DataFrame, component: DataFrame) -> DataFrame:
    """``customer_id, community_id`` for the customers of ``component`` (``customer_id, component_id``).

    ``edges`` must lie inside these components; weights are ``shared_attribute_count``. A community is connected, is named by
    its smallest member, and has at least two members; a customer alone in a community is in none.
    """
    nodes = modularity_partition(edges, component)[0]
    shared = nodes.groupBy("community").agg(F.count("*").alias("n")).filter("n >= 2").select("community")
    return nodes.join(shared, "community", "left_semi").select(F.col("node").alias("customer_id"), F.col("community").alias("community_id"))
