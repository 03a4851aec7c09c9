"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on dense numbers.

Ids that are no numbers are numbered once, in their order, by ranges and prefix counts. The rounds then see 64-bit numbers
only, so minima are aggregated by hash, and the number of a component is turned back into its smallest id at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .edges import ENDS
from .ordered import with_rank


def _large_star(stars: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)."""
    near = stars.select(F.explode(F.array(
        F.struct(F.col("hi").alias("node"), F.col("lo").alias("near")),
        F.struct(F.col("lo").alias("node"), F.col("lo").alias("near")),
    )).alias("p")).groupBy("p.node").agg(F.min("p.near").alias("least"))
    # The right side has one row per node, so a node with very many neighbours is split by the skew join.
    # Repeats may stay: there are never more rows than edges, and the small star drops them.
    return stars.join(near.withColumnRenamed("node", "lo"), "lo").select("hi", F.col("least").alias("lo"))


def _small_star(stars: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, move to the smallest of them."""
    least = stars.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = stars.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    own = least.select("hi", F.col("least").alias("lo"))
    return moved.filter("hi > lo").unionByName(own).distinct()


def _finished(stars: DataFrame) -> bool:
    """Whether every node hangs on one centre and no centre hangs on another."""
    role = F.explode(F.array(
        F.struct(F.col("hi").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
        F.struct(F.col("lo").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")),
    )).alias("r")
    roles = stars.select(role).groupBy("r.node").agg(F.sum("r.leaf").alias("leaf"), F.max("r.centre").alias("centre"))
    return roles.filter("leaf + centre > 1").isEmpty()


def star_components(pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """``hi, lo``: every node but the smallest of each component (pairs ``hi > lo`` of numbers) with the smallest.

    The rounds needed grow with the logarithm of the longest path. Each round is written to the shared folder, so the plan
    stays one round long and survives lost executors.
    """
    stars = durable(_small_star(_large_star(pairs)), "stars", rows)
    while not _finished(stars):
        stars = durable(_small_star(_large_star(stars)), "stars", rows)
    return stars


def connected_components(edges: DataFrame, ends: list[str] = ENDS, rows: int | None = None) -> DataFrame:
    """``customer_id, component_id`` for every linked customer; the id is the smallest member.

    ``rows``: about how many customers there are, if known; the tables of the rounds then get files in proportion.
    """
    a, b = F.col(ends[0]), F.col(ends[1])
    given = edges.filter(a != b).select(a.alias("a"), b.alias("b"))
    if all(kind == "bigint" for _, kind in given.dtypes):
        stars = star_components(given.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), rows)
        members = stars.select(F.col("hi").alias("customer_id"), F.col("lo").alias("component_id"))
        roots = stars.select(F.col("lo").alias("customer_id"), F.col("lo").alias("component_id")).distinct()
        return members.unionByName(roots)
    ids = durable(with_rank(given.select(F.explode(F.array("a", "b")).alias("id")).distinct(), [F.asc("id")], "nr"), "ids")
    numbered = given.join(ids.select(F.col("id").alias("a"), F.col("nr").alias("x")), "a").join(ids.select(F.col("id").alias("b"), F.col("nr").alias("y")), "b")
    stars = star_components(numbered.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")), rows)
    named = ids.join(stars.withColumnRenamed("hi", "nr"), "nr", "left").select("id", F.coalesce("lo", "nr").alias("lo"))
    return named.join(ids.select(F.col("nr").alias("lo"), F.col("id").alias("least")), "lo").select(
        F.col("id").alias("customer_id"), F.col("least").alias("component_id")
    )


def component_of(customers: DataFrame, edges: DataFrame) -> DataFrame:
    """Component of every customer, the own id where unlinked."""
    found = connected_components(edges)
    return customers.select("customer_id").join(found, "customer_id", "left").select(
        "customer_id", F.coalesce("component_id", "customer_id").alias("component_id")
    )


def ring_or_self() -> Column:
    """Split group of a customer with a known ring, else the customer alone."""
    return F.coalesce(F.nullif(F.col("truth_ring"), F.lit("")), F.col("customer_id"))


def split_groups(customers: DataFrame, edges: DataFrame) -> DataFrame:
    """``customer_id, group_id``: known rings if there are any, else connected components."""
    if customers.filter("truth_ring is not null and truth_ring <> ''").isEmpty():
        return component_of(customers, edges).withColumnRenamed("component_id", "group_id")
    return customers.select("customer_id", ring_or_self().alias("group_id"))
