"""Identity graph: accounts that share an identity value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import settings
from ..functions.metadata import InputError
from ..functions.vocabulary import CORE_TYPES

VALUE = ["attribute_type", "attribute_id"]
ENDS = ["source_customer_id", "target_customer_id"]


def value_holders(links: DataFrame) -> DataFrame:
    """Customers per identity value (``links`` is a set of customer and value)."""
    return links.groupBy(*VALUE).agg(F.count("*").alias("customers"))


def link_set(links: DataFrame) -> DataFrame:
    return links.select("customer_id", *VALUE).dropDuplicates()


def linking_groups(links: DataFrame, cap: int = settings.MAX_VALUE_HOLDERS, distinct: bool = True) -> DataFrame:
    """Members of every value held by 2 to ``cap`` customers, as one array of at most ``cap`` ids.

    A value above the cap makes no edges, so ``cap + 1`` holders are enough to know that it is one.
    The row-number filter is pushed below the shuffle: every task sends at most ``cap + 1`` rows per
    value, so a value held by a third of all rows costs no more than any other. Links are read and
    shuffled once.
    """
    spark = links.sparkSession
    if cap + 1 > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        raise InputError("A cap this large needs a higher spark.sql.optimizer.windowGroupLimitThreshold.")
    pairs = link_set(links) if distinct else links.select("customer_id", *VALUE)
    order = Window.partitionBy(*VALUE).orderBy("customer_id")
    few = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap + 1)
    members = F.array_sort(F.collect_list("customer_id"))
    return few.groupBy(*VALUE).agg(members.alias("members")).filter(F.size("members").between(2, cap))


def identity_edges(
    links: DataFrame,
    types: list[str],
    cap: int = settings.MAX_VALUE_HOLDERS,
    distinct: bool = True,
) -> DataFrame:
    """One row per linked pair, smaller id first, a 0/1 flag per type and the number of types shared.

    ``cap`` bounds the pairs of one value to cap*(cap-1)/2 and is part of the definition of an edge.
    """
    return edges_from_groups(linking_groups(links, cap, distinct), types)


def edges_from_groups(groups: DataFrame, types: list[str]) -> DataFrame:
    """Linked pairs of bounded groups (``attribute_type, members``), pre-aggregated before the shuffle."""
    firsts = groups.select(
        "attribute_type", "members", F.posexplode("members").alias("_i", "source_customer_id")
    )
    pairs = firsts.select(
        "attribute_type",
        "source_customer_id",
        F.explode(F.expr("slice(members, _i + 2, size(members))")).alias("target_customer_id"),
    )
    flags = [F.max((F.col("attribute_type") == t).cast("int")).alias(f"shared_{t}") for t in types]
    edges = pairs.groupBy(*ENDS).agg(*flags)
    return edges.withColumn("shared_attribute_count", sum(F.col(f"shared_{t}") for t in types))


def stars_from_groups(groups: DataFrame) -> DataFrame:
    """Each group as links from its smallest member to the others.

    It connects the same accounts as all pairs of the group do, with n - 1 rows instead of n(n-1)/2,
    so components are found from it.
    """
    hub = F.element_at("members", 1)
    return groups.select(hub.alias(ENDS[0]), F.explode(F.expr("slice(members, 2, size(members))")).alias(ENDS[1])).distinct()


def edge_types(links: DataFrame) -> list[str]:
    """Core types first, then the others in name order; one row per type reaches the driver."""
    present = {r[0] for r in links.select("attribute_type").distinct().collect() if r[0]}
    return CORE_TYPES + sorted(present.difference(CORE_TYPES))


def flag_columns(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c.startswith("shared_") and c != "shared_attribute_count"]


def type_array(edges: DataFrame):
    """Shared types of an edge as an array."""
    return F.array_compact(
        F.array(*[F.when(F.col(f) > 0, F.lit(f[len("shared_"):])) for f in flag_columns(edges)])
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """Each undirected edge seen from either end."""
    rest = [c for c in edges.columns if c not in ENDS]
    forward = edges.select(F.col(ENDS[0]).alias("customer_id"), F.col(ENDS[1]).alias("other_id"), *rest)
    back = edges.select(F.col(ENDS[1]).alias("customer_id"), F.col(ENDS[0]).alias("other_id"), *rest)
    return forward.unionByName(back)


def network_features(edges: DataFrame) -> DataFrame:
    """Shared counts per type, degree and summed shared types per linked customer.

    The edge is exploded to its two ends inside one scan and summed before the shuffle.
    """
    flags = flag_columns(edges)
    ends = edges.select(F.explode(F.array(*ENDS)).alias("customer_id"), *flags, "shared_attribute_count")
    return ends.groupBy("customer_id").agg(
        *[F.sum(f).alias(f"{f[len('shared_'):]}_shared_count") for f in flags],
        F.count("*").alias("network_degree"),
        F.sum("shared_attribute_count").alias("shared_attribute_count"),
    )


def restrict_edges(edges: DataFrame, types: list[str]) -> DataFrame:
    """Edges sharing at least one of ``types``, with the count taken over these types."""
    wanted = [f"shared_{t}" for t in types if f"shared_{t}" in edges.columns]
    if not wanted:
        return edges.filter(F.lit(False))
    total = sum(F.col(f) for f in wanted)
    return edges.filter(total > 0).withColumn("shared_attribute_count", total)


def hub_report(links: DataFrame, cap: int = settings.MAX_VALUE_HOLDERS) -> DataFrame:
    """The ten most widely held values above the cap (``links`` is a set of customer and value)."""
    sizes = links.groupBy(*VALUE).agg(F.count("*").alias("customers"), F.min("attribute_value").alias("value"))
    return (
        sizes.filter(F.col("customers") > cap)
        .orderBy(F.desc("customers"), "attribute_id")
        .limit(settings.HUB_REPORT_ROWS)
        .select("attribute_type", "value", "customers")
    )


def induced_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("customer_id").dropDuplicates()
    out = edges
    for end in ENDS:
        out = out.join(ids.withColumnRenamed("customer_id", end), end, "left_semi")
    return out.select(*edges.columns)


def graph_statistics(customers: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, edges by type, linked customers and the label mix of edges, as one row.

    Four independent aggregates, each one row, put side by side by their constant key.
    """
    flags = flag_columns(edges)
    one = F.lit(1).alias("_one")
    nodes = customers.agg(F.count("*").alias("n_nodes")).select("*", one)
    sums = edges.agg(
        F.count("*").alias("n_edges"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f"edges_{f[len('shared_'):]}") for f in flags]
    ).select("*", one)
    linked = (
        edges.select(F.explode(F.array(*ENDS)).alias("customer_id"))
        .agg(F.count_distinct("customer_id").alias("linked_customers")).select("*", one)
    )
    mix = label_mix(customers, edges).select("*", one)
    return nodes.join(sums, "_one").join(linked, "_one").join(mix, "_one").drop("_one")


def label_mix(customers: DataFrame, edges: DataFrame) -> DataFrame:
    known = customers.select("customer_id", "label").filter("label is not null")
    a = known.select(F.col("customer_id").alias(ENDS[0]), F.col("label").alias("a"))
    b = known.select(F.col("customer_id").alias(ENDS[1]), F.col("label").alias("b"))
    both = edges.select(*ENDS).join(a, ENDS[0]).join(b, ENDS[1])
    return both.agg(
        F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("legit_legit"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("fraud_fraud"),
        F.count_if(F.col("a") != F.col("b")).alias("mixed"),
    )


def link_holders(links: DataFrame, cap: int = settings.MAX_VALUE_HOLDERS) -> DataFrame:
    """Every link (a set of customer and value) with the number of other holders of its value, and
    whether the value is held too widely to make edges.

    The most widely held values come from a broadcast of at most ``HOT_KEYS`` rows and their links
    are not shuffled; all others are joined on the value.
    """
    links = links.filter(F.col("attribute_type").isNotNull() & F.col("attribute_id").isNotNull())
    holders = value_holders(links)
    hot = holders.filter(F.col("customers") > cap).orderBy(F.desc("customers"), *VALUE).limit(settings.HOT_KEYS)
    warm = links.join(F.broadcast(hot), VALUE)
    rest = links.join(F.broadcast(hot.select(*VALUE)), VALUE, "left_anti").join(holders, VALUE)
    return warm.unionByName(rest).select(
        *links.columns,
        (F.col("customers") - 1).alias("shared_with"),
        (F.col("customers") > cap).alias("ignored"),
    )


def shared_evidence(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Identity values held in common by the two ends of each edge, widely held values included.

    Driven by the edges: the values of one end are looked up, then kept where the other end holds the
    same value, so a value held by everyone adds one row per edge and never pairs of its holders. The values looked up are
    many and compress well, so they are dealt over all shuffle partitions rather than over as few as their bytes suggest; no
    end and value comes more often than the end has edges. Both joins sort and merge: edges and links made from a small table
    by exploding it are taken for small ones, and would else be sent whole through the driver.
    """
    mine = links.select(F.col("customer_id").alias(ENDS[0]), *VALUE)
    theirs = links.select(F.col("customer_id").alias(ENDS[1]), *VALUE, "attribute_value")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = edges.select(*ENDS).join(mine.hint("merge"), ENDS[0]).repartition(parts, ENDS[1], *VALUE)
    return held.join(theirs.hint("merge"), [ENDS[1], *VALUE])
