"""Ring candidates and their summaries.

Members of a ring are kept in a long table (``ring_id, customer_id``), because a community of a giant
component has no size bound and must not become one array in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import settings
from ..session import durable
from .communities import communities
from .components import connected_components
from .edges import ENDS, flag_columns, induced_subgraph
from .ordered import with_rank, with_rank_within


def candidate_groups(edges: DataFrame, max_size: int = settings.MAX_RING_SIZE, stars: DataFrame | None = None) -> DataFrame:
    """``customer_id, group_id``: components up to ``max_size``, communities of the larger ones.

    Components come from ``stars`` where given: fewer rows that connect the same accounts.
    """
    found = durable(connected_components(edges if stars is None else stars), "components")
    sizes = found.groupBy("component_id").agg(F.count("*").alias("size"))
    large = found.join(sizes.filter(F.col("size") > max_size).select("component_id"), "component_id", "left_semi")
    if large.isEmpty():
        return found.withColumnRenamed("component_id", "group_id")
    large = durable(large.select("customer_id", "component_id"), "large")
    small = found.join(large.select("customer_id"), "customer_id", "left_anti")
    inner = durable(induced_subgraph(large, edges.select(*ENDS, "shared_attribute_count")), "inner")
    split = communities(inner, large)
    return small.withColumnRenamed("component_id", "group_id").unionByName(
        split.withColumnRenamed("community_id", "group_id")
    )


def number_rings(groups: DataFrame) -> DataFrame:
    """Ring ids by size, largest first, then by smallest member (which names the group)."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    ranked = with_rank(sizes, [F.desc("size"), F.asc("group_id")], "n")
    ids = ranked.select("group_id", "size", F.format_string("R-%04d", F.col("n")).alias("ring_id"))
    return groups.join(ids, "group_id").select("ring_id", "customer_id", "size")


def inner_edges(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in the same ring."""
    a = membership.select(F.col("customer_id").alias(ENDS[0]), "ring_id")
    b = membership.select(F.col("customer_id").alias(ENDS[1]), F.col("ring_id").alias("_other"))
    return edges.join(a, ENDS[0]).join(b, ENDS[1]).filter(F.col("ring_id") == F.col("_other")).drop("_other")


def edge_summary(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Inner edges per ring and its shared types, most frequent first (ties in type order)."""
    flags = flag_columns(edges)
    sums = inner_edges(membership, edges).groupBy("ring_id").agg(
        F.count("*").alias("n_edges"), *[F.sum(f).alias(f) for f in flags]
    )
    entries = F.array(*[
        F.struct((-F.col(f)).alias("order"), F.lit(i).alias("place"), F.lit(f[len("shared_"):]).alias("type"), F.col(f).alias("edges"))
        for i, f in enumerate(flags)
    ])
    ordered = F.array_sort(F.filter(entries, lambda e: e["edges"] > 0))
    return sums.select(
        "ring_id", "n_edges",
        F.transform(ordered, lambda e: F.struct(e["type"].alias("type"), e["edges"].alias("edges"))).alias("shared_types"),
    )


def ring_evidence(membership: DataFrame, links: DataFrame, top: int = settings.RING_EVIDENCE_ROWS) -> DataFrame:
    """Values held by two or more members, widest first; the report keeps the first ``top`` per ring.

    Links are a set of customer and value, so rows are members. The row-number filter is pushed below
    the shuffle, so only ``top`` rows per ring and task move.
    """
    held = (
        links.join(membership.select("customer_id", "ring_id"), "customer_id")
        .groupBy("ring_id", "attribute_type", "attribute_id")
        .agg(F.count("*").alias("members"), F.min("attribute_value").alias("value"))
        .filter("members >= 2")
    )
    order = Window.partitionBy("ring_id").orderBy(F.desc("members"), "attribute_type", "attribute_id")
    return held.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def evidence_arrays(evidence: DataFrame) -> DataFrame:
    """Evidence rows (already bounded per ring) as one array."""
    rows = F.array_sort(F.collect_list(F.struct("position", "attribute_type", "value", "members")))
    return evidence.groupBy("ring_id").agg(rows.alias("evidence"))


def ring_truth(membership: DataFrame, customers: DataFrame) -> DataFrame:
    """Labelled and fraud members, and the known ring most members belong to (ties: largest name)."""
    known = membership.select("ring_id", "customer_id").join(
        customers.select("customer_id", "label", "truth_ring"), "customer_id"
    )
    counts = known.groupBy("ring_id").agg(F.count("label").alias("n_labeled"), F.count_if(F.expr("label = 1")).alias("n_fraud"))
    dominant = (
        known.filter("truth_ring is not null").groupBy("ring_id", "truth_ring").agg(F.count("*").alias("n"))
        .groupBy("ring_id").agg(F.max(F.struct("n", "truth_ring")).alias("d"))
        .select("ring_id", F.col("d.truth_ring").alias("dominant_truth_ring"), F.col("d.n").alias("dominant_count"))
    )
    return counts.join(dominant, "ring_id", "left").fillna(0, ["dominant_count"])


def ring_scores(membership: DataFrame, customers: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Size, mean and highest risk, high-risk members, suspicion and the span of opening dates."""
    members = membership.select("ring_id", "customer_id").join(scores.select("customer_id", "risk"), "customer_id")
    members = members.join(customers.select("customer_id", "open_date"), "customer_id")
    n_high = F.count_if(F.col("risk") >= threshold)
    return members.groupBy("ring_id").agg(
        F.count("*").alias("size"),
        # The last bits of a mean depend on the order of addition; the ring queue must not.
        F.round(F.avg("risk"), 12).alias("score"),
        F.max("risk").alias("max_risk"),
        n_high.alias("n_high"),
        ((n_high >= 2) | (F.avg("risk") >= threshold)).alias("suspected"),
        F.when(F.count("open_date") >= 2, F.date_diff(F.max("open_date"), F.min("open_date"))).alias("open_span_days"),
    )


def summarise_rings(
    membership: DataFrame, edges: DataFrame, links: DataFrame, customers: DataFrame, scores: DataFrame, threshold: float
) -> DataFrame:
    """One row per ring candidate: scores, density, shared types, evidence and truth.

    Every part is aggregated to one row per ring before it is joined.
    """
    size = F.col("size")
    pairs = size * (size - 1) / 2
    return (
        ring_scores(membership, customers, scores, threshold)
        .join(edge_summary(membership, edges), "ring_id", "left")
        .join(evidence_arrays(ring_evidence(membership, links)), "ring_id", "left")
        .join(ring_truth(membership, customers), "ring_id", "left")
        .withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
        .withColumn("density", F.when(size > 1, F.col("n_edges") / pairs).otherwise(0.0))
    )


def members_in_order(membership: DataFrame, scores: DataFrame) -> DataFrame:
    """Members of each ring with their position by score, ties by id."""
    rows = membership.select("ring_id", "customer_id").join(scores.select("customer_id", "risk"), "customer_id")
    return with_rank_within(rows, ["ring_id"], [F.desc("risk"), F.asc("customer_id")])


def detection_quality(rings: DataFrame, membership: DataFrame, customers: DataFrame) -> DataFrame:
    """How suspected rings line up with labels and known rings, as one row."""
    one = F.lit(1).alias("_one")
    suspected = rings.filter("suspected").select("ring_id")
    counts = rings.agg(
        F.count("*").alias("n_candidates"),
        F.count_if("suspected").alias("n_suspected"),
        (F.count_if(F.col("suspected") & (F.col("n_fraud") > F.col("size") / 2)) / F.nullif(F.count_if("suspected"), F.lit(0))).alias("precision"),
    ).select("*", one)
    inside = membership.select("customer_id", "ring_id").join(suspected, "ring_id", "left_semi")
    fraud = customers.filter("label = 1").select("customer_id").join(inside, "customer_id", "left")
    recall = fraud.agg(
        F.count("*").alias("n_fraud_customers"),
        (F.count("ring_id") / F.nullif(F.count("*"), F.lit(0))).alias("member_recall"),
    ).select("*", one)
    known = customers.filter("truth_ring is not null").select("customer_id", "truth_ring")
    true_rings = known.groupBy("truth_ring").agg(F.count("*").alias("n")).filter("n >= 2")
    hits = (
        known.join(inside, "customer_id").groupBy("truth_ring", "ring_id").agg(F.count("*").alias("n"))
        .filter("n >= 2").select("truth_ring").distinct()
    )
    found = true_rings.join(hits.withColumn("hit", F.lit(1)), "truth_ring", "left").agg(
        F.count("*").alias("n_true_rings"),
        (F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("ring_recall"),
    ).select("*", one)
    return counts.join(recall, "_one").join(found, "_one").drop("_one")


def ring_connectivity(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Possible and connected pairs per known ring; pairs are counted, never listed."""
    possible = truth.groupBy("ring_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("total_pairs"))
    joined = inner_edges(truth, edges.select(*ENDS)).groupBy("ring_id").agg(F.count("*").alias("connected_pairs"))
    return possible.join(joined, "ring_id", "left").fillna(0, ["connected_pairs"])


def connectivity_report(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """The per-ring ratio and, with a NULL ring, the overall one."""
    return (
        ring_connectivity(truth, edges)
        .rollup("ring_id")
        .agg(F.sum("total_pairs").alias("total_pairs"), F.sum("connected_pairs").alias("connected_pairs"))
        .withColumn("ratio", F.coalesce(F.try_divide("connected_pairs", "total_pairs"), F.lit(0.0)))
    )
