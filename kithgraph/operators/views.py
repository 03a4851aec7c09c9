"""Read queries over the result tables.

``customers``: customer_id, name, risk, risk_level, rank, ring_id, degree, high_neighbors, top_reason, label.
``rings``: ring_id, size, n_edges, density, score, max_risk, n_high, suspected and nested details.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.metadata import InputError
from . import feedback as fb
from .edges import type_array
from .neighbourhood import neighbours, queue_order

BRIEF = [
    "customer_id", "name", "risk", "risk_level", "rank", "ring_id", "degree", "high_neighbors", "top_reason", "label",
    "analyst_label",
]
SORTS = ("risk", "name", "degree", "customer_id")


def briefs(customers: DataFrame, labels: DataFrame) -> DataFrame:
    """Customers with the analyst's label."""
    joined = customers.join(labels, "customer_id", "left")
    return joined.select(*[c for c in BRIEF if c in joined.columns])


def matching_customers(
    customers: DataFrame, labels: DataFrame, q: str = "", level: str = "all", ring: str | None = None, reviewed: str = "all"
) -> DataFrame:
    """Customers that pass every filter; plain predicates are left to the scan."""
    rows = customers
    if q.strip():
        like = f"%{q.strip()}%"
        rows = rows.filter(F.col("customer_id").ilike(like) | F.col("name").ilike(like))
    if level != "all":
        rows = rows.filter(F.col("risk_level") == level)
    if ring:
        rows = rows.filter(F.col("ring_id") == ring)
    if reviewed == "unreviewed":
        rows = rows.join(labels.select("customer_id"), "customer_id", "left_anti")
    elif reviewed != "all":
        wanted = labels.filter(F.col("analyst_label") == (1 if reviewed == "fraud" else 0)).select("customer_id")
        rows = rows.join(wanted, "customer_id", "left_semi")
    return rows


def customer_page(
    customers: DataFrame, labels: DataFrame, sort: str = "risk", order: str = "desc", limit: int = 50, offset: int = 0, **filters
) -> tuple[DataFrame, DataFrame]:
    """The total of matching customers and one sorted page of them."""
    if sort not in SORTS:
        raise InputError(f"Cannot sort by {sort}.")
    rows = matching_customers(customers, labels, **filters)
    key = F.desc(sort) if order == "desc" else F.asc(sort)
    page = rows.orderBy(key, F.asc("customer_id")).offset(offset).limit(limit)
    return rows.agg(F.count("*").alias("total")), briefs(page, labels)


def top_customers(customers: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    return briefs(customers.orderBy("rank").limit(n), labels)


def with_status(rings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rings with their review status, pending where never reviewed."""
    return rings.join(fb.ring_statuses(reviews).withColumnRenamed("note", "review_note"), "ring_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def matching_rings(rings: DataFrame, customers: DataFrame, scope: str = "suspected", q: str = "") -> DataFrame:
    """Rings in scope whose id, or a member's id or name, contains the text."""
    rows = rings if scope == "all" else rings.filter(F.col("suspected") == (scope == "suspected"))
    needle = q.strip().lower()
    if not needle:
        return rows
    like = f"%{needle}%"
    hits = customers.filter(
        F.col("ring_id").isNotNull() & (F.lower("customer_id").like(like) | F.lower("name").like(like))
    ).select("ring_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, "ring_id", "left").filter(
        F.contains(F.lower("ring_id"), F.lit(needle)) | F.col("_hit")
    ).drop("_hit")


def ring_status_counts(rings: DataFrame) -> DataFrame:
    """Rings by status, before any status filter, as one row."""
    return rings.agg(
        F.count("*").alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "confirmed", "dismissed")]
    )


def ring_page(
    rings: DataFrame, customers: DataFrame, reviews: DataFrame, status: str = "all", scope: str = "suspected", q: str = "",
    limit: int = 50, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    rows = with_status(matching_rings(rings, customers, scope, q), reviews)
    counts = ring_status_counts(rows)
    kept = rows if status == "all" else rows.filter(F.col("status") == status)
    return counts, kept.orderBy(*queue_order()).offset(offset).limit(limit)


def ring_neighbours(rings: DataFrame, ring_id: str) -> DataFrame:
    """Previous and next ring in the queue of a ring, by two top-1 searches and no global window."""
    me = rings.filter(F.col("ring_id") == ring_id).select("suspected", "score", "size", "ring_id").first()
    if me is None:
        raise InputError("Ring not found.")
    peers = rings.filter(F.col("suspected") == me["suspected"])
    score, size = F.lit(me["score"]), F.lit(me["size"])
    same_score, same_size = F.col("score") == score, F.col("size") == size
    before = (F.col("score") > score) | (same_score & (F.col("size") > size)) | (same_score & same_size & (F.col("ring_id") < ring_id))
    after = (F.col("score") < score) | (same_score & (F.col("size") < size)) | (same_score & same_size & (F.col("ring_id") > ring_id))
    last = peers.filter(before).orderBy(F.asc("score"), F.asc("size"), F.desc("ring_id")).select("ring_id").first()
    following = peers.filter(after).orderBy(*queue_order()).select("ring_id").first()
    return rings.sparkSession.createDataFrame(
        [(ring_id, last and last[0], following and following[0])], "ring_id string, previous_ring string, next_ring string"
    )


def queue_links(ranked: DataFrame) -> DataFrame:
    """Previous and next ring for every ring, from the queue position ``place`` within ``suspected``.

    Neighbouring places meet by equi-join, so the queue is never gathered in one window task.
    """
    near = ranked.select("suspected", "place", "ring_id")
    left = near.select("suspected", (F.col("place") + 1).alias("place"), F.col("ring_id").alias("previous_ring"))
    right = near.select("suspected", (F.col("place") - 1).alias("place"), F.col("ring_id").alias("next_ring"))
    return near.join(left, ["suspected", "place"], "left").join(right, ["suspected", "place"], "left")


def customer_events(events: DataFrame, customer_id: str, rows: int | None = None) -> DataFrame:
    """A customer's events by date: all of them, or the first ``rows``."""
    ordered = events.filter(F.col("customer_id") == customer_id).orderBy("event_date")
    return ordered if rows is None else ordered.limit(rows)


def connections(customers: DataFrame, edges: DataFrame, labels: DataFrame, customer_id: str) -> DataFrame:
    """Accounts linked to one account, riskiest first, with the types shared."""
    linked = neighbours(edges, customer_id).withColumnRenamed("other_id", "customer_id")
    rows = customers.join(linked, "customer_id").join(labels, "customer_id", "left")
    return rows.select(
        "customer_id", "name", "risk", "risk_level", "ring_id", "label", "analyst_label", "types"
    ).orderBy(F.desc("risk"), "customer_id")


def connection_evidence(edges: DataFrame, links: DataFrame, customer_id: str) -> DataFrame:
    """The identity values each linked account has in common with one account, one row per value.

    Widely held values count here too. The account's own keys are looked up in the links of the
    linked accounts only.
    """
    linked = neighbours(edges, customer_id).select(F.col("other_id").alias("customer_id"))
    mine = links.filter(F.col("customer_id") == customer_id).select("attribute_type", "attribute_id")
    theirs = links.join(linked, "customer_id", "left_semi").join(mine, ["attribute_type", "attribute_id"], "left_semi")
    return theirs.select("customer_id", "attribute_type", "attribute_value")


def ring_members(customers: DataFrame, membership: DataFrame, labels: DataFrame, threshold: float, ring_id: str) -> DataFrame:
    """Members of one ring by risk, with the ones a confirmation would include."""
    inside = membership.filter(F.col("ring_id") == ring_id).select("ring_id", "customer_id")
    rows = briefs(customers.join(inside.select("customer_id"), "customer_id", "left_semi"), labels)
    suggested = fb.suggested_members(inside, customers, threshold).select("customer_id", "suggested")
    return rows.join(suggested, "customer_id").orderBy(F.desc("risk"), "customer_id")


def review_progress(rings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Suspected rings and how many are reviewed, confirmed and dismissed."""
    rows = with_status(rings.filter("suspected").select("ring_id"), reviews)
    return rows.agg(
        F.count("*").alias("suspected"),
        F.count_if(F.expr("status <> 'pending'")).alias("reviewed"),
        F.count_if(F.expr("status = 'confirmed'")).alias("confirmed"),
        F.count_if(F.expr("status = 'dismissed'")).alias("dismissed"),
    )


def version_history(runs: DataFrame) -> DataFrame:
    """Model versions in order with the change in their main metrics; a dataset has few versions."""
    per_dataset = Window.partitionBy("dataset_id").orderBy("version")
    metrics = [c for c in ("roc_auc", "pr_auc", "precision", "recall", "f1") if c in runs.columns]
    deltas = {f"{m}_change": F.col(m) - F.lag(m).over(per_dataset) for m in metrics}
    return runs.withColumns(deltas).orderBy("dataset_id", "version")


def dataset_list(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Datasets with their newest version."""
    active = runs.groupBy("dataset_id").agg(F.max("version").alias("active_version"))
    return datasets.join(active, "dataset_id", "left").orderBy("dataset_id")


def edges_for_people(edges: DataFrame) -> DataFrame:
    """Edges with the shared types as an array."""
    return edges.select(
        F.col("source_customer_id").alias("source"), F.col("target_customer_id").alias("target"),
        type_array(edges).alias("types"), F.col("shared_attribute_count").alias("weight"),
    )
