"""What a console asks of one stored version: overview, one customer, one ring, the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metadata import InputError
from ..operators import edges as graph, feedback as fb, neighbourhood as nb, views
from ..sources import sinks
from ..sources.catalog import Catalog
from .analyse import Version


def _labels(reviews: DataFrame) -> DataFrame:
    return fb.feedback_labels(reviews)


def _one(frame: DataFrame, what: str) -> DataFrame:
    if frame.isEmpty():
        raise InputError(f"{what} not found.")
    return frame


def overview(spark: SparkSession, version: Version, reviews: DataFrame, top: int = 6) -> dict[str, DataFrame]:
    """Model, histogram, importance, review progress, top rings and top customers."""
    rings = version.table(spark, "rings")
    run = version.table(spark, "runs")
    used = run.first()["n_feedback"]
    return {
        "model": run,
        "histogram": version.table(spark, "histogram").orderBy("bin"),
        "importance": version.table(spark, "importance"),
        "review_progress": views.review_progress(rings, reviews),
        "top_rings": views.with_status(rings.filter("suspected"), reviews).orderBy(*nb.queue_order()).limit(top),
        "top_customers": views.top_customers(version.table(spark, "customers"), _labels(reviews)),
        "feedback": fb.feedback_summary(reviews, version.version, used),
    }


def customer_detail(
    spark: SparkSession, version: Version, reviews: DataFrame, customer_id: str, events: DataFrame | None = None
) -> dict[str, DataFrame]:
    """One customer with its identity values, connections, ring, events and reviews."""
    customers, edges = version.table(spark, "customers"), version.table(spark, "edges").drop("types")
    attributes = version.table(spark, "attributes")
    me = _one(customers.filter(F.col("customer_id") == customer_id), "Customer")
    rings = views.with_status(version.table(spark, "rings"), reviews)
    out = {
        "customer": me.join(_labels(reviews), "customer_id", "left"),
        "contributions": version.table(spark, "contributions").filter(F.col("customer_id") == customer_id),
        "attributes": attributes.filter(F.col("customer_id") == customer_id),
        "connections": views.connections(customers, edges, _labels(reviews), customer_id),
        "connection_evidence": views.connection_evidence(edges, attributes, customer_id),
        "ring": rings.join(me.select("ring_id"), "ring_id", "left_semi"),
        "reviews": fb.review_history(reviews, customer_id),
    }
    if events is not None:
        out["events"] = views.customer_events(events, customer_id)
    return out


def ring_detail(spark: SparkSession, version: Version, reviews: DataFrame, ring_id: str) -> dict[str, DataFrame]:
    """One ring with its members, evidence, graph, history and neighbours in the queue."""
    rings = version.table(spark, "rings")
    customers, membership = version.table(spark, "customers"), version.table(spark, "ring_members")
    row = _one(rings.filter(F.col("ring_id") == ring_id), "Ring")
    threshold = version.table(spark, "runs").first()["alert_threshold"]
    nodes, links = nb.ring_graph(membership, version.table(spark, "edges").drop("types"), ring_id)
    history = reviews.filter((F.col("target_type") == "ring") & (F.col("target_id") == ring_id)).orderBy("id")
    return {
        "ring": views.with_status(row, reviews),
        "members": views.ring_members(customers, membership, _labels(reviews), threshold, ring_id),
        "nodes": nodes.join(customers.select("customer_id", "name", "risk", "risk_level", "ring_id", "label", "degree"), "customer_id"),
        "edges": views.edges_for_people(links),
        "history": history,
        "neighbours": views.ring_neighbours(rings, ring_id),
    }


def network(spark: SparkSession, version: Version, reviews: DataFrame, **filters) -> dict[str, DataFrame]:
    """Rings that fit the view, their accounts with scores, and the edges among them."""
    rings = views.with_status(version.table(spark, "rings"), reviews)
    shown, nodes, links = nb.network_view(rings, version.table(spark, "ring_members"), version.table(spark, "edges").drop("types"), **filters)
    people = version.table(spark, "customers").select("customer_id", "name", "risk", "risk_level", "label", "degree")
    return {"rings": shown, "nodes": nodes.join(people, "customer_id").join(_labels(reviews), "customer_id", "left"), "edges": links}


def customer_list(spark: SparkSession, version: Version, reviews: DataFrame, **asked) -> dict[str, DataFrame]:
    """How many accounts fit the filters, and one sorted page of them."""
    total, page = views.customer_page(version.table(spark, "customers"), _labels(reviews), **asked)
    return {"total": total, "customers": page}


def ring_list(spark: SparkSession, version: Version, reviews: DataFrame, **asked) -> dict[str, DataFrame]:
    """Rings in scope counted by status, and one page of the queue."""
    counts, page = views.ring_page(version.table(spark, "rings"), version.table(spark, "customers"), reviews, **asked)
    return {"counts": counts, "rings": page}


def customer_graph(
    spark: SparkSession, version: Version, reviews: DataFrame, customer_id: str, hops: int = 2, max_nodes: int = 120
) -> dict[str, DataFrame]:
    """The accounts around one account with their hop, their scores, and the edges among them; ``cut`` tells whether some were left out."""
    customers, edges = version.table(spark, "customers"), version.table(spark, "edges").drop("types")
    _one(customers.filter(F.col("customer_id") == customer_id), "Customer")
    near, cut = nb.ego_network(edges, customer_id, hops, max_nodes)
    people = customers.select("customer_id", "name", "risk", "risk_level", "ring_id", "label", "degree")
    return {
        "nodes": near.join(people, "customer_id").join(_labels(reviews), "customer_id", "left"),
        "edges": views.edges_for_people(graph.induced_subgraph(near.select("customer_id"), edges)),
        "cut": spark.createDataFrame([(cut,)], "cut boolean"),
    }


def export(spark: SparkSession, version: Version, reviews: DataFrame) -> DataFrame:
    """The scored accounts as people get them, in order of rank."""
    return sinks.customer_export(version.table(spark, "customers").join(_labels(reviews), "customer_id", "left"))


def quality_of_scores(spark: SparkSession, version: Version) -> dict[str, DataFrame]:
    """What a version stored about the order of its scores and about its graph; tables that it lacks are left out."""
    stored = ["at_k", "pr_curve", "roc_curve", "levels", "hubs", "group_importance", "experiments"]
    held = Catalog(spark, version.root).published().filter(
        (F.col("dataset_id") == version.dataset_id) & (F.col("version") == version.version)
    ).first()["tables"]
    return {name: version.table(spark, name) for name in stored if name in held}


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """All datasets with their active version."""
    return Catalog(spark, root).datasets().orderBy("dataset_id")


def history(spark: SparkSession, version: Version) -> DataFrame:
    """All visible versions of the dataset with the change of their metrics."""
    known = Catalog(spark, version.root).versions(version.dataset_id)
    runs = sinks.read_result(spark, version.root, "runs", version.dataset_id).filter(F.col("version").isin(known))
    evaluated = runs.withColumnsRenamed({c: c[len("eval_"):] for c in runs.columns if c.startswith("eval_")})
    return views.version_history(evaluated)
