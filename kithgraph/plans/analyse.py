"""Analyse a dataset, store one version of its results, and retrain with analyst decisions.

Result tables, each partitioned by dataset and version: ``customers``, ``contributions``, ``attributes``,
``edges``, ``rings``, ``ring_members``, ``events``, ``histogram``, ``importance``, ``group_importance``, ``hubs``, ``at_k``,
``pr_curve``, ``roc_curve``, ``levels``, ``experiments``, ``runs``. They become visible together when the version is published,
and the tables of the steps on the way are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import settings
from ..functions.metadata import InputError, feature_group
from ..functions.values import risk_level
from ..model import Dataset, FeatureTable
from ..operators import (
    attribution, edges as graph, explain, features as ft, feedback as fb, metrics as m, neighbourhood as nb, quality,
    rings as rg, scoring,
)
from ..operators.models import Learners, Scored
from ..session import durable, steps
from ..sources import sinks
from ..sources.catalog import Catalog

NO_FEEDBACK = "customer_id string, analyst_label int"
EVALUATION = ["n", "n_positive", "threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "tn", "fp", "fn", "tp"]
CHANGES = [
    "level_changes", "newly_high", "no_longer_high", "mean_abs_score_change", "rings_newly_suspected", "rings_cleared",
]


@dataclass
class Version:
    """Stored results of one dataset version."""

    root: str
    dataset_id: str
    version: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return Catalog(spark, self.root).read(name, self.dataset_id, self.version)


def scored_customers(
    data: Dataset, edges: DataFrame, table: FeatureTable, result: Scored, membership: DataFrame, rings: DataFrame,
    feedback: DataFrame, types: list[str],
) -> DataFrame:
    """Customers with score, level, rank, ring, neighbours and their explanation."""
    level = risk_level(F.col("risk"), result.threshold)
    scored = durable(m.risk_ranks(result.scores.withColumn("level", level)), "ranked")
    about = rings.select("ring_id", F.struct(
        "ring_id", "size", "n_high", "suspected",
        F.coalesce(F.transform("shared_types", lambda e: e["type"]), F.array().cast("array<string>")).alias("shared_types"),
    ).alias("ring"))
    in_ring = membership.select("customer_id", "ring_id").join(about, "ring_id")
    kinds = [t for t in types if ft.count_feature(t) in table.frame.columns]
    counts = F.array(*[
        F.struct(F.lit(t).alias("kind"), F.col(ft.count_feature(t)).cast("bigint").alias("count")) for t in kinds
    ])
    high = nb.high_risk_neighbours(edges, scored.select("customer_id", "level"))
    rows = (
        table.frame.join(scored, "customer_id")
        .withColumns({
            "contributions": explain.contribution_array(result.features, table.labels),
            "shared_counts": counts, "degree": F.col("network_degree").cast("bigint"),
            "features": F.struct(*[f for f in dict.fromkeys(table.features + result.features)]),
        })
        .select("customer_id", "risk", "level", "rank", "baseline_score", "contributions", "shared_counts", "degree", "features")
        .join(high, "customer_id", "left").fillna(0, ["high_neighbors"])
        .join(in_ring, "customer_id", "left")
        .join(feedback, "customer_id", "left")
        .join(data.customers.select("customer_id", "name", "label", "truth_ring", "open_date"), "customer_id")
    )
    told = explain.explain_customers(rows)
    return told.select(
        "customer_id", "name", "label", "truth_ring", "open_date", "risk", F.col("level").alias("risk_level"), "rank", "ring_id",
        "degree", "high_neighbors", "top_reason", F.to_json("features").alias("features"), "summary",
        F.bround(F.col("baseline_score") * 100, 1).alias("baseline_score"), "reasons", "mitigating", "context",
        explain.stored_contributions(F.col("contributions")).alias("contributions"),
    )


def _run_row(
    data: Dataset, edges: DataFrame, result: Scored, customers: DataFrame, rings: DataFrame, membership: DataFrame,
    n_feedback: int, previous: Version | None,
) -> DataFrame:
    """Everything about the version in one row."""
    spark = customers.sparkSession
    parts = [spark.range(1).select(
        F.lit(result.mode).alias("mode"), F.lit(float(result.threshold)).alias("alert_threshold"), F.lit(n_feedback).alias("n_feedback"),
        F.lit(json.dumps(result.features)).alias("features"), F.lit(json.dumps(data.notes + result.notes)).alias("notes"),
    )]
    levels = customers.agg(*[F.count_if(F.col("risk_level") == x).alias(f"n_{x}") for x in ("high", "medium", "low")])
    parts += [levels, rg.detection_quality(rings, membership, data.customers).withColumnsRenamed({"precision": "ring_precision"})]
    summary = quality.dataset_summary(data.customers, data.links, edges, data.events)
    stats = graph.graph_statistics(data.customers, edges)
    parts += [summary, stats.select(*[c for c in stats.columns if c not in summary.columns])]
    nothing = F.lit(None).cast("double")
    if result.evaluation is not None:
        parts.append(result.evaluation.select(*[F.col(c).cast("double").alias(f"eval_{c}") for c in EVALUATION], "scope"))
    else:
        parts.append(spark.range(1).select(*[nothing.alias(f"eval_{c}") for c in EVALUATION], F.lit(None).cast("string").alias("scope")))
    before = None
    if previous is not None:
        old = previous.table(spark, "customers")
        changes = m.side_by_side([
            m.version_changes(customers.select("customer_id", F.col("risk_level").alias("level"), "risk"), old.select("customer_id", F.col("risk_level").alias("level"), "risk")),
            m.ring_changes(rings.select("ring_id", "suspected"), previous.table(spark, "rings").select("ring_id", "suspected")),
        ])
        parts.append(changes.select(*[F.col(c).cast("double").alias(c) for c in CHANGES]))
        if result.evaluated is not None:
            threshold = previous.table(spark, "runs").first()["alert_threshold"]
            before = m.same_customers_before(result.evaluated, old, threshold)
    else:
        parts.append(spark.range(1).select(*[nothing.alias(c) for c in CHANGES]))
    kept = ["roc_auc", "pr_auc", "precision", "recall", "f1"]
    if before is not None:
        parts.append(before.select(*[F.col(c).cast("double").alias(f"previous_{c}") for c in kept]))
    else:
        parts.append(spark.range(1).select(*[nothing.alias(f"previous_{c}") for c in kept]))
    return m.side_by_side(parts)


def analyse(
    data: Dataset, root: str, dataset_id: str, version: int = 1, feedback: DataFrame | None = None,
    reference: tuple[Dataset, DataFrame] | None = None, learners: Learners = Learners(),
    cap: int = settings.MAX_VALUE_HOLDERS, max_ring: int = settings.MAX_RING_SIZE, previous: Version | None = None,
) -> Version:
    """Graph, features, scores, rings, explanations and their storage, as one version of the dataset."""
    spark = data.customers.sparkSession
    catalog = Catalog(spark, root)
    if version in catalog.versions(dataset_id):
        raise InputError(f"Version {version} of {dataset_id} is published already.")
    with steps(spark):
        tables = _results(data, root, dataset_id, version, feedback, reference, learners, cap, max_ring, previous)
        for name, frame in tables.items():
            sinks.write_result(frame, root, name, dataset_id, version)
        if previous is None:
            save_snapshot(data, f"{root}/snapshots/{quote(dataset_id, safe='')}")
        about = tables["runs"].first().asDict()
    catalog.publish(dataset_id, version, list(tables), summary={k: about[k] for k in ("mode", "n_customers", "n_links", "n_edges") if k in about})
    return Version(root, dataset_id, version)


def ranked_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """Tables about the order of scores (``customer_id, label, risk``): precision and recall among the first K, and both curves."""
    if scored.isEmpty():
        return {}
    stepped = durable(m.score_steps(scored), "score_steps")
    return {"at_k": m.at_k(scored), "pr_curve": m.pr_curve(stepped), "roc_curve": m.roc_curve(stepped)}


def _results(
    data: Dataset, root: str, dataset_id: str, version: int, feedback: DataFrame | None, reference: tuple[Dataset, DataFrame] | None,
    learners: Learners, cap: int, max_ring: int, previous: Version | None,
) -> dict[str, DataFrame]:
    """All result tables of a version by name."""
    spark = data.customers.sparkSession
    if feedback is None:
        feedback = spark.createDataFrame([], NO_FEEDBACK)
    feedback = durable(feedback.join(data.customers.select("customer_id"), "customer_id", "left_semi"), "feedback")
    types = graph.edge_types(data.links)
    groups = durable(graph.linking_groups(data.links, cap, distinct=False), "groups")
    edges = durable(graph.edges_from_groups(groups, types), "edges")
    table = ft.assemble_features(data, edges, types)
    table = FeatureTable(durable(table.frame, "features"), table.tabular, table.network, table.temporal, table.labels)
    result = scoring.score_dataset(data, edges, types, table, feedback, reference, f"{root}/calibration", learners)
    membership = durable(rg.number_rings(rg.candidate_groups(edges, max_ring, graph.stars_from_groups(groups))), "membership")
    rings = rg.summarise_rings(membership, edges, data.links, data.customers, result.scores, result.threshold)
    rings = durable(rings.withColumn("explanation", explain.ring_explanation()), "rings")
    customers = durable(scored_customers(data, edges, table, result, membership, rings, feedback, types), "customers")
    run = _run_row(data, edges, result, customers, rings, membership, feedback.count(), previous)

    labels = {f: table.labels.get(f, f) for f in result.features}
    by_feature = attribution.importance(result.scores, result.features, {f: feature_group(f) for f in result.features}, labels)
    tables = {
        "customers": customers.drop("contributions"),
        "contributions": customers.select("customer_id", "contributions"),
        "attributes": graph.link_holders(data.links, cap),
        "edges": edges.withColumn("types", graph.type_array(edges)),
        "rings": rings,
        "ring_members": rg.members_in_order(membership, result.scores),
        "histogram": m.risk_histogram(customers.select("risk", "label")),
        "importance": by_feature,
        "group_importance": attribution.group_importance(by_feature),
        "hubs": graph.hub_report(data.links, cap),
        "levels": m.level_counts(customers.select("risk"), result.threshold),
        # Of the accounts that were evaluated, or else of all that have a label.
        **ranked_tables(customers.select("customer_id", "label", "risk").filter("label is not null") if result.evaluated is None else result.evaluated),
        "runs": durable(run, "runs"),
    }
    if result.experiments is not None:
        tables["experiments"] = result.experiments
    if data.events is not None and previous is None:
        tables["events"] = data.events
    return tables


def save_snapshot(data: Dataset, path: str) -> None:
    """Canonical tables and metadata kept for retraining."""
    spark = data.customers.sparkSession
    sinks.save_snapshot(path, data.customers, data.links, data.events)
    about = {
        "tabular": data.tabular, "labels": data.labels, "event_columns": sorted(data.event_columns), "label_mode": data.label_mode,
        "notes": data.notes, "has_events": data.events is not None,
    }
    spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/about")


def load_snapshot(spark: SparkSession, path: str) -> Dataset:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    return Dataset(
        spark.read.parquet(f"{path}/customers"), spark.read.parquet(f"{path}/links"),
        spark.read.parquet(f"{path}/events") if about["has_events"] else None,
        about["tabular"], about["labels"], frozenset(about["event_columns"]), about["label_mode"], about["notes"],
    )


def retrain(
    spark: SparkSession, root: str, dataset_id: str, reviews: DataFrame, reference: tuple[Dataset, DataFrame] | None = None,
    learners: Learners = Learners(), **options: int,
) -> Version:
    """The next version from the stored snapshot and the labels that follow from the review log."""
    last = Catalog(spark, root).active_version(dataset_id)
    if not last:
        raise InputError(f"{dataset_id} has not been analysed.")
    data = load_snapshot(spark, f"{root}/snapshots/{quote(dataset_id, safe='')}")
    return analyse(
        data, root, dataset_id, last + 1, fb.feedback_labels(reviews), reference, learners,
        previous=Version(root, dataset_id, last), **options,
    )
