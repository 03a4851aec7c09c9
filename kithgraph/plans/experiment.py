"""The research chain over tables: split, edges, features, connectivity, compared models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings
from ..functions.metadata import feature_group
from ..model import Dataset
from ..operators import edges as graph, features as ft, models as ml, rings as rg, splits
from ..operators.components import ring_or_self
from ..operators.splits import split_by_group
from ..session import durable


def experiment(data: Dataset, root: str, learners: ml.Learners = ml.Learners(), cap: int = settings.MAX_VALUE_HOLDERS) -> DataFrame:
    """Write every step's table under ``root`` and return one row of metrics per feature set and model.

    An edge is defined with a bound on the holders of a value; without one, a single value held by
    everyone would ask for all pairs of accounts.
    """
    customers = data.customers
    groups = customers.select("customer_id", ring_or_self().alias("group_id"))
    split = durable(split_by_group(groups), "split")
    if not splits.rings_on_both_sides(split, customers).isEmpty():
        raise ValueError("Ring-aware split failed: a ring appears on both sides.")
    types = graph.edge_types(data.links)
    edges = durable(graph.identity_edges(data.links, types, cap), "edges")
    table = ft.assemble_features(data, edges, types)
    frame = durable(table.frame.join(customers.select("customer_id", "label"), "customer_id").join(split.select("customer_id", "side"), "customer_id"), "frame")
    truth = customers.filter("truth_ring is not null").select("customer_id", F.col("truth_ring").alias("ring_id"))
    train, test = frame.filter("side = 'train'"), frame.filter("side = 'test'")
    spark = customers.sparkSession
    rows = []
    for name, features in ft.feature_sets(table.tabular, table.network, table.temporal).items():
        for model_name, make in learners.both().items():
            model, row, predicted = ml.evaluate(train, test, features, make())
            rows.append({"model": model_name, "experiment": name, "n_features": len(features), **row.first().asDict()})
            labelled = predicted.withColumns({"pred_label": (F.col("risk") >= 0.5).cast("int"), "model": F.lit(model_name), "experiment": F.lit(name)})
            labelled.write.mode("overwrite").parquet(f"{root}/predictions/{model_name}_{name}")
            importance = ml.tree_importance(model, spark, feature_group)
            importance.write.mode("overwrite").parquet(f"{root}/importance/{model_name}_{name}")
            importance.groupBy("feature_group").agg(F.sum("importance").alias("importance")).write.mode("overwrite").parquet(
                f"{root}/group_importance/{model_name}_{name}"
            )
    metrics = spark.createDataFrame(rows)
    for name, frame_out in {
        "split": split, "split_report": splits.split_report(split, customers), "edges": edges,
        "features": table.frame, "connectivity": rg.connectivity_report(truth, edges), "metrics": metrics,
    }.items():
        frame_out.write.mode("overwrite").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/metrics")
