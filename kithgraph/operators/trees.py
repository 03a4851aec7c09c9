"""Trees of a fitted model as a table, and scoring by joins over it.

A stored model can be read, compared and applied without MLlib: ``tree_table`` has one row per node, and ``score_by_trees``
sends every row down all trees at once, one join per level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import durable, step_folder
from .models import ScoringModel


def tree_table(model: ScoringModel, spark) -> DataFrame:
    """``tree, node, feature, split, left, right, leaf, samples, weight``: a row goes left when its feature is at most ``split``.

    ``leaf`` is what a leaf adds, NULL inside; ``weight`` is the tree's. Read from the files that MLlib writes for the model.
    """
    path = f"{step_folder(spark)}/model-{uuid.uuid4().hex}"
    model.model.write().save(path)
    names = F.array(*[F.lit(f) for f in model.features])
    weights = F.array(*[F.lit(float(w)) for w in model.model.treeWeights])
    node, inside = F.col("nodeData"), F.col("nodeData.leftChild") >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), node["id"].cast("int").alias("node"),
        F.when(inside, F.get(names, F.col("nodeData.split.featureIndex"))).alias("feature"),
        F.when(inside, F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0))).alias("split"),
        F.when(inside, node["leftChild"]).cast("int").alias("left"), F.when(inside, node["rightChild"]).cast("int").alias("right"),
        F.when(~inside, node["prediction"]).alias("leaf"), node["rawCount"].cast("bigint").alias("samples"),
        F.get(weights, F.col("treeID")).alias("weight"),
    )


def score_by_trees(nodes: DataFrame, frame: DataFrame, depth: int) -> DataFrame:
    """``customer_id, risk`` by a boosted model's ``tree_table``: the logistic of twice the weighted sum of leaves."""
    names = [c for c in frame.columns if c != "customer_id"]
    pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("double"))]
    rows = frame.select("customer_id", F.create_map(*pairs).alias("x"))
    # A model has some hundred trees; every row starts at the root of each.
    trees = [F.lit(r["tree"]) for r in nodes.select("tree").distinct().orderBy("tree").collect()]
    at = rows.withColumn("tree", F.explode(F.array(*trees))).withColumn("node", F.lit(0))
    steps = nodes.drop("weight", "samples")
    for level in range(depth):
        step = at.join(steps, ["tree", "node"])
        goes = F.when(F.element_at("x", F.col("feature")) <= F.col("split"), F.col("left")).otherwise(F.col("right"))
        at = step.select("customer_id", "x", "tree", F.when(F.col("leaf").isNull(), goes).otherwise(F.col("node")).alias("node"))
        if level % 3 == 2:
            at = durable(at, "walk")
    ended = at.join(nodes.select("tree", "node", "leaf", "weight"), ["tree", "node"])
    return ended.groupBy("customer_id").agg((1 / (1 + F.exp(-2 * F.sum(F.col("leaf") * F.col("weight"))))).alias("risk"))


def depth_of(model: ScoringModel) -> int:
    """Levels below the root of the deepest tree."""
    return max(tree.depth for tree in model.model.trees)
