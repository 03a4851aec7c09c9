"""Shapley contributions by sampled feature orders, evaluated in one distributed pass.

Every sampled order switches a customer's features one by one to a typical customer's values. The
switched sets of all orders are laid out up front: each distinct set carries the credit its score
gives to every feature.

A tree model sees of a value only between which of its splits it lies, and it has few splits a feature. So rows are first
brought together by these places: all rows of one cell get the same score whatever is switched. Each cell is exploded over
the fixed list inside its own task, scored by the JVM model and summed back before the shuffle, and every customer takes the
numbers of its cell. Where no two rows share a cell this scores what it would score row by row.
"""

from __future__ import annotations

import json
import random

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..session import durable
from .models import ScoringModel
from .trees import tree_table

# Fixed value: orders per customer, at every table size.
ORDERS = 12


def paired_orders(features: list[str], count: int, seed: int = settings.SEED) -> list[list[str]]:
    """Random feature orders, each followed by its reverse."""
    draw = random.Random(seed)
    out = []
    for _ in range(max(1, count // 2)):
        order = draw.sample(features, len(features))
        out += [order, order[::-1]]
    return out


def switched_sets(orders: list[list[str]], features: list[str]) -> list[dict]:
    """Each distinct set of switched features with the credit its score carries to every feature."""
    credit: dict[frozenset, dict[str, float]] = {}
    for order in orders:
        for left in range(len(order) + 1):
            owner = credit.setdefault(frozenset(order[:left]), dict.fromkeys(features, 0.0))
            if left < len(order):
                owner[order[left]] += 1.0 / len(orders)
            if left:
                owner[order[left - 1]] -= 1.0 / len(orders)
    return [
        {"off": [f in chosen for f in features], "credit": [owner[f] for f in features]}
        for chosen, owner in credit.items()
    ]


def shapley(model: ScoringModel, frame: DataFrame, baseline: dict[str, float], orders: int = ORDERS) -> DataFrame:
    """``customer_id, risk, baseline_score, phi_<feature>``; the phi of a row add up to risk - baseline_score.

    The orders depend on the features of the model only, so a customer's contributions do not change
    with the other rows. A feature at the baseline in every row earns nothing and is not switched.
    """
    features = model.features
    moves = frame.agg(*[F.max(F.col(f) != F.lit(baseline[f])).alias(f) for f in features]).first()
    moving = [f for f in features if moves[f]]
    spark = frame.sparkSession
    typical = spark.range(1).select(F.lit("typical").alias("customer_id"), *[F.lit(float(baseline[f])).alias(f) for f in features])
    baseline_score = float(model.score(typical).first()["risk"])
    if not moving:
        return model.score(frame).select(
            "customer_id", "risk", F.lit(baseline_score).alias("baseline_score"), *[F.lit(0.0).alias(f"phi_{f}") for f in features]
        )
    drawn = [[f for f in order if f in moving] for order in paired_orders(features, orders)]
    sets = switched_sets(drawn, moving)
    layout = F.from_json(F.lit(json.dumps(sets)), "array<struct<off:array<boolean>,credit:array<double>>>")
    typical_values = F.array(*[F.lit(float(baseline[f])) for f in moving])
    values = F.array(*[F.col(f).cast("double") for f in moving])
    still = {f: F.lit(float(baseline[f])) for f in features if f not in moving}
    splits = splits_of(model, spark)
    cell = F.array(*[place_among(F.col(f).cast("double"), splits.get(f, [])) for f in moving])
    laid = durable(frame.select("customer_id", cell.alias("_cell"), values.alias("_x")), "cells")
    cells = laid.groupBy("_cell").agg(F.first("_x").alias("_x")).select("_cell", "_x", F.explode(layout).alias("_s"))
    mixed = F.transform("_x", lambda x, i: F.when(F.get("_s.off", i), F.get(typical_values, i)).otherwise(x))
    rows = cells.select("_cell", mixed.alias("_m"), "_s")
    ordered = [still[f] if f in still else F.get("_m", F.lit(moving.index(f))) for f in features]
    scored = model.model.transform(rows.select("_cell", "_s", array_to_vector(F.array(*ordered)).alias("features")))
    p = F.get(vector_to_array("probability"), F.lit(1))
    phi = {f: F.sum(p * F.get("_s.credit", F.lit(i))) for i, f in enumerate(moving)}
    by_cell = scored.groupBy("_cell").agg(
        F.max(F.when(~F.exists("_s.off", lambda o: o), p)).alias("risk"),
        *[(phi[f] if f in phi else F.lit(0.0)).alias(f"phi_{f}") for f in features],
    )
    # One row a cell on this side, so a cell of very many customers is split by the skew join.
    found = laid.select("customer_id", "_cell").join(durable(by_cell, "cell-scores"), "_cell")
    return found.groupBy("customer_id").agg(
        F.max("risk").alias("risk"), F.lit(baseline_score).alias("baseline_score"), *[F.sum(f"phi_{f}").alias(f"phi_{f}") for f in features]
    )


def splits_of(model: ScoringModel, spark) -> dict[str, list[float]]:
    """The values at which the trees of a model split each feature, ascending; MLlib bounds their number by its bins."""
    at = tree_table(model, spark).filter("split is not null").groupBy("feature").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return {r["feature"]: r["splits"] for r in at.collect()}


def place_among(value: Column, splits: list[float]) -> Column:
    """Number of splits below a value, which then goes right there (NaN: all of them); -1 for a missing value."""
    below = F.size(F.filter(F.array(*[F.lit(float(s)) for s in splits]), lambda s: s < value)) if splits else F.lit(0)
    return F.when(value.isNull(), -1).otherwise(below)


def importance(contributions: DataFrame, features: list[str], groups: dict[str, str], labels: dict[str, str]) -> DataFrame:
    """Mean absolute contribution per feature: one wide aggregate row turned into rows."""
    row = contributions.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in features])
    entries = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(labels.get(f, f)).alias("label"),
                 F.lit(groups.get(f, "tabular")).alias("group"), F.col(f).alias("importance"))
        for f in features
    ]))
    return row.select(entries.alias("e")).select("e.*").orderBy(F.desc("importance"), "feature")


def group_importance(by_feature: DataFrame) -> DataFrame:
    return by_feature.groupBy("group").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "group")
