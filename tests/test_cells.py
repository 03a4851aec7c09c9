"""Contributions are scored once a cell, features are made once, and deep forests keep node ids."""

import pytest
from pyspark.sql import functions as F

from kithgraph.model import Dataset
from kithgraph.operators import attribution as AT, features as FT, models as ML
from kithgraph.session import durable


class Counted:
    """A fitted model that counts the rows it scores."""

    def __init__(self, model):
        self.model, self.rows = model, 0

    def __getattr__(self, name):
        return getattr(self.model, name)

    def transform(self, frame):
        self.rows += frame.count()
        return self.model.transform(frame)


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(0, 600, 1, 3).select(
        F.concat(F.lit("c"), F.when(F.col("id") < 2, 0).otherwise(F.col("id")).cast("string")).alias("customer_id"),
        F.round(F.rand(seed=1) * 9, 3).alias("a"), (F.col("id") * 7 % 5).cast("double").alias("b"), F.lit(2.0).alias("same"),
    )
    return durable(rows.withColumn("label", ((F.col("a") > 4) | (F.col("b") > 3)).cast("int")), "frame")


def test_rows_of_one_cell_are_scored_once_and_right(spark, frame):
    features, baseline = ["a", "b", "same"], {"a": 3.5, "b": 1.0, "same": 2.0}
    fitted = ML.fit(frame, features, ML.Learners(boosting_rounds=3, depth=2, min_leaf=20).boosting())
    counted = Counted(fitted.model)
    found = {r["customer_id"]: r for r in AT.shapley(ML.ScoringModel(features, counted), frame, baseline).collect()}
    moving = ["a", "b"]
    sets = AT.switched_sets([[f for f in o if f in moving] for o in AT.paired_orders(features, AT.ORDERS)], moving)
    assert counted.rows < 600 * len(sets) / 4  # 600 rows in few cells: every set of every row before
    rows = frame.collect()
    laid = [(i, *[baseline[f] if f in moving and s["off"][moving.index(f)] else float(r[f]) for f in features]) for r in rows for i, s in enumerate(sets)]
    risks = [x["risk"] for x in fitted.score(spark.createDataFrame(laid, "i int, a double, b double, same double").coalesce(1)).collect()]
    want = {}
    for n, r in enumerate(rows):
        mine = risks[n * len(sets) : (n + 1) * len(sets)]
        phi = [sum(p * s["credit"][k] for p, s in zip(mine, sets, strict=True)) for k in range(2)]
        risk = next(p for p, s in zip(mine, sets, strict=True) if not any(s["off"]))
        old = want.setdefault(r["customer_id"], [risk, 0.0, 0.0])
        want[r["customer_id"]] = [max(old[0], risk), old[1] + phi[0], old[2] + phi[1]]
    assert len(found) == len(want) == 599  # an id that comes twice has its contributions summed
    for key, (risk, a, b) in want.items():
        r = found[key]
        assert (r["risk"], r["phi_a"], r["phi_b"], r["phi_same"]) == (risk, pytest.approx(a, abs=1e-12), pytest.approx(b, abs=1e-12), 0.0)


def test_places_among_splits(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 9.0, float("nan"), None)], "x double")
    places = [r[0] for r in rows.coalesce(1).select(AT.place_among(F.col("x"), [1.0, 2.0])).collect()]
    assert places == [0, 0, 1, 1, 2, 2, -1]
    assert {r[0] for r in rows.select(AT.place_among(F.col("x"), [])).collect()} == {0, -1}


def test_features_are_written_once(spark):
    customers = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "customer_id string, income double")
    edges = spark.createDataFrame([("a", "b", 1, 1)], "source_customer_id string, target_customer_id string, shared_phone int, shared_attribute_count int")
    data = Dataset(customers, None, None, ["income"], {"income": "Income"}, frozenset(), "train")
    found = FT.assemble_features(data, edges, ["phone"])
    assert "Join" not in found.frame._jdf.queryExecution().executedPlan().toString()
    assert found.network[0] == "phone_shared_count"
    assert {(r["customer_id"], r["income"], r["network_degree"]) for r in found.frame.collect()} == {("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", None, 0.0)}


def test_forests_keep_node_ids():
    assert ML.Learners().forest().getCacheNodeIds()
