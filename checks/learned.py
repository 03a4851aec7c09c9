"""Models: fitted, so checked by rows and by what must hold for every row, not by their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.functions.metadata import feature_group
from kithgraph.model import Dataset, FeatureTable
from kithgraph.operators import features as FT, models as ML, scoring as SC, trees as TR
from kithgraph.operators.attribution import shapley
from kithgraph.operators.features import NETWORK_TOTALS, count_feature
from kithgraph.session import durable

from . import fixtures as fx
from .fixtures import sql
from .scores import groups, train_test

# The full models.
LEARNERS = ML.Learners()


def dataset(spark, d) -> Dataset:
    return Dataset(
        fx.customers(spark, d), fx.links(spark, d), fx.events(spark, d), ["income"], {"income": "Income"},
        frozenset({"event_type", "utilization_pct", "credit_limit_at_time"}), "train",
    )


def table(spark, d) -> FeatureTable:
    return FT.assemble_features(dataset(spark, d), fx.edges_of(spark, d), fx.TYPES)


def experiments(spark, d):
    """Four feature sets with both models on one group split."""
    t = table(spark, d)
    g = groups(spark, d)
    rows, _ = ML.run_experiments(
        t.frame.join(g.select("customer_id", "label"), "customer_id"), g.select("customer_id", "group_id"),
        FT.feature_sets(t.tabular, t.network, t.temporal), LEARNERS,
    )
    return rows


def _network(t):
    return FeatureTable(t.frame, [], t.network, t.temporal, t.labels)


def out_of_fold_scores(spark, d):
    """Scores and contributions by models that never saw the customer's group."""
    g = groups(spark, d).select("customer_id", "group_id", "label")
    return SC.run_supervised(_network(table(spark, d)), g, LEARNERS, experiments=False).scores


def transfer_scores(spark, d):
    """Train on one half of the groups as reference with analyst labels on top, score everyone."""
    from kithgraph.operators.feedback import feedback_labels

    t = table(spark, d)
    features = [count_feature("phone"), count_feature("email"), *NETWORK_TOTALS]
    side = train_test(spark, d).select("customer_id", "group_id", "side")
    half = durable(t.frame.join(side.filter("side = 'train'"), "customer_id").join(fx.customers(spark, d).select("customer_id", "label"), "customer_id"), "half")
    threshold, _ = SC.calibrate(half, half.select("customer_id", "group_id", "label"), features, LEARNERS)
    return SC.run_transfer(t.frame, half, features, threshold, feedback_labels(fx.reviews(spark, d)), LEARNERS).scores


def tree_importance(spark, d):
    t = table(spark, d)
    train = t.frame.join(fx.customers(spark, d).select("customer_id", "label"), "customer_id")
    return ML.tree_importance(ML.fit(train, t.features, LEARNERS.forest()), spark, feature_group)


def contributions(spark, d):
    """Shapley contributions of one boosting model to every customer's score."""
    t = table(spark, d)
    frame = durable(t.frame.join(fx.customers(spark, d).select("customer_id", "label"), "customer_id"), "frame")
    model = ML.fit(frame, t.network, LEARNERS.boosting())
    return shapley(model, frame.select("customer_id", *t.network), FT.typical_legitimate(frame, t.network))


def boosting_by_trees(spark, d):
    """Whether the trees of a boosting model, read back as a table and walked by joins, give every customer the model's own score."""
    t = table(spark, d)
    frame = durable(t.frame.join(fx.customers(spark, d).select("customer_id", "label"), "customer_id"), "frame")
    model = ML.fit(frame, t.network, LEARNERS.boosting())
    nodes = durable(TR.tree_table(model, spark), "trees")
    walked = TR.score_by_trees(nodes, frame.select("customer_id", *t.network), TR.depth_of(model)).withColumnRenamed("risk", "walked")
    own = model.score(frame.select("customer_id", *t.network)).select("customer_id", "risk")
    same = (F.abs(F.col("risk") - F.col("walked")) < 1e-9).cast("int")
    return own.join(walked, "customer_id", "left").select("customer_id", F.coalesce(same, F.lit(0)).alias("same"))


def contribution_sums(spark, d):
    """Whether the contributions to every customer's score and the baseline add up to the score."""
    rows = contributions(spark, d)
    total = sum((F.col(c) for c in rows.columns if c.startswith("phi_")), F.col("baseline_score"))
    return rows.select("customer_id", (F.abs(F.col("risk") - total) < 1e-9).cast("int").alias("adds_up"), F.col("risk").between(0, 1).cast("int").alias("is_share"))


def linear_probe(spark, d):
    """Logistic regression on features averaged over the neighbourhood."""
    t = table(spark, d)
    names = t.tabular + t.network
    spread = FT.propagate(FT.normalised_adjacency(fx.customers(spark, d), fx.edges_of(spark, d)), FT.standardised(t.frame, names), names)
    rows = durable(spread.join(train_test(spark, d).select("customer_id", "side"), "customer_id").join(fx.customers(spark, d).select("customer_id", "label"), "customer_id"), "probe")
    return ML.linear_probe(rows.filter("side = 'train'"), rows.filter("side = 'test'"), names)


QUERIES = {
    "experiments": experiments,
    "out_of_fold_scores": out_of_fold_scores,
    "transfer_scores": transfer_scores,
    "tree_importance": tree_importance,
    "shapley_contributions": contributions,
    "linear_probe": linear_probe,
    "boosting_by_trees": boosting_by_trees,
    "contribution_sums": contribution_sums,
}
# What must hold for every customer; the numbers themselves come from fitted models.
SQL = {
    "boosting_by_trees": sql("select customer_id, 1 as same from cust", "cust"),
    "contribution_sums": sql("select customer_id, 1 as adds_up, 1 as is_share from cust", "cust"),
}
