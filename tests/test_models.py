"""Attribution, explanations and the end-to-end plans."""

import pytest
from pyspark.sql import functions as F

from kithgraph.functions.metadata import InputError
from kithgraph.model import Dataset
from kithgraph.operators import attribution as AT, explain as X, features as FT, models as ML, scoring as SC, trees as TR
from kithgraph.plans import analyse as PL, experiment as EX, read as RD
from kithgraph.plans.review import review_customer, review_ring
from kithgraph.operators.edges import identity_edges
from kithgraph.session import durable
from checks import fixtures as fx

SMALL = ML.Learners(boosting_rounds=2, forest_trees=3, depth=2, forest_depth=3, min_leaf=2, parallel=8)


@pytest.fixture(scope="module")
def noise(spark):
    frame = spark.range(400).select(
        F.format_string("c%03d", "id").alias("customer_id"),
        *[F.round(F.randn(seed=i), 3).alias(n) for i, n in enumerate("abcd")], F.lit(1.0).alias("same"),
    )
    return durable(frame.withColumn("label", ((F.col("a") + F.col("b") > 0.5) | (F.col("c") > 1.2)).cast("int")), "noise")


def test_contributions_add_up_to_the_score(spark, noise):
    features = ["a", "b", "c", "d", "same"]
    model = ML.fit(noise, features, ML.Learners(boosting_rounds=15, depth=3, min_leaf=5).boosting())
    baseline = FT.typical_legitimate(noise, features)
    rows = AT.shapley(model, noise, baseline).collect()
    for r in rows:
        assert r["baseline_score"] + sum(r[f"phi_{f}"] for f in features) == pytest.approx(r["risk"], abs=1e-9)
    direct = {r["customer_id"]: r["risk"] for r in model.score(noise).collect()}
    assert all(direct[r["customer_id"]] == pytest.approx(r["risk"]) for r in rows)
    size = {f: sum(abs(r[f"phi_{f}"]) for r in rows) for f in features}
    assert size["same"] == 0 and size["d"] < size["a"]


def test_switched_sets_carry_credits_that_cancel():
    orders = AT.paired_orders(list("abc"), 4)
    sets = AT.switched_sets(orders, list("abc"))
    total = [sum(s["credit"][i] for s in sets) for i in range(3)]
    assert orders[1] == orders[0][::-1] and total == pytest.approx([0, 0, 0])


def explained(spark, **over):
    row = dict(risk=0.97, level="high", degree=5, high_neighbors=3, analyst_label=None)
    row.update(over)
    schema = "risk double, level string, degree long, high_neighbors long, analyst_label int"
    frame = spark.createDataFrame([tuple(row[k] for k in ("risk", "level", "degree", "high_neighbors", "analyst_label"))], schema)
    given = {"network_degree": (5.0, 0.5), "phone_shared_count": (4.0, 0.3), "account_tenure_days": (30.0, -0.05)}
    frame = frame.withColumns({f: F.lit(x) for f, (x, _) in given.items()} | {f"phi_{f}": F.lit(d) for f, (_, d) in given.items()})
    ring = F.lit(None).cast("struct<ring_id:string,size:bigint,n_high:bigint,suspected:boolean,shared_types:array<string>>")
    return X.explain_customers(frame.withColumns({
        "contributions": X.contribution_array(list(given), {}), "ring": ring,
        "shared_counts": F.array(F.struct(F.lit("phone").alias("kind"), F.lit(4).cast("bigint").alias("count"))),
    })).first()


def test_explanation_names_the_largest_factor(spark):
    e = explained(spark)
    assert e["summary"].startswith("High risk (97/100): flagged because it is linked to 5 other accounts")
    assert "shares a phone number with 4 other accounts" in e["summary"]
    assert e["mitigating"][0]["clause"] == "has an account that is 30 days old"
    assert "3 of its 5 linked accounts are rated high risk." in e["context"]
    assert e["top_reason"] == "Is linked to 5 other accounts through shared identity details"


def test_low_risk_explanation_leads_with_what_speaks_for_it(spark):
    e = explained(spark, risk=0.025, level="low", high_neighbors=0, analyst_label=0)
    assert e["score"] == 2  # halves to even
    assert e["summary"].startswith("Low risk (2/100): below the alert threshold. In its favour: it has an account that is 30 days old. Still worth noting:")
    assert e["top_reason"] == "Has an account that is 30 days old"
    assert "An analyst marked this account as legitimate." in e["context"]


@pytest.fixture(scope="module")
def data(spark, sf):
    return Dataset(
        durable(fx.customers(spark, sf)), durable(fx.links(spark, sf)), fx.events(spark, sf), ["income"], {"income": "Income"},
        frozenset({"event_type", "utilization_pct", "credit_limit_at_time"}), "train",
    )


def test_feature_sets_skip_repeats():
    assert list(FT.feature_sets(["t"], ["n"], [])) == ["tabular", "combined"]
    assert FT.feature_sets([], ["n"], ["e"]) == {"network": ["n"], "temporal": ["e"], "combined": ["n", "e"]}
    assert FT.feature_sets(["t"], [], []) == {"combined": ["t"]}
    assert FT.temporal_available({"event_type"})[1:4] == ["purchase_count", "payment_count", "limit_increase_count"]
    with pytest.raises(InputError):
        SC.transfer_features([], [])


def test_out_of_fold_scores_never_see_their_group(spark, data):
    edges = identity_edges(data.links, fx.TYPES)
    table = FT.assemble_features(data, edges, fx.TYPES)
    groups = data.customers.select("customer_id", F.coalesce("truth_ring", "customer_id").alias("group_id"), "label")
    seen = {}

    def watch(model, rows):
        scored = model.score(rows)
        seen[len(seen)] = {r["customer_id"] for r in rows.select("customer_id").collect()}
        return scored.select("customer_id", "risk")

    scores, folds = ML.out_of_fold(durable(table.frame), groups, ["income", "network_degree"], SMALL, watch)
    assert scores.count() == 150 and folds == len(seen)
    parts = list(seen.values())
    assert sum(len(p) for p in parts) == len(set().union(*parts)) == 150


def test_analyse_then_retrain_keeps_ring_ids(spark, data, tmp_path):
    root = str(tmp_path)
    first = PL.analyse(data, root, "d1", learners=SMALL)
    customers = first.table(spark, "customers")
    assert customers.count() == 150 and customers.filter("summary is null or top_reason is null").count() == 0
    drift = first.table(spark, "contributions").join(customers.select("customer_id", "risk", "baseline_score"), "customer_id").select(
        F.abs(F.col("risk") * 100 - F.col("baseline_score") - F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["impact"])).alias("gap")
    ).agg(F.max("gap")).first()[0]
    assert drift < 0.5
    run = first.table(spark, "runs").first()
    assert run["mode"] == "supervised" and run["eval_n"] == 150 and first.table(spark, "experiments").count() == 8
    ring = first.table(spark, "ring_members").filter("ring_id = 'R-0001'").select("customer_id").collect()
    members = [r[0] for r in ring]
    reviews = spark.createDataFrame(
        [(1, "ring", "R-0001", "confirm", "", members, members, None, 1)],
        "id long, target_type string, target_id string, decision string, note string, members array<string>, included array<string>, created_at timestamp, model_version int",
    )
    second = PL.retrain(spark, root, "d1", reviews, learners=SMALL)
    assert second.version == 2
    row = second.table(spark, "runs").first()
    assert row["n_feedback"] == len(members) and row["level_changes"] is not None and row["previous_roc_auc"] is not None
    a, b = [v.table(spark, "ring_members").select("ring_id", "customer_id") for v in (first, second)]
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    view = RD.overview(spark, second, reviews)
    assert view["top_customers"].count() == 10 and view["histogram"].agg(F.sum("count")).first()[0] == 150
    assert view["feedback"].first()["fraud"] == len(members)
    detail = RD.ring_detail(spark, second, reviews, "R-0001")
    assert detail["ring"].first()["status"] == "confirmed" and detail["members"].count() == len(members)
    assert detail["history"].count() == 1 and set(members) <= {r[0] for r in detail["nodes"].select("customer_id").collect()}
    person = RD.customer_detail(spark, second, reviews, members[0], data.events)
    assert person["customer"].first()["analyst_label"] == 1 and not person["connections"].isEmpty() and not person["attributes"].isEmpty()
    assert person["ring"].first()["ring_id"] == "R-0001" and person["reviews"].count() == 1
    with pytest.raises(InputError):
        RD.customer_detail(spark, second, reviews, "nobody")
    shown = RD.network(spark, second, reviews, suspected_only=False, max_nodes=100)
    assert 0 < shown["nodes"].count() <= 100 and not shown["edges"].isEmpty()
    assert [r["version"] for r in RD.history(spark, second).collect()] == [1, 2]

    stored = RD.quality_of_scores(spark, second)
    assert set(stored) == {"at_k", "pr_curve", "roc_curve", "levels", "hubs", "group_importance", "experiments"}
    assert {r["k"] for r in stored["at_k"].collect()} == {25, 50, 100} and stored["levels"].agg(F.sum("customers")).first()[0] == 150
    assert stored["roc_curve"].agg(F.max("tpr")).first()[0] == 1.0 and stored["pr_curve"].count() > 10
    assert row["n_nodes"] == 150 and row["edges_phone"] + row["edges_email"] > 0
    assert [(r["dataset_id"], r["active_version"]) for r in RD.datasets(spark, root).collect()] == [("d1", 2)]
    assert RD.customer_list(spark, second, reviews, q=members[0])["total"].first()[0] == 1
    assert RD.ring_list(spark, second, reviews, scope="all")["counts"].first()["confirmed"] == 1
    around = RD.customer_graph(spark, second, reviews, members[0])
    assert around["nodes"].filter("hop = 0").count() == 1 and not around["edges"].isEmpty()
    assert RD.export(spark, second, reviews).count() == 150
    act = review_ring(spark, second, "R-0001", "dismiss", note="known family")
    assert act["status"].first()["status"] == "dismissed" and act["included"].count() == len(members)
    assert review_customer(spark, second, members[0], "confirm").first()["fraud"] == 1
    with pytest.raises(InputError):
        PL.analyse(data, root, "d1", learners=SMALL)
    with pytest.raises(InputError):
        PL.retrain(spark, root, "nothing", reviews)


def test_unlabelled_data_is_scored_by_transfer(spark, data, tmp_path):
    hidden = Dataset(data.customers.withColumn("label", F.lit(None).cast("int")).withColumn("truth_ring", F.lit(None).cast("string")), data.links)
    edges = durable(identity_edges(data.links, fx.TYPES))
    version = PL.analyse(hidden, str(tmp_path), "d2", reference=(data, edges), learners=SMALL)
    assert version.table(spark, "runs").first()["mode"] == "transfer"
    assert version.table(spark, "customers").filter("risk between 0 and 1").count() == 150
    assert spark.read.parquet(f"{tmp_path}/calibration").count() == 1


def test_experiment_writes_every_step(spark, data, tmp_path):
    rows = EX.experiment(data, str(tmp_path), SMALL)
    assert rows.count() == 8
    for name in ("split", "split_report", "edges", "features", "connectivity", "predictions/random_forest_combined", "importance/gradient_boosting_tabular"):
        assert not spark.read.parquet(f"{tmp_path}/{name}").isEmpty()


def test_trees_read_back_score_like_the_model(spark, data):
    table = FT.assemble_features(data, identity_edges(data.links, fx.TYPES), fx.TYPES)
    frame = durable(table.frame.join(data.customers.select("customer_id", "label"), "customer_id"))
    features = ["income", "network_degree", "shared_attribute_count"]
    model = ML.fit(frame, features, SMALL.boosting())
    nodes = TR.tree_table(model, spark)
    inner, leaves = nodes.filter("leaf is null").count(), nodes.filter("leaf is not null").count()
    trees = nodes.select("tree").distinct().count()
    assert leaves == inner + trees and nodes.filter("leaf is null and (feature is null or left is null or right is null)").count() == 0
    walked = TR.score_by_trees(nodes, frame.select("customer_id", *features), TR.depth_of(model))
    both = model.score(frame).select("customer_id", "risk").join(walked.withColumnRenamed("risk", "w"), "customer_id")
    assert both.count() == 150 and both.agg(F.max(F.abs(F.col("risk") - F.col("w")))).first()[0] < 1e-9


def test_registered_queries_use_the_full_learners():
    from checks import learned

    assert learned.LEARNERS == ML.Learners()
