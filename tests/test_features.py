"""Behaviour features, ordered helpers, medians, metrics, feedback and folds."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import activity as A, feedback as FB, medians as MD, metrics as M, ordered as O, splits as S
from kithgraph.sources import sinks


def test_behaviour_golden_values(spark):
    rows = [
        ("a", "2025-01-01", "purchase", 0.1, 1000.0), ("a", "2025-01-03", "payment", 0.2, 1000.0), ("a", "2025-01-20", "purchase", 0.9, 1500.0),
        ("b", "2025-02-01", "purchase", 0.5, 2000.0), ("b", "2025-02-01", "credit_limit_increase", 0.4, 2500.0), ("c", "2025-03-05", "payment", 0.3, 800.0),
    ]
    events = spark.createDataFrame(rows, "customer_id string, event_date string, event_type string, utilization_pct double, credit_limit_at_time double")
    got = {r["customer_id"]: r for r in A.temporal_features(events.withColumn("event_date", F.col("event_date").cast("timestamp"))).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["total_event_count"], a["max_events_7d"], a["min_days_between_events"], a["mean_days_between_events"]) == (3, 2, 2, 9.5)
    assert a["utilization_range"] == pytest.approx(0.8) and a["max_credit_limit"] == 1500
    assert (b["max_events_single_day"], b["event_span_days"], b["min_days_between_events"], b["mean_days_between_events"]) == (2, 1, 0, 0.0)
    assert (c["min_days_between_events"], c["mean_days_between_events"]) == (1, 1.0)


def test_hot_customer_still_gives_exact_week_counts(spark):
    draw = random.Random(1)
    days = sorted(draw.randrange(120) for _ in range(800))
    rows = [("hot", d) for d in days] + [(f"c{i}", draw.randrange(120)) for i in range(400)]
    events = spark.createDataFrame(rows, "customer_id string, day int").select(
        "customer_id", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)").alias("event_date"), F.lit("purchase").alias("event_type"),
        F.lit(0.5).alias("utilization_pct"), F.lit(1.0).alias("credit_limit_at_time"),
    )
    got = A.temporal_features(events).filter("customer_id = 'hot'").first()
    assert got["max_events_7d"] == max(sum(d <= e <= d + 6 for e in days) for d in days)
    assert got["mean_days_between_events"] == pytest.approx((days[-1] - days[0]) / 799)


def test_ranks_and_running_sums_with_ties_and_a_hot_group(spark):
    draw = random.Random(2)
    rows = [(f"i{i:04d}", draw.choice(["big"] * 5 + ["a", "b"]), draw.choice([0.1, 0.5, 0.5, 0.9]), draw.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, g string, x double, v int").repartition(6)
    by_rank = sorted(rows, key=lambda r: (-r[2], r[0]))
    got = {r["id"]: r["rank"] for r in O.with_rank(df, [F.desc("x"), F.asc("id")]).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(by_rank)}
    inside = {r["id"]: r["position"] for r in O.with_rank_within(df, ["g"], [F.desc("x"), F.asc("id")]).collect()}
    seen, expected = {}, {}
    for r in by_rank:
        seen[r[1]] = expected[r[0]] = seen.get(r[1], 0) + 1
    assert inside == expected
    running = {r["id"]: r["total"] for r in O.with_running_sums(df, [F.desc("x"), F.asc("id")], {"total": "v"}).collect()}
    total, sums = 0, {}
    for r in by_rank:
        total += r[3]
        sums[r[0]] = total
    assert running == sums


def test_medians_are_exact(spark):
    draw = random.Random(4)
    rows = [(draw.choice([1.0, 2.0, 7.5, None]), draw.gauss(0, 1), None) for _ in range(501)]
    got = MD.medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert got == {"a": statistics.median(r[0] for r in rows if r[0] is not None), "b": statistics.median(r[1] for r in rows), "c": None}


def scored(spark, rows):
    return spark.createDataFrame([(f"c{i:03d}", float(r), l) for i, (r, l) in enumerate(rows)], "customer_id string, risk double, label int")


def test_metrics_match_brute_force(spark):
    draw = random.Random(6)
    rows = [(draw.choice([0.1, 0.2, 0.4, 0.6, 0.8]), int(draw.random() < 0.3)) for _ in range(120)]
    df = scored(spark, rows)
    steps = M.score_steps(df)
    pos, neg = [r for r, l in rows if l], [r for r, l in rows if not l]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = M.classification_metrics(df, 0.6, steps).first()
    assert got["roc_auc"] == pytest.approx(auc)
    ap, last = 0.0, 0
    for t in sorted({r for r, _ in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(r >= t for r, _ in rows)
        ap += (tp - last) / len(pos) * tp / n
        last = tp
    assert got["pr_auc"] == pytest.approx(ap)
    f1 = {t: 2 * sum(p >= t for p in pos) / (sum(r >= t for r, _ in rows) + len(pos)) for t in {r for r, _ in rows}}
    best = max(f1.values())
    assert M.best_f1_threshold(steps) == min(t for t, x in f1.items() if x >= best - 1e-12)
    assert {r["k"] for r in M.at_k(df).collect()} == {25, 50, 100}


def test_one_class_has_no_areas(spark):
    df = scored(spark, [(0.2, 0), (0.7, 0)])
    steps = M.score_steps(df)
    got = M.classification_metrics(df, 0.5, steps).first()
    assert got["roc_auc"] is None and got["pr_auc"] is None and got["recall"] == 0.0
    assert M.best_f1_threshold(steps) == 0.5


REVIEW = "id long, target_type string, target_id string, decision string, note string, members array<string>, included array<string>, created_at timestamp, model_version int"


def test_latest_decision_wins_and_excluded_members_are_cleared(spark):
    log = [
        (1, "ring", "R-1", "confirm", None, ["a", "b", "c"], ["a", "b"], None, 1),
        (2, "customer", "b", "dismiss", None, ["b"], ["b"], None, 1),
        (3, "customer", "c", "confirm", None, ["c"], ["c"], None, 1),
        (4, "ring", "R-1", "confirm", "n", ["a", "b", "c"], ["a", "b"], None, 2),
        (5, "customer", "a", "reset", None, ["a"], ["a"], None, 2),
    ]
    reviews = spark.createDataFrame(log, REVIEW)
    assert {r[0]: r[1] for r in FB.feedback_labels(reviews).collect()} == {"b": 1}
    status = FB.ring_statuses(reviews).first()
    assert (status["ring_id"], status["status"], status["note"]) == ("R-1", "confirmed", "n")
    row = FB.feedback_summary(reviews, 2, 1).first()
    assert (row["n_labels"], row["fraud"], row["n_reviews"], row["reviews_since_model"], row["retrain_recommended"]) == (1, 1, 5, 2, True)


def test_folds_keep_groups_whole_and_spread_fraud(spark):
    draw = random.Random(8)
    rows = [(f"c{i:03d}", f"g{draw.randrange(60):02d}", None) for i in range(240)]
    rows = [(c, g, int(int(g[1:]) % 4 == 0)) for c, g, _ in rows]
    df = spark.createDataFrame(rows, "customer_id string, group_id string, label int")
    folds = S.fold_count(df)
    assigned = {r["group_id"]: r["fold"] for r in S.stratified_folds(df, folds).collect()}
    assert folds == 5 and set(assigned.values()) == set(range(5)) and set(assigned) == {g for _, g, _ in rows}
    fraud = [sum(1 for g, f in assigned.items() if f == k and int(g[1:]) % 4 == 0) for k in range(5)]
    assert max(fraud) - min(fraud) <= 1
    sides = S.split_by_group(df)
    assert sides.groupBy("group_id").agg(F.count_distinct("side").alias("n")).filter("n > 1").count() == 0


def test_result_tables_replace_one_version_only(spark, tmp_path):
    root = str(tmp_path)
    frame = spark.createDataFrame([("a", 1)], "customer_id string, x int")
    for dataset, version in (("d1", 1), ("d1", 2), ("d2", 1)):
        sinks.write_result(frame, root, "t", dataset, version)
    sinks.write_result(frame.withColumn("x", F.lit(9)), root, "t", "d1", 2)
    rows = {(r["dataset_id"], r["version"]): r["x"] for r in spark.read.parquet(f"{root}/t").collect()}
    assert rows == {("d1", 1): 1, ("d1", 2): 9, ("d2", 1): 1}
    assert sinks.delete_dataset(spark, root, "t", "d1")
    assert {r["dataset_id"] for r in spark.read.parquet(f"{root}/t").collect()} == {"d2"}


def test_export_guards_formulas(spark, tmp_path):
    row = [("=c", "+n", 0.987, "high", 1, None, 3, 1, "-x")]
    frame = spark.createDataFrame(row, "customer_id string, name string, risk double, risk_level string, rank long, ring_id string, degree long, analyst_label int, summary string")
    out = sinks.customer_export(frame)
    assert list(out.first()) == ["'=c", "'+n", 98.7, "high", 1, "", 3, "fraud", "'-x"]
    sinks.write_csv(out, str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).columns[:3] == ["customer_id", "name", "risk_score"]
