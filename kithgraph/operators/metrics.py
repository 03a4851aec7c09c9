"""Score metrics from cumulative counts per distinct score.

Input is ``customer_id, risk, label`` with label 0 or 1. Rows are first grouped by score, and the
running counts come from range-partitioned prefix sums, so no task sees the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import settings
from ..functions.values import equal_width_bin, risk_level, unit_edges
from .ordered import with_rank, with_running_sums


def score_steps(scored: DataFrame) -> DataFrame:
    """One row per distinct score, highest first: counts here and at or above it."""
    per_score = scored.filter("label is not null").groupBy("risk").agg(
        F.count_if(F.expr("label = 1")).alias("pos"), F.count_if(F.expr("label = 0")).alias("neg")
    )
    return with_running_sums(per_score, [F.desc("risk")], {"tp": "pos", "fp": "neg"}, rank="step")


def _totals(steps: DataFrame):
    row = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count("*").alias("k")).first()
    return int(row["p"] or 0), int(row["n"] or 0), int(row["k"])


def best_f1_threshold(steps: DataFrame) -> float:
    """The score with the largest F1 when used as threshold, the lowest of equals; 0.5 for one class."""
    p, n, _ = _totals(steps)
    if not p or not n:
        return 0.5
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.col("tp") / p
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return steps.select("risk", f1.alias("f1")).orderBy(F.desc("f1"), F.asc("risk")).first()["risk"]


def ranking_quality(steps: DataFrame) -> DataFrame:
    """ROC-AUC (ties count half) and average precision, as one row."""
    p, n, _ = _totals(steps)
    both = bool(p and n)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)) / (p * n if both else 1)
    average = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / (p or 1)
    none = F.lit(None).cast("double")
    return steps.agg((area if both else none).alias("roc_auc"), (average if both else none).alias("pr_auc"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Counts at the threshold and the rates from them, as one row."""
    high, fraud = F.col("risk") >= threshold, F.col("label") == 1
    row = scored.filter("label is not null").agg(
        F.count("*").alias("n"), F.count_if(fraud).alias("n_positive"),
        F.count_if(~high & ~fraud).alias("tn"), F.count_if(high & ~fraud).alias("fp"),
        F.count_if(~high & fraud).alias("fn"), F.count_if(high & fraud).alias("tp"),
    )
    zero = F.lit(0.0)
    return row.withColumns({
        "threshold": F.lit(float(threshold)),
        "accuracy": F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("n")), zero),
        "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero),
        "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero),
        "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero),
    })


def classification_metrics(scored: DataFrame, threshold: float, steps: DataFrame | None = None) -> DataFrame:
    steps = score_steps(scored) if steps is None else steps
    one = F.lit(1).alias("_one")
    return confusion(scored, threshold).select("*", one).join(ranking_quality(steps).select("*", one), "_one").drop("_one")


def at_k(scored: DataFrame, ks: list[int] = settings.AT_K) -> DataFrame:
    """Precision and recall among the K highest scores, for every K up to the number of rows.

    Only the rows of the largest K are needed, so this is a top-k and not a full ranking.
    """
    labelled = scored.filter("label is not null")
    counts = labelled.agg(F.count("*").alias("n"), F.count_if(F.expr("label = 1")).alias("p")).first()
    usable = [k for k in ks if k <= counts["n"]]
    positives = max(int(counts["p"]), 1)
    spark = scored.sparkSession
    if not usable:
        return spark.createDataFrame([], "k int, precision double, recall double")
    top = labelled.orderBy(F.desc("risk"), "customer_id").limit(max(usable)).select("risk", "customer_id", "label")
    # The top list is as short as the largest K, so ranking it in one task is safe.
    ranked = top.withColumn("n", F.expr("row_number() over (order by risk desc, customer_id)"))
    wanted = F.explode(F.filter(F.array(*[F.lit(k) for k in usable]), lambda k: k >= F.col("n")))
    return ranked.select(wanted.alias("k"), "label").groupBy("k").agg(
        (F.count_if(F.expr("label = 1")) / F.col("k")).alias("precision"),
        (F.count_if(F.expr("label = 1")) / F.lit(positives)).alias("recall"),
    )


def thinned(rows: DataFrame, index: str, n: int, points: int = settings.CURVE_POINTS) -> DataFrame:
    """At most ``points`` evenly spaced rows of ``n`` rows numbered from 0 in ``index``."""
    if n <= points:
        return rows
    spots = sorted({round(i * (n - 1) / (points - 1)) for i in range(points)})
    return rows.filter(F.col(index).isin(spots))


def _origin(steps: DataFrame, **values: float) -> DataFrame:
    """The point that opens a curve, at index 0."""
    point = steps.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("i"))
    return point.withColumns({name: F.lit(float(v)) for name, v in values.items()})


def pr_curve(steps: DataFrame, points: int = settings.CURVE_POINTS) -> DataFrame:
    """Recall and precision from the highest score down, opened by the point (0, 1), thinned."""
    p, _, k = _totals(steps)
    curve = steps.select(
        F.col("step").alias("i"), (F.col("tp") / (p or 1)).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )
    return thinned(_origin(steps, recall=0, precision=1).unionByName(curve), "i", k + 1, points)


def roc_curve(steps: DataFrame, points: int = settings.CURVE_POINTS) -> DataFrame:
    """False and true positive rate from the highest score down, opened by (0, 0), thinned.

    A step with the same counts as the next one lies on a straight line and is left out first; the
    next step is met by an equi-join on the step number.
    """
    p, n, k = _totals(steps)
    following = steps.select((F.col("step") - 1).alias("step"), F.col("pos").alias("pos2"), F.col("neg").alias("neg2"))
    bends = (F.col("pos") != F.col("pos2")) | (F.col("neg") != F.col("neg2"))
    corners = steps.join(following, "step", "left").filter((F.col("step").isin(1, k)) | bends)
    numbered = with_rank(corners.select("step", "tp", "fp"), [F.asc("step")], "i")
    kept = numbered.agg(F.count("*").alias("n")).first()["n"]
    curve = numbered.select("i", (F.col("fp") / (n or 1)).alias("fpr"), (F.col("tp") / (p or 1)).alias("tpr"))
    return thinned(_origin(steps, fpr=0, tpr=0).unionByName(curve), "i", kept + 1, points)


def risk_ranks(scored: DataFrame) -> DataFrame:
    """Rank of every customer by score, ties by id."""
    return with_rank(scored, [F.desc("risk"), F.asc("customer_id")])


def risk_histogram(scored: DataFrame, bins: int = settings.HISTOGRAM_BINS) -> DataFrame:
    """Customers, fraud and legitimate per equal bin of [0, 1], empty bins included."""
    edges = unit_edges(bins)
    counted = scored.groupBy(equal_width_bin(F.col("risk"), edges).alias("bin")).agg(
        F.count("*").alias("count"), F.count_if(F.expr("label = 1")).alias("fraud"), F.count_if(F.expr("label = 0")).alias("legit")
    )
    spine = scored.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, start double, end double"
    )
    return spine.join(counted, "bin", "left").fillna(0, ["count", "fraud", "legit"])


def level_counts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.groupBy(risk_level(F.col("risk"), threshold).alias("level")).agg(F.count("*").alias("customers"))


def evaluation_on_labels(scored: DataFrame, reviewed: DataFrame, threshold: float) -> DataFrame | None:
    """Metrics on hidden labels without the customers an analyst reviewed; None without both classes."""
    fresh = scored.filter("label is not null").join(reviewed.select("customer_id"), "customer_id", "left_anti")
    if fresh.select("label").distinct().count() < 2:
        return None
    return classification_metrics(fresh, threshold)


def same_customers_before(evaluated: DataFrame, previous: DataFrame, threshold: float) -> DataFrame | None:
    """Metrics of the previous version on exactly these customers; None unless it scored them all."""
    old = previous.select("customer_id", "risk")
    if not evaluated.join(old, "customer_id", "left_anti").isEmpty():
        return None
    return classification_metrics(evaluated.select("customer_id", "label").join(old, "customer_id"), threshold)


def version_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Customers (``customer_id, level, risk``) whose level or score moved between two versions, as one row."""
    old = before.select("customer_id", F.col("level").alias("old_level"), F.col("risk").alias("old_risk"))
    return now.join(old, "customer_id").agg(
        F.count_if(F.expr("level <> old_level")).alias("level_changes"),
        F.count_if(F.expr("level = 'high' and old_level <> 'high'")).alias("newly_high"),
        F.count_if(F.expr("level <> 'high' and old_level = 'high'")).alias("no_longer_high"),
        F.coalesce(F.avg(F.abs(F.col("risk") - F.col("old_risk"))), F.lit(0.0)).alias("mean_abs_score_change"),
    )


def ring_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rings (``ring_id, suspected``) that became suspected or were cleared, as one row."""
    old = before.select("ring_id", F.col("suspected").alias("was"))
    was = F.coalesce("was", F.lit(False))
    return now.join(old, "ring_id", "left").agg(
        F.count_if(F.col("suspected") & ~was).alias("rings_newly_suspected"),
        F.count_if(~F.col("suspected") & was).alias("rings_cleared"),
    )


def repeated_runs(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over the repeats of an experiment."""
    return results.groupBy("model", "experiment").agg(
        *[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))]
    )


def side_by_side(rows: list[DataFrame]) -> DataFrame:
    """One-row frames as one row."""
    keyed = [r.withColumn("_one", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
