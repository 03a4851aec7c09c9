"""Counts and checks on data: balance, distributions, integrity, dataset summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.values import equal_width_bin


def class_balance(customers: DataFrame) -> DataFrame:
    return customers.groupBy("label").agg(F.count("*").alias("customers"))


def ring_size_distribution(truth: DataFrame) -> DataFrame:
    sizes = truth.groupBy("ring_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("rings"))


def value_edges(frame: DataFrame, column: str, bins: int) -> list[float]:
    """Edges of equal bins between the smallest and the largest value: one row reaches the driver.

    A column without values gets the bins of 0 to 1, all empty.
    """
    low, high = frame.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        low, high = 0.0, 1.0
    width = (high - low) / bins
    return [low + i * width for i in range(bins)] + [float(high)]


def class_histogram(frame: DataFrame, column: str, bins: int = 20, edges: list[float] | None = None) -> DataFrame:
    """Fraud and legitimate customers per bin of a numeric column; empty bins included."""
    edges = edges or value_edges(frame, column, bins)
    counted = frame.filter(F.col(column).isNotNull()).groupBy(equal_width_bin(F.col(column), edges).alias("bin")).agg(
        F.count_if(F.expr("label = 0")).alias("legitimate"), F.count_if(F.expr("label = 1")).alias("fraud")
    )
    spine = frame.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").fillna(0)


def distribution_gap(frame: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Relative difference of the class means and the mean difference of the binned densities.

    NULL where a measure has no meaning: no relative difference to a mean of 0, no density of a constant column.
    """
    edges = value_edges(frame, column, bins)
    one = F.lit(1).alias("_one")
    means = frame.agg(
        F.avg(F.when(F.col("label") == 0, F.col(column))).alias("legit_mean"),
        F.avg(F.when(F.col("label") == 1, F.col(column))).alias("fraud_mean"),
    )
    relative = F.try_divide(F.abs(F.col("legit_mean") - F.col("fraud_mean")), F.col("legit_mean"))
    histogram = class_histogram(frame, column, bins, edges)
    totals = histogram.agg(F.sum("legitimate").alias("l"), F.sum("fraud").alias("f")).first()
    width = F.lit((edges[-1] - edges[0]) / bins)
    share = F.abs(F.col("legitimate") / (totals["l"] or 1) - F.col("fraud") / (totals["f"] or 1))
    gap = F.sum(F.try_divide(share, width)) / bins
    variation = histogram.agg(gap.alias("total_variation")).select("*", one)
    return means.select(relative.alias("mean_difference"), one).join(variation, "_one").drop("_one")


def shared_values_among_fraud(customers: DataFrame, links: DataFrame) -> DataFrame:
    """Identity values held more than once among fraud customers, counted by type."""
    fraud = customers.filter("label = 1").select("customer_id")
    held = links.join(fraud, "customer_id", "left_semi").groupBy("attribute_type", "attribute_id").agg(F.count("*").alias("n"))
    return held.filter("n > 1").groupBy("attribute_type").agg(F.count("*").alias("values"))


def integrity_report(customers: DataFrame, links: DataFrame) -> DataFrame:
    """Violations per rule; all zero for sound data."""
    one = F.lit(1).alias("_one")
    repeated = customers.groupBy("customer_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("repeated_ids"))
    orphans = links.join(customers.select("customer_id"), "customer_id", "left_anti").agg(F.count("*").alias("orphan_links"))
    legit = links.join(customers.filter("label = 0").select("customer_id"), "customer_id", "left_semi")
    several = legit.groupBy("customer_id", "attribute_type").agg(F.count("*").alias("n")).filter("n > 1").agg(
        F.count("*").alias("several_values_of_a_type")
    )
    rings = customers.filter("truth_ring is not null").select("customer_id", "truth_ring")
    held = links.join(rings, "customer_id").groupBy("truth_ring", "attribute_type", "attribute_id").agg(F.count("*").alias("n"))
    sharing = held.filter("n > 1").select("truth_ring").distinct()
    loose = rings.groupBy("truth_ring").agg(F.count("*").alias("n")).filter("n >= 2").join(sharing, "truth_ring", "left_anti").agg(
        F.count("*").alias("rings_sharing_nothing")
    )
    out = repeated.select("*", one)
    for part in (orphans, several, loose):
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def dataset_summary(customers: DataFrame, links: DataFrame, edges: DataFrame, events: DataFrame | None) -> DataFrame:
    """Row counts and label counts of a dataset, as one row."""
    one = F.lit(1).alias("_one")
    out = customers.agg(
        F.count("*").alias("n_customers"), F.count("label").alias("n_labeled"), F.count_if(F.expr("label = 1")).alias("n_fraud_labels")
    ).select("*", one)
    types = F.array_join(F.array_sort(F.collect_set("attribute_type")), ",")
    out = out.join(links.agg(F.count("*").alias("n_links"), types.alias("attribute_types")).select("*", one), "_one")
    out = out.join(edges.agg(F.count("*").alias("n_edges")).select("*", one), "_one")
    n_events = events.agg(F.count("*").alias("n_events")) if events is not None else customers.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_events"))
    return out.join(n_events.select("*", one), "_one").drop("_one")


def feature_means(frame: DataFrame, features: list[str]) -> DataFrame:
    return frame.groupBy("label").agg(*[F.avg(f).alias(f) for f in features])
