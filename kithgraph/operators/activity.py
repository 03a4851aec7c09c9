"""Behaviour features from the event log.

Everything is computed from one row per customer and calendar day. That table is built with partial
aggregation, so a customer holding a third of all events still sends one row per day to the next
stage, and the windows below see at most as many rows per customer as there are days in the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import settings


def daily_activity(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy("customer_id", F.unix_date(F.to_date("event_date")).alias("day")).agg(
        F.count("*").alias("n"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if(kind == "payment").alias("payments"),
        F.count_if(kind == "credit_limit_increase").alias("increases"),
        F.sum("utilization_pct").alias("util_sum"),
        F.min("utilization_pct").alias("util_min"),
        F.max("utilization_pct").alias("util_max"),
        F.max("credit_limit_at_time").alias("limit_max"),
    )


def temporal_features(events: DataFrame) -> DataFrame:
    days = Window.partitionBy("customer_id").orderBy("day")
    week = days.rangeBetween(0, settings.WINDOW_DAYS - 1)
    daily = (
        daily_activity(events)
        .withColumn("n_week", F.sum("n").over(week))
        # A day with two or more events has a gap of zero inside it.
        .withColumn("gap", F.when(F.col("n") > 1, 0).otherwise(F.col("day") - F.lag("day").over(days)))
    )
    total = F.sum("n")
    covered = F.max("day") - F.min("day")
    span = F.greatest(covered, F.lit(1))
    return daily.groupBy("customer_id").agg(
        total.alias("total_event_count"),
        F.sum("purchases").alias("purchase_count"),
        F.sum("payments").alias("payment_count"),
        F.sum("increases").alias("limit_increase_count"),
        F.count("*").alias("distinct_event_dates"),
        span.cast("bigint").alias("event_span_days"),
        (total / span * 30).alias("events_per_30_days"),
        F.max("n").alias("max_events_single_day"),
        F.max("n_week").alias("max_events_7d"),
        F.coalesce(F.min("gap"), span).cast("bigint").alias("min_days_between_events"),
        # Gaps telescope: their sum is the covered span, so their mean needs no per-event window.
        F.when(total > 1, covered / (total - 1)).otherwise(span.cast("double")).alias("mean_days_between_events"),
        (F.sum("util_sum") / total).alias("mean_utilization_pct"),
        F.max("util_max").alias("max_utilization_pct"),
        (F.max("util_max") - F.min("util_min")).alias("utilization_range"),
        F.max("limit_max").cast("bigint").alias("max_credit_limit"),
    )
