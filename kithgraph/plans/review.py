"""Reviewing a ring or an account as one act: defaults, checks, and the entry in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metadata import InputError
from ..operators import feedback as fb
from ..sources.reviews import REVIEW, ReviewLog
from .analyse import Version

DECISIONS = ["confirm", "dismiss", "reset"]


def _checked(decision: str) -> str:
    if decision not in DECISIONS:
        raise InputError(f"A decision is one of {', '.join(DECISIONS)}.")
    return decision


def ring_review(
    membership: DataFrame, scores: DataFrame, threshold: float, ring_id: str, decision: str, include: list[str] | None = None,
    note: str = "", model_version: int = 1,
) -> DataFrame:
    """The review of one ring as one row of the log.

    Without a choice a confirmation takes the members that ``suggested_members`` names, any other decision takes all. A choice
    may name members only, and at least one unless the decision is a reset. Members are listed in their order in the ring; the
    lists are as long as a person's decision on one ring.
    """
    spark = membership.sparkSession
    mine = membership.filter(F.col("ring_id") == ring_id)
    if mine.isEmpty():
        raise InputError("There is no such ring.")
    if include is None:
        chosen = fb.default_included(mine, scores, threshold, _checked(decision))
    else:
        asked = spark.createDataFrame([(ring_id, c) for c in include], "ring_id string, customer_id string")
        if not fb.unknown_members(asked, mine).isEmpty():
            raise InputError("A review may include members of the ring only.")
        if not include and _checked(decision) != "reset":
            raise InputError("A review needs at least one member.")
        chosen = asked.distinct()
    marked = mine.join(chosen.select("customer_id").withColumn("_in", F.lit(True)), "customer_id", "left")
    place = F.col("position") if "position" in mine.columns else F.col("customer_id")
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), "customer_id", F.coalesce("_in", F.lit(False)).alias("in_"))))
    row = marked.agg(listed.alias("all"))
    return row.select(
        F.lit("ring").alias("target_type"), F.lit(ring_id).alias("target_id"), F.lit(_checked(decision)).alias("decision"), F.lit(note).alias("note"),
        F.transform("all", lambda m: m["customer_id"]).alias("members"),
        F.transform(F.filter("all", lambda m: m["in_"]), lambda m: m["customer_id"]).alias("included"),
        F.current_timestamp().alias("created_at"), F.lit(model_version).alias("model_version"),
    )


def review_ring(
    spark: SparkSession, version: Version, ring_id: str, decision: str, include: list[str] | None = None, note: str = ""
) -> dict[str, DataFrame]:
    """Log a decision on a ring of a stored version; its status, who is included, and the summary of all feedback."""
    run = version.table(spark, "runs").first()
    scores = version.table(spark, "customers").select("customer_id", "risk")
    membership = version.table(spark, "ring_members").select("ring_id", "customer_id", "position")
    row = ring_review(membership, scores, run["alert_threshold"], ring_id, decision, include, note, version.version)
    log = ReviewLog(spark, version.root, version.dataset_id)
    first = log.append(row)
    reviews = log.read()
    return {
        "included": reviews.filter(F.col("id") == first).select(F.explode("included").alias("customer_id")),
        "status": fb.ring_statuses(reviews).filter(F.col("ring_id") == ring_id),
        "feedback": fb.feedback_summary(reviews, version.version, run["n_feedback"]),
    }


def review_customer(spark: SparkSession, version: Version, customer_id: str, decision: str, note: str = "") -> DataFrame:
    """Log a decision on one account of a stored version; the summary of all feedback."""
    if version.table(spark, "customers").filter(F.col("customer_id") == customer_id).isEmpty():
        raise InputError("There is no such account.")
    row = spark.createDataFrame(
        [("customer", customer_id, _checked(decision), note, [customer_id], [customer_id], None, version.version)], REVIEW
    ).withColumn("created_at", F.current_timestamp())
    log = ReviewLog(spark, version.root, version.dataset_id)
    log.append(row)
    return fb.feedback_summary(log.read(), version.version, version.table(spark, "runs").first()["n_feedback"])
