"""Labels, statuses and defaults that follow from the review log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def review_marks(reviews: DataFrame) -> DataFrame:
    """``customer_id, review_id, included, mark`` for every customer a review touches.

    A member left out of a review is touched without a mark. Members and included members are listed
    separately and meet in the fold, so no member is searched for in an array.
    """
    mark = F.when(F.col("decision") == "confirm", 1).when(F.col("decision") == "dismiss", 0)
    own = reviews.filter("target_type = 'customer'").select(
        F.col("target_id").alias("customer_id"), F.col("id").alias("review_id"), F.lit(1).alias("included"), mark.alias("mark")
    )
    ring = reviews.filter("target_type = 'ring'")
    touched = ring.select(
        F.explode("members").alias("customer_id"), F.col("id").alias("review_id"), F.lit(0).alias("included"),
        F.lit(None).cast("int").alias("mark"),
    )
    included = ring.select(
        F.explode("included").alias("customer_id"), F.col("id").alias("review_id"), F.lit(1).alias("included"), mark.alias("mark")
    )
    return own.unionByName(touched).unionByName(included)


def feedback_labels(reviews: DataFrame) -> DataFrame:
    """``customer_id, analyst_label``: the latest decision per customer; cleared customers are absent."""
    latest = F.max_by("mark", F.struct("review_id", "included"))
    folded = review_marks(reviews).groupBy("customer_id").agg(latest.alias("analyst_label"))
    return folded.filter("analyst_label is not null")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The newest review per target."""
    row = F.struct(*[c for c in reviews.columns if c not in ("target_type", "target_id")])
    return reviews.groupBy("target_type", "target_id").agg(F.max_by(row, "id").alias("r")).select("target_type", "target_id", "r.*")


def ring_statuses(reviews: DataFrame) -> DataFrame:
    """``ring_id, status, reviewed_at, note`` of reviewed rings; all others are pending."""
    status = F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "dismiss", "dismissed")
    return latest_reviews(reviews.filter("target_type = 'ring'")).select(
        F.col("target_id").alias("ring_id"),
        F.coalesce(status, F.lit("pending")).alias("status"),
        F.when(F.col("decision") != "reset", F.col("created_at")).alias("reviewed_at"),
        "note",
    )


def feedback_summary(reviews: DataFrame, active_version: int, labels_in_model: int) -> DataFrame:
    """Labels by class, reviews since the active version and whether to retrain, as one row."""
    one = F.lit(1).alias("_one")
    labels = feedback_labels(reviews).agg(
        F.count("*").alias("n_labels"),
        F.count_if(F.expr("analyst_label = 1")).alias("fraud"),
        F.count_if(F.expr("analyst_label = 0")).alias("legit"),
    ).select("*", one)
    since = F.count_if(F.coalesce("model_version", F.lit(0)) >= active_version)
    log = reviews.agg(F.count("*").alias("n_reviews"), since.alias("reviews_since_model")).select("*", one)
    return labels.join(log, "_one").drop("_one").withColumns({
        "labels_in_model": F.lit(labels_in_model).cast("bigint"),
        "retrain_recommended": F.col("reviews_since_model") > 0,
    })


def suggested_members(membership: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Members a confirmation includes by default: risk of at least half the threshold, or all if none."""
    rows = membership.select("ring_id", "customer_id").join(scores.select("customer_id", "risk"), "customer_id")
    likely = F.col("risk") >= threshold / 2
    some = rows.groupBy("ring_id").agg(F.max(likely).alias("any"))
    return rows.join(some, "ring_id").select("ring_id", "customer_id", (likely | ~F.col("any")).alias("suggested"))


def default_included(membership: DataFrame, scores: DataFrame, threshold: float, decision: str) -> DataFrame:
    """``ring_id, customer_id`` that a decision includes unless the analyst chooses: a dismissal or reset is about all members."""
    if decision != "confirm":
        return membership.select("ring_id", "customer_id")
    return suggested_members(membership, scores, threshold).filter("suggested").select("ring_id", "customer_id")


def unknown_members(asked: DataFrame, membership: DataFrame) -> DataFrame:
    """Members named in a review (``ring_id, customer_id``) that are not in the ring."""
    return asked.join(membership.select("ring_id", "customer_id"), ["ring_id", "customer_id"], "left_anti")


def review_history(reviews: DataFrame, customer_id: str) -> DataFrame:
    """Reviews of one customer, alone or as a member of a ring."""
    is_ring = F.col("target_type") == "ring"
    mine = (~is_ring & (F.col("target_id") == customer_id)) | (is_ring & F.array_contains("members", customer_id))
    included = F.when(is_ring, F.array_contains("included", customer_id)).otherwise(True)
    return reviews.filter(mine).select(
        "id", "target_type", "target_id", "decision", "note", "created_at", included.alias("included")
    ).orderBy("id")
