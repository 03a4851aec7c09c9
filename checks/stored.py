"""Datasets, versions and reviews, written to a shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kithgraph.operators import feedback as FB
from kithgraph.operators.rings import members_in_order
from kithgraph.plans.analyse import ranked_tables
from kithgraph.plans.review import ring_review
from kithgraph.session import durable, shared_folder
from kithgraph.sources.catalog import Catalog
from kithgraph.sources.reviews import ReviewLog
from kithgraph.sources.sinks import write_result

from . import fixtures as fx
from .fixtures import rounded, sql

T = 0.6
# The market segments of the customer table, each of which is one dataset here.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Datasets with a second version that was published, and one whose second version was not.
SECOND, UNFINISHED = ["BUILDING", "MACHINERY"], "FURNITURE"
RINGS = ["R-0001", "R-0002", "R-0003"]


def catalog(spark, d):
    """Every segment as a dataset: version 1 holds all accounts, version 2 those with a positive balance."""
    root = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    c = fx.table(spark, d, "customer").select(
        fx.cid(F.col("c_custkey")).alias("customer_id"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("dataset_id")
    )
    later = c.filter((F.col("balance") > 0) & F.col("dataset_id").isin([*SECOND, UNFINISHED]))
    both = c.withColumn("version", F.lit(1)).unionByName(later.withColumn("version", F.lit(2)))
    both.write.partitionBy("dataset_id", "version").parquet(f"{root}/customers")
    found = Catalog(spark, root)
    for dataset in SEGMENTS:
        for version in (1, 2) if dataset in SECOND else (1,):
            found.publish(dataset, version, ["customers"], name=dataset.title())
    return found


def _counted(found):
    """The list of datasets with what their active version holds."""
    listed = durable(found.datasets(), "datasets")
    parts = [found.read("customers", r["dataset_id"]).select("dataset_id", "version", "balance") for r in listed.select("dataset_id").collect()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    held = rows.groupBy("dataset_id", "version").agg(F.count("*").alias("customers"), F.round(F.sum("balance"), 2).alias("balance"))
    same = (listed["dataset_id"] == held["dataset_id"]) & (listed["active_version"] == held["version"])
    return listed.join(held, same, "left").select(listed["dataset_id"], "name", "active_version", "customers", "balance")


def stored_datasets(spark, d):
    """A version that was written and not published is read by nobody."""
    return _counted(catalog(spark, d))


def deleted_dataset(spark, d):
    """What is left, in the list and on disk, of all datasets when one is deleted and unpublished versions are swept."""
    found = catalog(spark, d)
    ReviewLog(spark, found.root, "HOUSEHOLD").append(fx.reviews(spark, d))
    found.delete("HOUSEHOLD")
    found.sweep(UNFINISHED)
    kept = spark.read.parquet(f"{found.root}/customers").groupBy(F.col("dataset_id").alias("_d")).agg(F.count("*").alias("rows_on_disk"))
    gone = ReviewLog(spark, found.root, "HOUSEHOLD").read().count()
    listed = _counted(found)
    return listed.join(kept, listed["dataset_id"] == kept["_d"]).drop("_d", "balance").withColumn("reviews_of_deleted", F.lit(gone).cast("bigint"))


def review_log(spark, d):
    """All reviews appended in two batches, ring reviews first: ids follow the batches and, inside one, the time."""
    log = ReviewLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", "all")
    given = durable(fx.reviews(spark, d), "reviews")
    for kind in ("ring", "customer"):
        log.append(given.filter(F.col("target_type") == kind))
    return log.read().select("id", "target_type", "target_id", "decision", "note", F.size("members").alias("n_members"), F.size("included").alias("n_included"))


def labels_from_log(spark, d):
    """The labels that follow from the stored log are those of the reviews as given."""
    log = ReviewLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", "all")
    log.append(fx.reviews(spark, d))
    return FB.feedback_labels(log.read()).select("customer_id", F.col("analyst_label").cast("int").alias("analyst_label"))


def ring_reviews(spark, d):
    """One decision of each kind on three rings without a choice of members: who is included, in the order of the ring."""
    membership, scores = fx.membership(spark, d), fx.scores(spark, d).select("customer_id", "risk")
    placed = durable(members_in_order(membership, scores).select("ring_id", "customer_id", "position"), "placed")
    acts = [ring_review(placed, scores, T, ring, decision) for ring, decision in zip(RINGS, ("confirm", "dismiss", "reset"), strict=True)]
    rows = acts[0].unionByName(acts[1]).unionByName(acts[2])
    return rows.select("target_id", "decision", F.array_join("members", ",").alias("members"), F.array_join("included", ",").alias("included"))


def stored_at_k(spark, d):
    """Precision and recall among the first K, read back from a version that holds them with both curves."""
    root = f"{shared_folder(spark)}/curves-{uuid.uuid4().hex}"
    scored = fx.scored(spark, d).select("customer_id", "label", "risk").filter("label is not null")
    tables = ranked_tables(scored)
    for name, frame in tables.items():
        write_result(frame, root, name, "d", 1)
    found = Catalog(spark, root)
    found.publish("d", 1, list(tables))
    return rounded(found.read("at_k", "d").select(F.col("k").cast("bigint").alias("k"), "precision", "recall"))


QUERIES = {
    "stored_datasets": stored_datasets,
    "deleted_dataset": deleted_dataset,
    "review_log": review_log,
    "labels_from_log": labels_from_log,
    "ring_reviews": ring_reviews,
    "stored_at_k": stored_at_k,
}

_ACTIVE = f"""
    select c_mktsegment as dataset_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as name,
           case when c_mktsegment in {tuple(SECOND)} then 2 else 1 end as active_version, count(*) as customers, round(sum(c_acctbal::double), 2) as balance
    from customer where c_mktsegment not in {tuple(SECOND)} or c_acctbal > 0 group by 1"""

SQL = {
    "stored_datasets": _ACTIVE,
    "deleted_dataset": f"""
        select a.* exclude (balance), rows_on_disk, 0::bigint as reviews_of_deleted from ({_ACTIVE}) a join (
          select c_mktsegment as dataset_id, count(*) + case when c_mktsegment in {tuple(SECOND)} then count(*) filter (c_acctbal > 0) else 0 end as rows_on_disk
          from customer group by 1) using (dataset_id) where dataset_id <> 'HOUSEHOLD'""",
    "review_log": sql("""
        select row_number() over (order by target_type desc, created_at, target_id) as id, target_type, target_id, decision, note,
               len(members)::int as n_members, coalesce(len(included), 0)::int as n_included from rev""", "rev"),
    "labels_from_log": sql("select customer_id, analyst_label from lab", "lab"),
    "ring_reviews": sql(f"""
        , placed as (select ring_id, customer_id, risk, row_number() over (partition by ring_id order by risk desc, customer_id) as position,
                            max(risk) over (partition by ring_id) as most
                     from ringm join sc using (customer_id) where ring_id in {tuple(RINGS)})
        select ring_id as target_id, case ring_id when '{RINGS[0]}' then 'confirm' when '{RINGS[1]}' then 'dismiss' else 'reset' end as decision,
               string_agg(customer_id, ',' order by position) as members,
               string_agg(customer_id, ',' order by position) filter (ring_id <> '{RINGS[0]}' or risk >= {T / 2} or most < {T / 2}) as included
        from placed group by 1""", "ringm", "sc"),
    "stored_at_k": sql("""
        , ranked as (select label, row_number() over (order by risk desc, customer_id) as n, count(*) over () as total,
                            count(*) filter (label = 1) over () as positives from scored where label is not null)
        select k::bigint as k, round(count(*) filter (label = 1) / k, 6) as precision, round(count(*) filter (label = 1) / max(positives), 6) as recall
        from ranked, (select unnest([25, 50, 100, 200, 500, 1000]) as k) where n <= k and k <= total group by k""", "scored"),
}
