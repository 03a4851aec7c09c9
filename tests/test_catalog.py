"""Published versions, deletion, the review log with two writers, and reviews as one act."""

import pytest
from pyspark.sql import functions as F

from kithgraph.functions.metadata import InputError
from kithgraph.operators import feedback as FB
from kithgraph.plans.review import ring_review
from kithgraph.session import durable, steps
from kithgraph.sources import sinks
from kithgraph.sources.catalog import Catalog
from kithgraph.sources.files import Files
from kithgraph.sources.reviews import REVIEW, ReviewLog

NEW = "target_type string, target_id string, decision string, note string, members array<string>, included array<string>, model_version int"


def reviews(spark, names, day="2024-01-01"):
    rows = [("customer", c, "confirm", None, [c], [c], 1) for c in names]
    return spark.createDataFrame(rows, NEW).withColumn("created_at", F.lit(day).cast("timestamp"))


def store(spark, root, dataset, version, n):
    sinks.write_result(spark.range(n).withColumnRenamed("id", "customer_id"), root, "customers", dataset, version)


def test_a_version_is_visible_only_when_published(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.datasets().count() == 0 and catalog.active_version("a/b") == 0
    store(spark, catalog.root, "a/b", 1, 3)
    with pytest.raises(InputError):
        catalog.read("customers", "a/b")
    catalog.publish("a/b", 1, ["customers"], name="First", summary={"n": 3})
    # A second run dies before it publishes: the first version stays what readers see.
    store(spark, catalog.root, "a/b", 2, 9)
    assert catalog.read("customers", "a/b").count() == 3 and catalog.active_version("a/b") == 1
    with pytest.raises(InputError):
        catalog.read("customers", "a/b", 2)
    assert catalog.sweep("a/b") == ["customers/version=2"] and catalog.sweep("a/b") == []
    store(spark, catalog.root, "a/b", 2, 5)
    catalog.publish("a/b", 2, ["customers"], name="Second")
    row = catalog.datasets().first()
    assert (row["dataset_id"], row["name"], row["active_version"]) == ("a/b", "Second", 2) and row["created_at"] is not None
    with pytest.raises(InputError):
        catalog.publish("a/b", 2, ["customers"])
    assert catalog.read("customers", "a/b").count() == 5 and catalog.read("customers", "a/b", 1).count() == 3


def test_deleting_takes_every_place_of_a_dataset(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    for dataset in ("x", "y"):
        store(spark, catalog.root, dataset, 1, 2)
        sinks.write_result(spark.range(1), catalog.root, "runs", dataset, 1)
        spark.range(1).write.parquet(f"{catalog.root}/snapshots/{dataset}/customers")
        ReviewLog(spark, catalog.root, dataset).append(reviews(spark, ["c"]))
        catalog.publish(dataset, 1, ["customers", "runs"])
    gone = catalog.delete("x")
    assert len(gone) == 5 and "published/x" in gone[0]
    assert [r["dataset_id"] for r in catalog.datasets().collect()] == ["y"]
    assert {r["dataset_id"] for r in spark.read.parquet(f"{catalog.root}/customers").collect()} == {"y"}
    assert ReviewLog(spark, catalog.root, "x").read().count() == 0 and ReviewLog(spark, catalog.root, "y").read().count() == 1


def test_a_file_is_made_once_and_whole(spark, tmp_path):
    files = Files(spark)
    assert files.create(f"{tmp_path}/a/b.json", '{"x": "é"}') and not files.create(f"{tmp_path}/a/b.json", "other")
    assert spark.read.json(f"{tmp_path}/a/b.json").first()["x"] == "é"
    assert files.names(f"{tmp_path}/a") == ["b.json"] and files.names(f"{tmp_path}/none") == []
    assert files.delete(f"{tmp_path}/a") and not files.exists(f"{tmp_path}/a")


def test_two_writers_of_the_log_get_ids_of_their_own(spark, tmp_path):
    """Both stage their rows, and both look for the next number, before either commits."""
    one, two = (ReviewLog(spark, str(tmp_path), "d") for _ in range(2))
    first, second = one.stage(reviews(spark, "ab")), two.stage(reviews(spark, "cde"))
    assert one.read().count() == 0
    looked, real = [], two._next

    def stale():
        looked.append(1)
        if len(looked) == 1:
            seen = real()
            one.commit(*first)
            return seen
        return real()

    two._next = stale
    assert two.commit(*second) == 3 and len(looked) == 2
    one.stage(reviews(spark, ["never committed"]))
    got = {r["id"]: r["target_id"] for r in one.read().collect()}
    assert got == {1: "a", 2: "b", 3: "c", 4: "d", 5: "e"}
    assert one.append(reviews(spark, ["f"], "2023-01-01")) == 6


def test_defaults_and_checks_of_a_ring_review(spark):
    membership = spark.createDataFrame([("R-1", c, i) for i, c in enumerate("dcba")] + [("R-2", "z", 0)], "ring_id string, customer_id string, position int")
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.31), ("c", 0.1), ("d", 0.2), ("z", 0.0)], "customer_id string, risk double")
    ask = lambda *a, **b: ring_review(membership, scores, 0.6, *a, **b).first()
    row = ask("R-1", "confirm", note="n", model_version=3)
    assert (row["members"], row["included"], row["note"], row["model_version"]) == (["d", "c", "b", "a"], ["b", "a"], "n", 3)
    assert ask("R-2", "confirm")["included"] == ["z"]  # nobody is likely: all are
    assert ask("R-1", "dismiss")["included"] == ask("R-1", "reset")["included"] == ["d", "c", "b", "a"]
    assert ask("R-1", "confirm", ["c", "c"])["included"] == ["c"] and ask("R-1", "reset", [])["included"] == []
    for wrong in (("R-1", "confirm", ["z"]), ("R-1", "dismiss", []), ("R-9", "confirm"), ("R-1", "maybe")):
        with pytest.raises(InputError):
            ask(*wrong)
    assert FB.feedback_labels(ring_review(membership, scores, 0.6, "R-1", "confirm").withColumn("id", F.lit(1))).count() == 2
    assert [f.split()[0] for f in REVIEW.split(", ")] == row.__fields__


def test_steps_of_a_run_are_deleted(spark):
    with steps(spark) as folder:
        assert durable(spark.range(3)).count() == 3 and Files(spark).names(folder)
    assert not Files(spark).exists(folder)
    assert durable(spark.range(2)).count() == 2
