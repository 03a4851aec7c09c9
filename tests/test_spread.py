"""Steps that explode or sort rows do so on spread rows, whatever files they come from."""

from pyspark.sql import functions as F

from kithgraph.operators import canonical as C, edges as E, profiling as P
from kithgraph.sources.tables import ROW, spread

ROLES = {"id": "customer_id", "phone": "phone", "mail": "email"}


def rows_of_one_task(spark, n=300):
    """``n`` rows of one task; every third id comes twice."""
    k = F.col("id")
    at = F.struct(F.lit("f").alias("path"), F.lit(0).alias("block"), k.alias("at")).alias(ROW)
    return spark.range(0, n, 1, 1).select(
        F.concat(F.lit("C"), k - F.when(k % 3 == 2, 1).otherwise(0)).alias("id"),
        F.when(k % 2 == 0, F.concat(F.lit("555000"), F.lpad(k.cast("string"), 4, "0"))).alias("phone"),
        F.when(k >= 5, F.concat((k % 7).cast("string"), F.lit("@x.example"))).alias("mail"), at,
    )


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_examples_come_from_passes_without_sorting(spark):
    found = P.column_examples(rows_of_one_task(spark))
    assert "Sort " not in plan_of(found) and "Window" not in plan_of(found)
    assert {r["column"]: r["examples"] for r in found.collect()} == {
        "id": ["C0", "C1", "C3"], "phone": ["5550000000", "5550000002", "5550000004"],
        "mail": ["5@x.example", "6@x.example", "0@x.example"],
    }


def test_examples_of_few_values_of_empty_columns_and_of_ties(spark):
    schema = f"a string, b string, {ROW} int"
    rows = [("y", None, 1), ("x", None, 1), ("y", None, 0), (None, None, 2)]
    assert [tuple(r) for r in P.column_examples(spark.createDataFrame(rows, schema)).collect()] == [("a", ["y", "x"])]
    assert P.column_examples(spark.createDataFrame([], schema)).collect() == []


def test_rows_of_one_task_are_spread(spark):
    rows = rows_of_one_task(spark)
    assert rows.rdd.getNumPartitions() == 1 and spread(rows).rdd.getNumPartitions() == 4
    assert "REPARTITION_BY_NUM" in plan_of(P.column_statistics(rows))


def test_links_and_merged_rows_start_from_spread_rows(spark):
    rows, _ = C.with_ids(rows_of_one_task(spark), "id")
    assert C.wide_values(rows, ROLES).rdd.getNumPartitions() == 4
    merged = C.merge_rows(rows, ["id", "phone", "mail"])
    assert "REPARTITION_BY_NUM" in plan_of(merged)
    by_id = {r["id"]: r for r in merged.collect()}
    assert len(by_id) == 200 and by_id["C1"]["phone"] == "5550000002" and by_id["C1"][ROW]["at"] == 1
    assert C.links_from_columns(rows, ROLES).count() == 150 + 295  # no id has a phone or mail twice


def test_evidence_is_joined_on_spread_rows(spark):
    values = {"a": "xyz", "b": "xy", "c": "yz", "d": "w"}
    links = spark.createDataFrame([(c, "phone", x, x.upper()) for c, held in values.items() for x in held], "customer_id string, attribute_type string, attribute_id string, attribute_value string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")], "source_customer_id string, target_customer_id string")
    found = E.shared_evidence(edges, links)
    assert "REPARTITION_BY_NUM" in plan_of(found)
    rows = sorted((r["source_customer_id"], r["target_customer_id"], r["attribute_value"]) for r in found.collect())
    assert rows == [("a", "b", "X"), ("a", "b", "Y"), ("a", "c", "Y"), ("a", "c", "Z"), ("b", "c", "Y")]


def test_evidence_of_links_exploded_from_a_small_table_is_not_broadcast(spark):
    """The planner takes edges and links for as small as the table they are made from."""
    k = F.col("id")
    values = {"phone": k % 40, "email": k % 7, "ip": F.lit(0)}  # everyone holds the one ip, so it makes no edge
    cells = F.array(*[F.struct(F.lit(t).alias("t"), x.cast("string").alias("x")) for t, x in values.items()])
    links = spark.range(0, 120, 1, 1).select(F.format_string("c%03d", k).alias("customer_id"), F.explode(cells).alias("c")).select(
        "customer_id", F.col("c.t").alias("attribute_type"), F.concat("c.t", F.lit(":"), "c.x").alias("attribute_id"), F.col("c.x").alias("attribute_value")
    )
    found = E.shared_evidence(E.identity_edges(links, ["phone", "email", "ip"]), links)
    rows = sorted((r["source_customer_id"], r["target_customer_id"], r["attribute_type"], r["attribute_value"]) for r in found.collect())
    plan = plan_of(found)  # as run, with what was decided on the way
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    expected = []
    for a in range(120):
        for b in range(a + 1, 120):
            shared = [(t, str(a % m)) for t, m in (("phone", 40), ("email", 7)) if a % m == b % m]
            expected += [(f"c{a:03d}", f"c{b:03d}", *s) for s in shared + [("ip", "0")] * bool(shared)]
    assert rows == sorted(expected)
