"""Typed reads, parquet uploads and a sample of the registered queries next to their SQL."""

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from checks.compare import compare, duck
from kithgraph.functions.metadata import InputError
from kithgraph.model import LINKS
from kithgraph.sources.sinks import from_json_columns, write_csv
from kithgraph.sources.tables import read_table, read_typed


def test_typed_reads_keep_doubles_exact_and_prune(spark, tmp_path):
    schema = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    numbers = [0.1, 1 / 3, 1e-300, 123456789.123456789]
    frame = spark.createDataFrame([(str(i), n, n) for i, n in enumerate(numbers)], schema).coalesce(1)
    frame.write.csv(str(tmp_path / "c"), header=True)
    frame.write.parquet(str(tmp_path / "p.parquet"))
    for path in (str(tmp_path / "c"), str(tmp_path / "p.parquet")):
        got = read_typed(spark, path, schema, ["customer_id", "x"])
        assert got.columns == ["customer_id", "x"] and [r["x"] for r in got.orderBy("customer_id").collect()] == numbers
    assert [f.name for f in LINKS] == ["customer_id", "attribute_type", "attribute_id", "attribute_value"]


def test_uploads_may_be_parquet_and_use_other_separators(spark, tmp_path):
    spark.createDataFrame([(1, " a "), (2, "")], "id int, t string").write.parquet(str(tmp_path / "u.parquet"))
    assert sorted((r["id"], r["t"]) for r in read_table(spark, str(tmp_path / "u.parquet")).collect()) == [("1", "a"), ("2", None)]
    (tmp_path / "s.csv").write_text("id; t ;\n1; x ;\n2;;\n")
    table = read_table(spark, str(tmp_path / "s.csv"), sep=";")
    assert [c for c in table.columns if c != "_row"] == ["id", "t"] and table.filter("t = 'x'").count() == 1


def test_csv_cells_keep_line_breaks_and_surplus_fields_are_an_error(spark, tmp_path):
    (tmp_path / "b.csv").write_text('id,street,city\nc1,"12 Main\nStreet",A\nc2,"1, ""High"" Road"\n')
    rows = {r["id"]: (r["street"], r["city"]) for r in read_table(spark, str(tmp_path / "b.csv")).collect()}
    assert rows == {"c1": ("12 Main\nStreet", "A"), "c2": ('1, "High" Road', None)}
    (tmp_path / "s.csv").write_text("id,street\nc1,1 Low Road\nc2,12 Main, Street\n")
    for line_breaks in (True, False):
        with pytest.raises(InputError, match="more fields"):
            read_table(spark, str(tmp_path / "s.csv"), line_breaks=line_breaks)
    (tmp_path / "e.csv").write_text("id,street\n")
    with pytest.raises(InputError, match="no rows"):
        read_table(spark, str(tmp_path / "e.csv"))


def test_dates_with_times_and_spaces_of_every_kind(spark):
    from pyspark.sql import functions as F

    from kithgraph.functions.identity import identity_key
    from kithgraph.functions.values import to_moment

    cases = {
        "3/4/2025 5:06 PM": "2025-03-04 17:06:00", "1 Mar 2025 10:00": "2025-03-01 10:00:00", "2025/03/04 10:00": "2025-03-04 10:00:00",
        "Mar 5 2025 10:00": "2025-03-05 10:00:00", "04-Mar-25": "2025-03-04 00:00:00", "15 Sept 2025": "2025-09-15 00:00:00",
        "20250304T101112": "2025-03-04 10:11:12", "13/1/2025 0:05": "2025-01-13 00:05:00", "12/31/2024 12:00 am": "2024-12-31 00:00:00",
        "1 Mar 2025 10:00 +02:00": "2025-03-01 08:00:00", "2025-03-04T10:11:12Z": "2025-03-04 10:11:12", "2025": "2025-01-01 00:00:00",
        "1 Mar 2025 25:00": None, "13 May 2025 13:00 PM": None, "soon": None, "": None, "31/31/2025": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["m"] for r in frame.select("t", to_moment(F.col("t")).cast("string").alias("m")).collect()}
    assert got == cases
    keys = spark.createDataFrame([("device", "\u00a0N/A\u00a0"), ("email", "\u00a0A@b.example")], "k string, v string")
    assert [r[0] for r in keys.select(identity_key(F.col("k"), F.col("v"))).collect()] == [None, "a@b.example"]


def test_nested_columns_survive_csv(spark, tmp_path):
    spark.createDataFrame([("a", ["x", "y"])], "id string, m array<string>").write.parquet(str(tmp_path / "n"))
    write_csv(spark.read.parquet(str(tmp_path / "n")), str(tmp_path / "n_csv"))
    back = from_json_columns(spark.read.csv(str(tmp_path / "n_csv"), header=True, escape='"'), {"m": "array<string>"})
    assert back.first()["m"] == ["x", "y"]


SAMPLE = [
    "shared_counts", "identity_edges", "hub_report", "link_holders", "temporal_features", "classification_metrics", "pr_curve",
    "train_test_split", "stratified_folds", "identity_keys", "wide_links", "event_log", "column_statistics", "feedback_labels",
    "clauses", "ring_connectivity",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, sf, name):
    result = entry.queries()[name](spark, sf).toPandas()
    assert compare(result, duck(sf).execute(entry.oracle_sql()[name]).df()) == "ok"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 150


def test_typed_tables_become_a_dataset(spark):
    from kithgraph.operators.canonical import typed_dataset

    def table(rows, columns):
        return spark.createDataFrame(rows, columns)

    data = typed_dataset(
        table([("a", "Ann", 1, "ring_0001", "2025-01-01", 50000, 700, 30), ("b", "Bo", 0, "", "2025-02-01", 40000, 650, 10)],
              ["customer_id", "full_name", "is_synthetic_fraud", "ring_id", "account_open_date", "annual_income", "credit_score", "account_tenure_days"]),
        table([("a", "phone", "phone_1"), ("a", "address", "address_1"), ("b", "device", "device_1"), ("b", "email", "email_9")], ["customer_id", "attribute_type", "attribute_id"]),
        table([("a", "2025-03-01", "purchase", 0.5, 1000)], ["customer_id", "event_date", "event_type", "utilization_pct", "credit_limit_at_time"]),
        table([("phone_1", "555-1234")], ["phone_id", "phone_number"]), table([("email_1", "x@y.example")], ["email_id", "email_address"]),
        table([("address_1", "1 Main St", "Springfield", "IL", "62701")], ["address_id", "street", "city", "state", "zip"]),
        table([("device_1", "abcdef0123456789")], ["device_id", "device_fingerprint"]),
    )
    shown = {r["attribute_id"]: r["attribute_value"] for r in data.links.collect()}
    assert shown == {
        "phone_1": "555-1234", "address_1": "1 Main St, Springfield, IL 62701", "device_1": "device abcdef012345", "email_9": "email_9",
    }
    rows = {r["customer_id"]: r for r in data.customers.collect()}
    assert rows["a"]["label"] == 1 and rows["b"]["truth_ring"] is None and rows["a"]["annual_income"] == 50000.0
    assert data.events.first()["credit_limit_at_time"] == 1000.0
