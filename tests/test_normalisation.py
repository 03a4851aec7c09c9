"""Identity keys, values, column roles and the build from text tables."""

import pytest
from pyspark.sql import functions as F

from kithgraph.functions import identity as idn, metadata as md, phrases as p, values as val
from kithgraph.operators import canonical as C, profiling as P
from kithgraph.sources.tables import read_table


def key(spark, kind, raw):
    return spark.range(1).select(idn.identity_key(F.lit(kind), F.lit(raw)).alias("k")).first()["k"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identity_keys(spark):
    assert key(spark, "phone", "(555) 123-4567") == key(spark, "phone", "+1 555.123.4567") == "5551234567"
    assert key(spark, "phone", "N/A") is None
    assert key(spark, "phone", "000-000-0000") is None
    assert key(spark, "email", " Foo@Example.COM ") == "foo@example.com"
    assert key(spark, "email", "not-an-email") is None
    assert key(spark, "address", "12 Main Street") == key(spark, "address", "12 MAIN ST.")
    assert key(spark, "national_id", "123-45-6789") == "123456789"
    assert key(spark, "ip", "127.0.0.1") is None
    assert key(spark, "device", "A  b") == "a b"


def test_numbers_dates_and_labels(spark):
    cases = {"$50,000": 50000.0, "1d": None, "1f": None, "nan": None, "1e5": 1e5, "12 %": 12.0, "": None, "-.5": -0.5}
    for text, number in cases.items():
        assert one(spark, val.to_number(F.lit(text))) == number, text
    dates = {
        "2025-03-14": "2025-03-14", "14 Mar 2025": "2025-03-14", "03/14/2025": "2025-03-14", "14/03/2025": "2025-03-14",
        "March 14, 2025": "2025-03-14", "20250314": "2025-03-14", "2025-03-14T10:00:00": "2025-03-14", "soon": None, "12345": None,
    }
    for text, day in dates.items():
        assert one(spark, val.to_moment(F.lit(text)).cast("date").cast("string")) == day, text
    assert [one(spark, val.parse_label(F.lit(x))) for x in ("Yes", "no", "maybe")] == [1, 0, None]


def test_histogram_edges_follow_the_edge_list(spark):
    edges = val.unit_edges(20)
    assert [one(spark, val.equal_width_bin(F.lit(x), edges)) for x in (0.0, 0.15, 1.0)] == [0, 2, 19]


def test_whole_numbers_round_halves_to_even(spark):
    assert [one(spark, p.whole(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, p.grouped(F.lit(1234567.0))) == "1,234,567"
    assert one(spark, p.one_decimal(F.lit(1234.25))) == "1234.2"


def test_names():
    assert md.name_words("accountOpenDate") == ["account", "open", "date"]
    assert md.feature_names(["Annual Income", "annual-income", "2nd score", "label"]) == {
        "Annual Income": "annual_income", "annual-income": "annual_income_2", "2nd score": "col_2nd_score", "label": "col_label",
    }
    fields = md.suggest_fields(["Client ID", "Type", "Value"], {"customer_id": ["customerid", "clientid"], "attribute_type": ["type"], "attribute_value": ["value"]})
    assert fields == {"customer_id": "Client ID", "attribute_type": "Type", "attribute_value": "Value"}


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_roles_of_a_foreign_schema(spark, tmp_path):
    path = write(tmp_path, "bank.csv", "\n".join([
        "Customer ID,Full Name,Mobile Number,Email,Street Address,City,State,ZIP,Device ID,Annual Income,Credit Score,Account Opened,Is Fraud,Ring Ref",
        'CUST-1,Ann A,555-123-4567,a@x.example,1 Main St,Springfield,IL,62701,d1,"$45,000",700,14 Mar 2025,Yes,ring_1',
        "CUST-2,Bo B,(555) 123-4568,b@x.example,2 Main St,Springfield,IL,62701,d2,50000,650,15 Mar 2025,No,",
    ]))
    roles = P.suggest_customer_roles(read_table(spark, path))
    assert roles == {
        "Customer ID": "customer_id", "Full Name": "name", "Mobile Number": "phone", "Email": "email", "Street Address": "address",
        "City": "address", "State": "address", "ZIP": "address", "Device ID": "device", "Annual Income": "feature",
        "Credit Score": "feature", "Account Opened": "open_date", "Is Fraud": "label", "Ring Ref": "ring",
    }


def test_city_alone_is_not_an_identity_link(spark, tmp_path):
    path = write(tmp_path, "c.csv", "id,city,phone\na,Paris,5551234567\nb,Paris,5559876543\n")
    preview = P.preview(read_table(spark, path), "customers")
    assert preview["n_rows"] == 2 and preview["sample_rows"][0]["city"] == "Paris"
    assert preview["suggested_roles"] == {"id": "customer_id", "city": "ignore", "phone": "phone"}


DUPLICATES = 'Client ID,Phone,Fraud?,Income\nc1,(555) 111-2222,Yes,"$50,000"\nc1,555-333-4444,Yes,\nc2,555.111.2222,no,40000\nc3,n/a,maybe,30000\n'
ROLES = {"Client ID": "customer_id", "Phone": "phone", "Fraud?": "label", "Income": "feature"}


def test_duplicates_merge_and_labels_parse(spark, tmp_path):
    data = C.build_dataset(read_table(spark, write(tmp_path, "d.csv", DUPLICATES)), ROLES)
    rows = [tuple(r) for r in data.customers.orderBy("customer_id").select("customer_id", "label", "income").collect()]
    assert rows == [("c1", 1, 50000.0), ("c2", 0, 40000.0), ("c3", None, 30000.0)]
    assert data.links.count() == 3
    assert data.links.groupBy("attribute_id").agg(F.count_distinct("customer_id").alias("n")).agg(F.max("n")).first()[0] == 2
    assert any("repeated" in n for n in data.notes)


def test_bad_mappings_are_rejected(spark, tmp_path):
    frame = read_table(spark, write(tmp_path, "e.csv", "a,b\n1,3\n2,4\n"))
    for roles in ({"missing": "phone"}, {"a": "customer_id", "b": "customer_id"}, {"a": "nonsense"}, {"a": "customer_id"}):
        with pytest.raises(md.InputError):
            C.build_dataset(frame, roles)
    with pytest.raises(md.InputError):
        read_table(spark, write(tmp_path, "f.csv", "a,a\n1,2\n"))
    with pytest.raises(md.InputError):
        read_table(spark, write(tmp_path, "g.csv", "a,b\n"))


def test_row_numbers_stand_in_for_ids(spark, tmp_path):
    path = write(tmp_path, "h.csv", "phone,mail\n5551234567,x@y.example\n5551234567,\n")
    data = C.build_dataset(read_table(spark, path), {"phone": "phone", "mail": "email"})
    assert [r[0] for r in data.customers.select("customer_id").orderBy("customer_id").collect()] == ["C000001", "C000002"]


def test_events_from_text(spark, tmp_path):
    customers = read_table(spark, write(tmp_path, "c2.csv", "id,phone\na,5551234567\nb,5551234568\n"))
    events = read_table(spark, write(tmp_path, "e2.csv", "id,date,type,use,cap\na,2025-01-01,Spend,50,1000\na,bad,Spend,60,1000\nz,2025-01-01,pay,70,1\nb,2025-01-05,Limit Increase,,2000\n"))
    mapping = {"customer_id": "id", "event_date": "date", "event_type": "type", "utilization": "use", "credit_limit": "cap"}
    data = C.build_dataset(customers, {"id": "customer_id", "phone": "phone"}, events=(events, mapping))
    rows = {r["customer_id"]: r for r in data.events.collect()}
    assert rows["a"]["event_type"] == "purchase" and rows["a"]["utilization_pct"] == 0.5
    assert rows["b"]["event_type"] == "credit_limit_increase" and rows["b"]["utilization_pct"] == 0.5
    assert any("percentages" in n for n in data.notes) and any(n.startswith("2 events") for n in data.notes)
