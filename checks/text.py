"""Normalisation, canonical tables and column profiles on messy text made from the customer and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.functions import identity as idn, values as val, vocabulary as v
from kithgraph.operators import canonical as C, profiling as P
from kithgraph.sources.tables import ROW, as_text, restore_types

from . import fixtures as fx
from .fixtures import rounded, sql

# One text column per rule over k (the customer key) and p (0 for the row, 1 for its repeat). Both engines
# read the same expressions.
MESSY = {
    "client_id": "case when p = 1 and k % 101 = 100 then null else 'C' || lpad(k::string, 9, '0') end",
    "first_name": "case when k % 4 = 0 then null when k % 4 = 1 then 'Ann  Marie' else 'Bo' || (k % 10)::string end",
    "last_name": "case when k % 8 = 0 then null else 'de   la Cruz' || (k % 7)::string end",
    "mobile": """case when k % 50 = 0 then 'N/A' when k % 53 = 0 then '000-000-0000' when k % 59 = 0 then '12345'
        when (k + p) % 4 = 0 then '(555) ' || substr(lpad((k - p)::string, 7, '0'), 1, 3) || '-' || substr(lpad((k - p)::string, 7, '0'), 4, 4)
        when (k + p) % 4 = 1 then '555.' || substr(lpad(k::string, 7, '0'), 1, 3) || '.' || substr(lpad(k::string, 7, '0'), 4, 4)
        when (k + p) % 4 = 2 then '+1 555 ' || substr(lpad(k::string, 7, '0'), 1, 3) || ' ' || substr(lpad(k::string, 7, '0'), 4, 4)
        else '555-' || substr(lpad(k::string, 7, '0'), 1, 3) || '-' || substr(lpad(k::string, 7, '0'), 4, 4) end""",
    "email": """case when k % 11 = 0 then 'not-an-email' when k % 13 = 0 then '@' || k::string || '@'
        when k % 7 = 0 then 'USER' || k::string || '@MAIL.EXAMPLE' else 'user' || k::string || '@mail.example' end""",
    "street": """case when k % 3 = 0 then (k % 97)::string || ' Main Street, North' when k % 3 = 1 then (k % 97)::string || ' MAIN ST. N'
        when k % 31 = 2 then null else 'Apartment ' || (k % 89)::string || ' East Road' end""",
    "city": "case when k % 31 = 2 then null when k % 2 = 0 then 'Springfield' else 'Shelby Ville' end",
    "passport": "case when k % 13 = 0 then '1111-1111' when k % 17 = 0 then 'A1' else 'P-' || lpad((k % 500)::string, 5, '0') end",
    "login_ip": "case when k % 9 = 0 then '127.0.0.1' else '10.0.' || (k % 3)::string || '.' || (k % 200)::string end",
    "device_id": "case when k % 23 = 0 then 'unknown' else 'Dev   ' || (k % 300)::string end",
    "income": "case when k % 17 = 0 then 'n/k' when p = 1 then null when k % 5 = 0 then '$1,' || lpad((k % 1000)::string, 3, '0') else (k % 1000)::string || '.5' end",
    "is_fraud": "case when k % 6 = 0 then 'Yes' when k % 6 = 5 then 'maybe' when k % 6 = 4 and p = 0 then null else 'no' end",
    "opened": """case when k % 19 = 0 then 'soon' when k % 4 = 0 then '2024-' || lpad((1 + k % 12)::string, 2, '0') || '-' || lpad((1 + k % 28)::string, 2, '0')
        when k % 4 = 1 then (1 + k % 28)::string || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', (3 * (k % 12) + 1)::int, 3) || ' 2025'
        when k % 4 = 2 then (1 + k % 12)::string || '/' || (1 + k % 28)::string || '/2023' else (13 + k % 15)::string || '/' || (1 + k % 12)::string || '/2022' end""",
    "ring_ref": "case when k % 6 = 0 then 'ring ' || (k % 40)::string end",
}
ROLES = {
    "client_id": "customer_id", "first_name": "name", "last_name": "name", "mobile": "phone", "email": "email",
    "street": "address", "city": "address", "passport": "national_id", "login_ip": "ip", "device_id": "device",
    "income": "feature", "is_fraud": "label", "opened": "open_date", "ring_ref": "ring",
}
RAW_TYPES = (
    "case k % 9 when 0 then 'Phone Number' when 1 then 'eMail' when 2 then 'homeAddress' when 3 then 'DeviceID' when 4 then 'IBAN' "
    "when 5 then 'Loyalty Card-Id' when 6 then 'phone_work' when 7 then '??' else 'taxId' end"
)


def messy(spark, d):
    """Every customer row, and for two of three a repeat further down with other values."""
    keys = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    rows = keys.select("k", F.explode(F.expr("if(k % 3 = 0, array(0L), array(0L, 1L))")).alias("p"))
    position = F.struct(F.lit("").alias("path"), F.col("p").alias("block"), F.col("k").alias("at")).alias(ROW)
    return rows.select(*[F.expr(e).alias(n) for n, e in MESSY.items()], position)


def identified(spark, d):
    return C.with_ids(messy(spark, d), "client_id")[0]


def identity_keys(spark, d):
    """Matching key of every cell, by kind."""
    m = messy(spark, d)
    kinds = {"mobile": "phone", "email": "email", "street": "address", "passport": "national_id", "login_ip": "ip", "device_id": "device"}
    return m.select(
        F.col(f"{ROW}.at").alias("k"), F.col(f"{ROW}.block").alias("p"),
        *[idn.identity_key(F.lit(kind), F.col(c)).alias(f"{kind}_key") for c, kind in kinds.items()],
        idn.attribute_id(F.lit("national_id"), F.lower("client_id")).alias("hashed"),
        idn.display_value(F.lit("national_id"), F.col("client_id"), F.col("client_id")).alias("masked"),
    )


def values_read(spark, d):
    m = messy(spark, d)
    return m.select(
        F.col(f"{ROW}.at").alias("k"), F.col(f"{ROW}.block").alias("p"),
        val.parse_label(F.col("is_fraud")).alias("label"), val.to_number(F.col("income")).alias("income"),
        val.to_moment(F.col("opened")).cast("date").cast("string").alias("opened"),
        val.full_name([F.col("first_name"), F.col("last_name")], F.col("client_id")).alias("name"),
        idn.joined_address([F.col("street"), F.col("city")]).alias("address"),
    )


def type_names(spark, d):
    t = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(RAW_TYPES).alias("raw"))
    return t.select("k", idn.attribute_type(F.col("raw")).alias("attribute_type"), idn.event_type(F.col("raw")).alias("event_type"))


def merged(spark, d):
    rows = C.merge_rows(identified(spark, d), list(MESSY))
    parsed, _ = C.parsed_customers(rows, ROLES)
    return parsed.drop(ROW).withColumn("open_date", F.col("open_date").cast("string"))


def id_counts(spark, d):
    m = messy(spark, d)
    missing = m.agg(F.count_if(F.col("client_id").isNull()).alias("missing"))
    return C.id_counts(identified(spark, d)).join(missing)


def numbered(spark, d):
    """Row numbers as ids over a table read from its files."""
    t = as_text(fx.table(spark, d, "customer").select("c_custkey"))
    return C.numbered_ids(t).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("_id").alias("customer_id"))


def wide_links(spark, d):
    return C.links_from_columns(identified(spark, d), ROLES)


def long_links(spark, d):
    """Links of known customers from a long table whose types are named freely."""
    t = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    long = t.select(
        F.expr("case when k % 37 = 0 then 'X' || k::string else 'C' || lpad(k::string, 9, '0') end").alias("who"),
        F.expr(RAW_TYPES).alias("kind"), F.expr("'Value  ' || (5550000 + k % 50)::string").alias("what"),
        F.struct(F.lit("").alias("path"), F.lit(0).alias("block"), F.col("k").alias("at")).alias(ROW),
    )
    mapping = {"customer_id": "who", "attribute_type": "kind", "attribute_value": "what"}
    return C.links_from_table(long, mapping, fx.customers(spark, d))


EVENT_TEXT = {
    "who": "'C' || lpad((user_id + case when event_id % 41 = 0 then 500000000 else 0 end)::string, 9, '0')",
    "happened": "case when event_id % 43 = 0 then 'n/a' when event_id % 2 = 0 then (1 + event_id % 28)::string || ' Mar 2025' "
          "else '2025-04-' || lpad((1 + event_id % 28)::string, 2, '0') end",
    "kind": "case event_type when 'purchase' then 'Spend' when 'click' then 'Limit Increase' when 'signup' then 'rePayment' else event_type end",
    "used": "case when event_id % 10 = 3 then null when event_id % 10 = 4 then '-5%' else (event_id % 120)::string || ' %' end",
    "cap": "case when event_id % 7 = 0 then '' else '$' || (event_id % 90)::string || ',000' end",
}


def event_log(spark, d):
    text = fx.table(spark, d, "events").select(*[F.expr(e).alias(n) for n, e in EVENT_TEXT.items()], F.col("event_id").alias(ROW))
    mapping = {"customer_id": "who", "event_date": "happened", "event_type": "kind", "utilization": "used", "credit_limit": "cap"}
    rows, _, _ = C.events_from_table(text, mapping, fx.customers(spark, d))
    return rounded(rows.withColumn("event_date", F.to_date("event_date").cast("string")))


def account_age(spark, d):
    aged = C.account_age(fx.customers(spark, d).select("customer_id", "open_date"), fx.events(spark, d))
    return aged.withColumn("open_date", F.col("open_date").cast("string"))


def dataset_from_text(spark, d):
    """The whole build from text tables: customers with medians and account age filled in."""
    return rounded(C.build_dataset(messy(spark, d), ROLES).customers.withColumn("open_date", F.col("open_date").cast("string")))


def statistics(spark, d):
    return rounded(P.column_statistics(messy(spark, d)), 6)


def examples(spark, d):
    return P.column_examples(messy(spark, d)).select("column", F.array_join("examples", "|").alias("examples"))


def roles(spark, d):
    return spark.createDataFrame(list(P.suggest_customer_roles(messy(spark, d)).items()), "column string, role string")


def typed_links(spark, d):
    """Links with the display text of typed value tables, the id where none is known."""
    rows = fx.links(spark, d).select("customer_id", "attribute_type", "attribute_id")
    held = rows.filter("attribute_type <> 'ip'").select("attribute_type", "attribute_id").distinct()
    tables = [
        (held.filter(F.col("attribute_type") == t), "attribute_id", F.concat(F.lit(f"{t} of "), F.split_part("attribute_id", F.lit(":"), F.lit(2))))
        for t in v.CORE_TYPES
    ]
    return C.links_with_display(rows, C.display_lookup(tables))


def restored(spark, d):
    """Numbers and missing rings back from text."""
    t = fx.customers(spark, d).select("customer_id", F.col("income").cast("string").alias("income"), F.coalesce("truth_ring", F.lit("")).alias("truth_ring"))
    return restore_types(t, ["income"], ["truth_ring"])


# Every order's known moment, written in one of these shapes; the seconds since midnight are given by the order key.
WRITTEN = [
    "M/d/yyyy h:mm:ss a", "d MMM yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MMM d, yyyy H:mm:ss", "dd-MMM-yy HH:mm:ss", "yyyyMMdd'T'HHmmss",
    "d MMMM yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-M-d'T'HH:mm:ss'+00:00'", "MMMM d yyyy hh:mm:ss a",
]


def moments_read(spark, d):
    """Dates with a time of day in many shapes, some behind spaces that do not break."""
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    moment = F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86400 + F.col("o_orderkey") * 7919 % 86400)
    shape = F.col("o_orderkey") % len(WRITTEN)
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(WRITTEN):
        text = F.when(shape == i, F.date_format(moment, pattern)).otherwise(text)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\u00a0"), text)).otherwise(text)
    return o.select("o_orderkey", F.unix_seconds(val.to_moment(text)).alias("seconds"))


QUERIES = {
    "moments_read": moments_read,
    "identity_keys": identity_keys,
    "values_read": values_read,
    "type_names": type_names,
    "merged_customers": merged,
    "id_counts": id_counts,
    "numbered_ids": numbered,
    "wide_links": wide_links,
    "long_links": long_links,
    "event_log": event_log,
    "account_age": account_age,
    "dataset_from_text": dataset_from_text,
    "column_statistics": statistics,
    "column_examples": examples,
    "suggested_roles": roles,
    "typed_links": typed_links,
    "restored_types": restored,
}

_PLACE = "(" + ", ".join(f"'{p}'" for p in v.PLACEHOLDERS) + ")"
_ABBR = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in v.STREET_WORDS.items()) + "}"
_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def _clean(c):
    return f"case when lower(trim({c})) not in {_PLACE} then trim({c}) end"


def _key(kind, c):
    x = f"({_clean(c)})"
    if kind == "phone":
        g = f"regexp_replace({x}, '[^0-9]', '', 'g')"
        return f"case when length({g}) >= 7 and replace(right({g}, 10), right({g}, 1), '') <> '' then right({g}, 10) end"
    if kind == "email":
        return f"case when {x} like '%@%' and not starts_with({x}, '@') and not ends_with({x}, '@') then lower({x}) end"
    if kind == "address":
        return (f"nullif(array_to_string(list_transform(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), "
                f"lambda w: coalesce({_ABBR}[w], w)), ' '), '')")
    if kind in v.SENSITIVE_TYPES:
        g = f"regexp_replace(lower({x}), '[^0-9a-z]', '', 'g')"
        return f"case when length({g}) >= 4 and replace({g}, left({g}, 1), '') <> '' then {g} end"
    if kind == "ip":
        return f"case when lower({x}) not in ('0.0.0.0', '127.0.0.1', '::1', '255.255.255.255') then lower({x}) end"
    return f"regexp_replace(lower({x}), '\\s+', ' ', 'g')"


def _words(c):
    return f"list_filter(string_split_regex(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def _date(c):
    return (f"case when regexp_matches({c}, '^\\d{{4}}-') then try_cast({c} as date) "
            f"when regexp_matches({c}, '^\\d+ [A-Za-z]{{3}} \\d{{4}}$') then make_date(split_part({c}, ' ', 3)::int, list_position({_MONTHS}, lower(split_part({c}, ' ', 2)))::int, split_part({c}, ' ', 1)::int) "
            f"when regexp_matches({c}, '^\\d+/\\d+/\\d{{4}}$') then case when split_part({c}, '/', 1)::int <= 12 "
            f"then make_date(split_part({c}, '/', 3)::int, split_part({c}, '/', 1)::int, split_part({c}, '/', 2)::int) "
            f"else make_date(split_part({c}, '/', 3)::int, split_part({c}, '/', 2)::int, split_part({c}, '/', 1)::int) end end")


def _number(c):
    return f"try_cast(regexp_replace({c}, '[,\\s$€£₹%]', '', 'g') as double)"


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _label(c):
    return f"case when lower({c}) in {_in(v.POSITIVE_WORDS)} then 1 when lower({c}) in {_in(v.NEGATIVE_WORDS)} then 0 end"


def _name(first, last, other):
    return f"coalesce(nullif(trim(regexp_replace(concat_ws(' ', {first}, {last}), '\\s+', ' ', 'g')), ''), {other})"


def _type(c):
    joined, snake = f"array_to_string({_words(c)}, '')", f"array_to_string({_words(c)}, '_')"
    known = " ".join(f"when '{a}' then '{b}'" for a, b in v.ATTRIBUTE_SYNONYMS.items())
    prefixes = " ".join(f"when starts_with({joined}, '{p}') then '{p}'" for p in v.ATTRIBUTE_PREFIXES)
    return f"coalesce(case {joined} {known} end, case {prefixes} end, nullif({snake}, ''), 'identifier')"


def _event(c):
    snake = f"array_to_string({_words(c)}, '_')"
    known = " ".join(f"when '{a}' then '{b}'" for a, b in v.EVENT_SYNONYMS.items())
    return f"coalesce(case {snake} {known} end, nullif({snake}, ''), 'event')"


_COLUMNS = ", ".join(f"{e} as {n}" for n, e in MESSY.items())
fx.SQL.update({
    "messy": ([], f"select k, p, {_COLUMNS} from (select c_custkey as k, unnest(case when c_custkey % 3 = 0 then [0] else [0, 1] end)::bigint as p from customer)"),
    "firsts": (["messy"], "select client_id, " + ", ".join(
        f"arg_min({c}, p * 1000000000 + k) filter ({c} is not null) as {c}" for c in MESSY if c != "client_id"
    ) + " from messy where client_id is not null group by 1"),
    "cells": (["messy"], "select * from (" + " union all ".join(
        f"select '{c}' as col, {c} as value, count(*) as n, min(p * 1000000000 + k) as first from messy group by 2" for c in MESSY
    ) + ")"),
    "read": (["firsts"], f"""
        select client_id as customer_id, {_name('first_name', 'last_name', 'client_id')} as name, {_label('is_fraud')} as label, ring_ref as truth_ring,
               {_date('opened')} as open_date, {_number('income')} as income from firsts"""),
})

_SOURCES = [("phone", "mobile"), ("email", "email"), ("address", "nullif(concat_ws(', ', street, city), '')"), ("device", "device_id"), ("ip", "login_ip"), ("national_id", "passport")]
_LONG = " union all ".join(f"select client_id, k, p, '{t}' as t, {c} as raw, {_key(t, c)} as key from messy where client_id is not null" for t, c in _SOURCES)

SQL = {
    "moments_read": "select o_orderkey, (epoch(o_orderdate::date)::bigint + o_orderkey * 7919 % 86400)::bigint as seconds from orders",
    "identity_keys": sql(f"""
        select k, p, {_key('phone', 'mobile')} as phone_key, {_key('email', 'email')} as email_key, {_key('address', 'street')} as address_key,
               {_key('national_id', 'passport')} as national_id_key, {_key('ip', 'login_ip')} as ip_key, {_key('device', 'device_id')} as device_key,
               'national_id:' || sha256(lower(client_id)) as hashed, '•••• ' || right(client_id, 4) as masked from messy""", "messy"),
    "values_read": sql(f"""
        select k, p, {_label('is_fraud')} as label, {_number('income')} as income, ({_date('opened')})::varchar as opened,
               {_name('first_name', 'last_name', 'client_id')} as name, nullif(concat_ws(', ', street, city), '') as address from messy""", "messy"),
    "type_names": f"select k, {_type('raw')} as attribute_type, {_event('raw')} as event_type from (select c_custkey as k, {RAW_TYPES} as raw from (select *, c_custkey as k from customer))",
    "merged_customers": sql("select * replace (open_date::varchar as open_date) from read", "read"),
    "id_counts": sql("""
        select count(client_id) as n_rows, count(distinct client_id) as n_ids, count(client_id) - count(distinct client_id) as repeated,
               count(*) filter (client_id is null) as missing from messy""", "messy"),
    "numbered_ids": "select c_custkey, 'C' || lpad((row_number() over (order by c_custkey))::varchar, 6, '0') as customer_id from customer",
    "wide_links": sql(f"""
        select client_id as customer_id, t as attribute_type, t || ':' || case when t = 'national_id' then sha256(key) else key end as attribute_id,
               case when t = 'national_id' then '•••• ' || right(key, 4) else arg_min(trim(raw), p * 1000000000 + k) end as attribute_value
        from ({_LONG}) where key is not null group by client_id, t, key""", "messy"),
    "long_links": sql(f"""
        , long as (select k, case when k % 37 = 0 then 'X' || k else 'C' || lpad(k::varchar, 9, '0') end as who, {_type('(' + RAW_TYPES + ')')} as t,
                          'Value  ' || (5550000 + k % 50) as raw from (select c_custkey as k from customer)),
        keyed as (select *, case when t = 'phone' then {_key('phone', 'raw')} when t = 'email' then {_key('email', 'raw')} when t = 'address' then {_key('address', 'raw')}
                         when t in ('national_id', 'bank_account') then {_key('national_id', 'raw')} when t = 'ip' then {_key('ip', 'raw')} else {_key('device', 'raw')} end as key from long)
        select who as customer_id, t as attribute_type, t || ':' || case when t in ('national_id', 'bank_account') then sha256(key) else key end as attribute_id,
               case when t in ('national_id', 'bank_account') then '•••• ' || right(key, 4) else raw end as attribute_value
        from keyed where key is not null and who in (select customer_id from cust)""", "cust"),
    "event_log": sql(f"""
        , t as (select {', '.join(f'{e} as {n}' for n, e in EVENT_TEXT.items())} from events),
        parsed as (select who as customer_id, {_date('happened')} as event_date, {_event('kind')} as event_type, {_number('used')} as u, {_number("nullif(cap, '')")} as c
                   from t where who in (select customer_id from cust) and {_date('happened')} is not null)
        select customer_id, event_date::varchar as event_date, event_type,
               round(greatest(coalesce(u, (select median(u) from parsed)) / case when (select max(u) from parsed) > 1.5 then 100 else 1 end, 0), 6) as utilization_pct,
               coalesce(c, (select median(c) from parsed)) as credit_limit_at_time from parsed""", "cust"),
    "account_age": sql("""
        , aged as (select customer_id, open_date, date_diff('day', open_date, (select greatest(max(open_date), (select max(ts)::date from events)) from cust))::double as a from cust)
        select customer_id, open_date::varchar as open_date, coalesce(a, (select median(a) from aged)) as account_tenure_days from aged""", "cust"),
    "dataset_from_text": sql("""
        , aged as (select *, date_diff('day', open_date, (select max(open_date) from read))::double as a from read)
        select customer_id, name, label, truth_ring, open_date::varchar as open_date, round(coalesce(income, (select median(income) from read)), 6) as income,
               coalesce(a, (select median(a) from aged)) as account_tenure_days from aged""", "read"),
    "column_statistics": sql(f"""
        select col as column, count(value) as n_unique, (sum(n) filter (value is null))::bigint as n_empty, (sum(n) filter (value is not null))::bigint as n_filled,
               round(coalesce(sum(n) filter ({_number('value')} is not null) / sum(n) filter (value is not null), 0), 6) as numeric_share,
               round(coalesce(sum(n) filter ({_date('value')} is not null) / sum(n) filter (value is not null), 0), 6) as date_share,
               round(coalesce(sum(n) filter (({_label('value')}) is not null) / sum(n) filter (value is not null), 0), 6) as label_share
        from cells group by 1""", "cells").replace("(sum(n) filter (value is null))::bigint", "coalesce(sum(n) filter (value is null), 0)::bigint"),
    "column_examples": sql("""
        select col as column, string_agg(value, '|' order by first, value) as examples
        from (select *, row_number() over (partition by col order by first, value) as rn from cells where value is not null) where rn <= 3 group by 1""", "cells"),
    "typed_links": sql("""
        select customer_id, attribute_type, attribute_id, case when attribute_type = 'ip' then attribute_id
               else attribute_type || ' of ' || split_part(attribute_id, ':', 2) end as attribute_value from lnk""", "lnk"),
    "restored_types": sql("select customer_id, income, truth_ring from cust", "cust"),
}
