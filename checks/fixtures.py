"""Canonical tables derived from the given tables, once as DataFrames and once as SQL.

customer_id is C plus the nine-digit customer key; identity values come from the key by integer
arithmetic, so that values are shared by pairs, small groups, cliques of 24 and one office address.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TYPES = ["phone", "email", "address", "device", "ip"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cid(key: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(key.cast("string"), 9, "0"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    opened = (
        table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.to_date(F.min("o_orderdate")).alias("open_date"))
    )
    c = table(spark, folder, "customer").join(opened, "c_custkey", "left")
    label = (F.col("c_acctbal") < 0).cast("int")
    return c.select(
        cid(F.col("c_custkey")).alias("customer_id"),
        F.col("c_name").alias("name"),
        label.alias("label"),
        F.when(label == 1, F.concat(F.lit("ring_"), F.expr("c_custkey div 6"))).alias("truth_ring"),
        "open_date",
        F.col("c_acctbal").alias("income"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    values = {
        "phone": "if(k % 4 < 2, concat('h', k div 4), concat('u', k))",
        "email": "case when k % 240 in (23, 24) then concat('b', k div 240) "
                 "when k % 6 < 3 and (k div 6) % 3 = 0 then concat('h', k div 6) else concat('u', k) end",
        "address": "case when k % 240 < 48 then concat('h', k div 24) "
                   "when k % 5 = 0 then concat('p', k div 10) else concat('u', k) end",
        "device": "if(k % 15 = 7, concat('h', k div 30), concat('u', k))",
        "ip": "if(k % 2 = 0, 'office', null)",
    }
    stacked = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.expr(e).alias("v")) for t, e in values.items()]))
    rows = c.select("k", stacked.alias("l")).filter("l.v is not null")
    return rows.select(
        cid(F.col("k")).alias("customer_id"),
        F.col("l.t").alias("attribute_type"),
        F.concat("l.t", F.lit(":"), "l.v").alias("attribute_id"),
        F.upper("l.v").alias("attribute_value"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        cid(F.col("user_id")).alias("customer_id"),
        F.col("ts").alias("event_date"),
        F.expr("case event_type when 'signup' then 'payment' when 'click' then 'credit_limit_increase' else event_type end").alias("event_type"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("utilization_pct"),
        (F.regexp_extract("props", r'"k": (\d+)', 1).cast("double") * 100).alias("credit_limit_at_time"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """A deterministic score per customer and the score of the version before."""
    return table(spark, folder, "customer").select(
        cid(F.col("c_custkey")).alias("customer_id"),
        (F.expr("c_custkey * 37 % 1000") / 1000.0).alias("risk"),
        (F.expr("c_custkey * 53 % 1000") / 1000.0).alias("previous_risk"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One review per block of six customers, then one per customer of the richest balances."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    of_ring = (
        c.groupBy(F.expr("k div 6").alias("g"))
        .agg(
            F.array_sort(F.collect_list(cid(F.col("k")))).alias("members"),
            F.array_sort(F.collect_list(F.when(F.expr("k % 6 < 4"), cid(F.col("k"))))).alias("included"),
        )
        .select(
            F.col("g").alias("id"), F.lit("ring").alias("target_type"),
            F.format_string("R-%04d", F.col("g") + 1).alias("target_id"),
            F.expr("element_at(array('confirm', 'dismiss', 'reset'), cast(g % 3 as int) + 1)").alias("decision"),
            F.concat(F.lit("note "), F.col("g")).alias("note"), "members", "included",
            F.timestamp_seconds(F.col("g") + 1700000000).alias("created_at"),
            F.expr("cast(1 + g % 2 as int)").alias("model_version"),
        )
    )
    of_customer = c.filter("c_acctbal > 9000").select(
        (F.col("k") + 1000000000).alias("id"), F.lit("customer").alias("target_type"),
        cid(F.col("k")).alias("target_id"),
        F.expr("element_at(array('dismiss', 'reset', 'confirm'), cast(k % 3 as int) + 1)").alias("decision"),
        F.lit(None).cast("string").alias("note"),
        F.array(cid(F.col("k"))).alias("members"), F.array(cid(F.col("k"))).alias("included"),
        F.timestamp_seconds(F.col("k") + 1800000000).alias("created_at"),
        F.lit(2).alias("model_version"),
    )
    return of_ring.unionByName(of_customer)


# The same tables as SQL, plus steps shared by several checks: name -> (needed names, body).
SQL: dict[str, tuple[list[str], str]] = {
    "cust": ([], """
        select 'C' || lpad(c_custkey::varchar, 9, '0') as customer_id, c_name as name,
               (c_acctbal < 0)::int as label,
               case when c_acctbal < 0 then 'ring_' || (c_custkey // 6) end as truth_ring,
               opened.open_date, c_acctbal as income
        from customer left join (select o_custkey, min(o_orderdate)::date as open_date from orders group by 1) opened
          on o_custkey = c_custkey"""),
    "lnk": ([], """
        select 'C' || lpad(k::varchar, 9, '0') as customer_id, t as attribute_type,
               t || ':' || v as attribute_id, upper(v) as attribute_value
        from (
          select c_custkey as k, 'phone' as t, case when c_custkey % 4 < 2 then 'h' || (c_custkey // 4) else 'u' || c_custkey end as v from customer
          union all
          select c_custkey, 'email', case when c_custkey % 240 in (23, 24) then 'b' || (c_custkey // 240)
            when c_custkey % 6 < 3 and (c_custkey // 6) % 3 = 0 then 'h' || (c_custkey // 6) else 'u' || c_custkey end from customer
          union all
          select c_custkey, 'address', case when c_custkey % 240 < 48 then 'h' || (c_custkey // 24)
            when c_custkey % 5 = 0 then 'p' || (c_custkey // 10) else 'u' || c_custkey end from customer
          union all
          select c_custkey, 'device', case when c_custkey % 15 = 7 then 'h' || (c_custkey // 30) else 'u' || c_custkey end from customer
          union all
          select c_custkey, 'ip', case when c_custkey % 2 = 0 then 'office' end from customer)
        where v is not null"""),
    "ev": ([], """
        select 'C' || lpad(user_id::varchar, 9, '0') as customer_id, ts as event_date,
               case event_type when 'signup' then 'payment' when 'click' then 'credit_limit_increase' else event_type end as event_type,
               least(value / 100, 1.0) as utilization_pct,
               regexp_extract(props, '"k": (\\d+)', 1)::double * 100 as credit_limit_at_time
        from events"""),
    "sc": ([], """
        select 'C' || lpad(c_custkey::varchar, 9, '0') as customer_id,
               (c_custkey * 37 % 1000) / 1000.0::double as risk, (c_custkey * 53 % 1000) / 1000.0::double as previous_risk
        from customer"""),
    "rev": ([], """
        select g as id, 'ring' as target_type, 'R-' || lpad((g + 1)::varchar, 4, '0') as target_id,
               ['confirm', 'dismiss', 'reset'][g % 3 + 1] as decision, 'note ' || g as note,
               members, included, make_timestamp((g + 1700000000) * 1000000) as created_at, (1 + g % 2)::int as model_version
        from (select c_custkey // 6 as g, list('C' || lpad(c_custkey::varchar, 9, '0') order by c_custkey) as members,
                     list('C' || lpad(c_custkey::varchar, 9, '0') order by c_custkey) filter (c_custkey % 6 < 4) as included
              from customer group by 1)
        union all
        select c_custkey + 1000000000, 'customer', 'C' || lpad(c_custkey::varchar, 9, '0'),
               ['dismiss', 'reset', 'confirm'][c_custkey % 3 + 1], null,
               ['C' || lpad(c_custkey::varchar, 9, '0')], ['C' || lpad(c_custkey::varchar, 9, '0')],
               make_timestamp((c_custkey + 1800000000) * 1000000), 2
        from customer where c_acctbal > 9000"""),
    "holders": (["lnk"], """
        select attribute_type, attribute_id, count(distinct customer_id) as customers from lnk group by all"""),
    "edge": (["lnk", "holders"], """
        select a.customer_id as source_customer_id, b.customer_id as target_customer_id,
               max((attribute_type = 'phone')::int) as shared_phone, max((attribute_type = 'email')::int) as shared_email,
               max((attribute_type = 'address')::int) as shared_address, max((attribute_type = 'device')::int) as shared_device,
               max((attribute_type = 'ip')::int) as shared_ip, count(distinct attribute_type) as shared_attribute_count
        from lnk a join lnk b using (attribute_type, attribute_id) join holders using (attribute_type, attribute_id)
        where a.customer_id < b.customer_id and customers <= 50 group by 1, 2"""),
    "sym": (["edge"], """
        select source_customer_id as customer_id, target_customer_id as other_id, * exclude (source_customer_id, target_customer_id) from edge
        union all
        select target_customer_id, source_customer_id, * exclude (source_customer_id, target_customer_id) from edge"""),
    "net": (["sym"], """
        select customer_id, sum(shared_phone)::bigint as phone_shared_count, sum(shared_email)::bigint as email_shared_count,
               sum(shared_address)::bigint as address_shared_count, sum(shared_device)::bigint as device_shared_count,
               sum(shared_ip)::bigint as ip_shared_count,
               count(*) as network_degree, sum(shared_attribute_count)::bigint as shared_attribute_count
        from sym group by 1"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the shared steps it needs, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for need in needs:
        add(need)
    steps = ",\n".join(f"{name} as ({SQL[name][1]})" for name in order)
    body = body.strip()
    # A body that opens with a comma brings further steps of its own.
    return f"with recursive {steps}\n{body}" if order else body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums depend on the order of addition."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return reduce(lambda d, c: d.withColumn(c, F.round(c, digits)), doubles, df)


# Shared steps that several areas check against.
SQL.update({
    "reach": (["sym"], """
        select customer_id as a, customer_id as b from sym
        union
        select r.a, s.other_id from reach r join sym s on s.customer_id = r.b"""),
    "comp": (["reach"], "select a as customer_id, min(b) as component_id from reach group by 1"),
    "ringm": (["comp"], """
        select printf('R-%04d', n) as ring_id, customer_id, size
        from comp join (select component_id, count(*) as size, row_number() over (order by count(*) desc, component_id) as n
                        from comp group by 1) using (component_id)"""),
    "scored": (["cust", "sc"], "select customer_id, label, risk, previous_risk from cust join sc using (customer_id)"),
    "lab": (["rev"], """
        select customer_id, mark as analyst_label from (
          select customer_id, arg_max(coalesce(mark, -1), id) as mark from (
            select id, unnest(members) as customer_id,
                   case when decision = 'reset' or (target_type = 'ring' and not list_contains(included, unnest(members))) then null
                        when decision = 'confirm' then 1 else 0 end as mark
            from rev) group by 1)
        where mark >= 0"""),
    "temporal": (["ev"], """
        select customer_id, count(*) as total_event_count,
               count(*) filter (event_type = 'purchase') as purchase_count,
               count(*) filter (event_type = 'payment') as payment_count,
               count(*) filter (event_type = 'credit_limit_increase') as limit_increase_count,
               count(distinct day) as distinct_event_dates, greatest(max(day) - min(day), 1) as event_span_days,
               count(*) / greatest(max(day) - min(day), 1) * 30 as events_per_30_days,
               max(same_day) as max_events_single_day, max(week) as max_events_7d,
               coalesce(min(gap), greatest(max(day) - min(day), 1)) as min_days_between_events,
               coalesce(avg(gap), greatest(max(day) - min(day), 1)) as mean_days_between_events,
               avg(utilization_pct) as mean_utilization_pct, max(utilization_pct) as max_utilization_pct,
               max(utilization_pct) - min(utilization_pct) as utilization_range, max(credit_limit_at_time)::bigint as max_credit_limit
        from (select *, count(*) over (partition by customer_id, day) as same_day,
                     count(*) over (partition by customer_id order by day range between current row and 6 following) as week,
                     day - lag(day) over (partition by customer_id order by event_date) as gap
              from (select *, date_diff('day', date '1970-01-01', event_date::date) as day from ev))
        group by 1"""),
    "ringsum": (["ringm", "cust", "sc"], """
        select ring_id, count(*) as size, round(avg(risk), 12) as score, max(risk) as max_risk, count(*) filter (risk >= 0.6) as n_high,
               (count(*) filter (risk >= 0.6) >= 2 or avg(risk) >= 0.6)::int as suspected,
               case when count(open_date) >= 2 then date_diff('day', min(open_date), max(open_date)) end as open_span_days,
               count(label) as n_labeled, count(*) filter (label = 1) as n_fraud
        from ringm join cust using (customer_id) join sc using (customer_id) group by 1"""),
    "deg": (["cust", "sym"], """
        select customer_id, count(other_id) + 1 as d from cust left join sym using (customer_id) group by 1"""),
    "adj": (["deg"], """
        select a.customer_id, a.other_id, 1 / sqrt(p.d * q.d) as weight
        from (select customer_id, other_id from sym union all select customer_id, customer_id from cust) a
        join deg p on p.customer_id = a.customer_id join deg q on q.customer_id = a.other_id"""),
    "true_rings": (["cust"], "select truth_ring from cust where truth_ring is not null group by 1 having count(*) >= 2"),
    "walk": (["sym"], """
        select 'C000000024' as customer_id, 0 as hop
        union
        select other_id, hop + 1 from walk join sym using (customer_id) where hop < 3"""),
    "status": (["rev"], """
        select target_id as ring_id, case decision when 'confirm' then 'confirmed' when 'dismiss' then 'dismissed' else 'pending' end as status,
               case when decision <> 'reset' then created_at end as reviewed_at, note
        from (select *, row_number() over (partition by target_id order by id desc) as rn from rev where target_type = 'ring') where rn = 1"""),
})


def graph_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, edges and rings, each made and written once.

    Every connected component is one ring: with no component above 50 none is split, so SQL can follow.
    """
    from kithgraph.operators import edges as e, rings as r
    from kithgraph.session import durable

    found_links = durable(links(spark, folder), "links")
    groups = durable(e.linking_groups(found_links), "groups")
    edges = durable(e.edges_from_groups(groups, TYPES), "edges")
    found = r.candidate_groups(edges, max_size=50, stars=e.stars_from_groups(groups))
    return found_links, edges, durable(r.number_rings(found), "membership")


def membership(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(spark, folder)[2]


def edges_of(spark: SparkSession, folder: str) -> DataFrame:
    from kithgraph.operators import edges as e

    return e.identity_edges(links(spark, folder), TYPES)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return customers(spark, folder).select("customer_id", "label").join(scores(spark, folder), "customer_id")


def flags(df: DataFrame) -> DataFrame:
    """Booleans as 0/1."""
    return df.withColumns({n: F.col(n).cast("int") for n, t in df.dtypes if t == "boolean"})
