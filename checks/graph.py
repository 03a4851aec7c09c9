"""Identity graph, components, neighbourhoods and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.operators import communities as CM, components as C, edges as E, features as FT, feedback as FB, neighbourhood as N, rings as R
from kithgraph.functions.values import risk_level
from kithgraph.session import durable
from kithgraph.settings import MAX_RING_SIZE

from . import fixtures as fx
from .fixtures import edges_of, flags, rounded, sql

THRESHOLD = 0.6
CENTRE = "C000000024"
RING = "R-0001"


def shared_counts(spark, d):
    """Which accounts are linked to how many others, and by what."""
    features = E.network_features(edges_of(spark, d))
    names = [c for c in features.columns if c != "customer_id"]
    return fx.customers(spark, d).select("customer_id", "name").join(features, "customer_id", "left").fillna(0, names)


def restricted_degree(spark, d):
    return E.network_features(E.restrict_edges(edges_of(spark, d), ["phone", "email"])).select(
        "customer_id", "network_degree", "shared_attribute_count"
    )


def evidence_between(spark, d):
    """Values in common per linked pair; the office address counts although it makes no edge."""
    return E.shared_evidence(edges_of(spark, d), fx.links(spark, d)).select(*E.ENDS, "attribute_type", "attribute_value")


def components(spark, d):
    return C.component_of(fx.customers(spark, d), durable(edges_of(spark, d), "edges"))


def split_groups(spark, d):
    return C.split_groups(fx.customers(spark, d), edges_of(spark, d))


def neighbour_list(spark, d):
    return N.neighbours(edges_of(spark, d), CENTRE).select("other_id", F.array_join("types", ",").alias("types"), "weight")


def high_risk_neighbours(spark, d):
    levels = fx.scores(spark, d).select("customer_id", risk_level(F.col("risk"), THRESHOLD).alias("level"))
    return N.high_risk_neighbours(edges_of(spark, d), levels)


def ego_network(spark, d):
    return N.ego_network(durable(edges_of(spark, d), "edges"), CENTRE, hops=3, max_nodes=30)[0]


def induced(spark, d):
    fraud = fx.customers(spark, d).filter("label = 1")
    return E.induced_subgraph(fraud, edges_of(spark, d)).select(*E.ENDS, "shared_attribute_count")


def adjacency(spark, d):
    return rounded(FT.normalised_adjacency(fx.customers(spark, d), edges_of(spark, d)))


def propagated(spark, d):
    """Income after two steps of neighbourhood averaging."""
    c = fx.customers(spark, d)
    start = FT.standardised(c.select("customer_id", "income"), ["income"])
    return rounded(FT.propagate(FT.normalised_adjacency(c, edges_of(spark, d)), start, ["income"], 2), 5)


def _summary(spark, d):
    links, edges, m = fx.graph_of(spark, d)
    return R.summarise_rings(m, edges, links, fx.customers(spark, d), fx.scores(spark, d), THRESHOLD), m


def ring_summary(spark, d):
    s, _ = _summary(spark, d)
    types = F.array_join(F.transform("shared_types", lambda e: F.concat(e["type"], F.lit("="), e["edges"].cast("string"))), ",")
    return rounded(flags(s.select(
        "ring_id", "size", "n_edges", "density", "score", "max_risk", "n_high", "suspected",
        F.col("open_span_days").cast("bigint").alias("open_span_days"), types.alias("shared_types"), "n_labeled", "n_fraud",
        "dominant_truth_ring", "dominant_count",
    )))


def ring_evidence(spark, d):
    rows = R.ring_evidence(fx.membership(spark, d), fx.links(spark, d))
    return rows.select("ring_id", "attribute_type", "attribute_id", "value", "members", F.col("position").cast("bigint").alias("position"))


def ring_members_ordered(spark, d):
    return rounded(R.members_in_order(fx.membership(spark, d), fx.scores(spark, d)))


def ring_quality(spark, d):
    s, m = _summary(spark, d)
    return rounded(R.detection_quality(durable(s, "rings"), m, fx.customers(spark, d)))


def ring_connectivity(spark, d):
    truth = fx.customers(spark, d).filter("truth_ring is not null").select("customer_id", F.col("truth_ring").alias("ring_id"))
    return rounded(R.connectivity_report(truth, edges_of(spark, d)))


def default_members(spark, d):
    return flags(FB.suggested_members(fx.membership(spark, d), fx.scores(spark, d), THRESHOLD))


def boundary(spark, d):
    """Outside accounts with most links into a ring: rings here are blocks of six keys."""
    blocks = fx.table(spark, d, "customer").select(
        fx.cid(F.col("c_custkey")).alias("customer_id"), F.format_string("R-%04d", F.expr("c_custkey div 6") + 1).alias("ring_id")
    )
    return N.boundary_accounts(blocks, durable(edges_of(spark, d), "edges"), RING)


def community_rings(spark, d):
    """Ring candidates with large components split into communities."""
    return R.number_rings(R.candidate_groups(durable(edges_of(spark, d), "edges")))


def community_checks(spark, d):
    """What must hold for the communities of every component above the size of a ring, counted by plain SQL over the stored result.

    Every account is in one community of its component, every ring has two members or more, no community is torn, and no
    account would raise the modularity of its component by moving to another community.
    """
    edges = durable(edges_of(spark, d).select(*E.ENDS, "shared_attribute_count"), "edges")
    found = durable(C.connected_components(edges), "components")
    sizes = found.groupBy("component_id").agg(F.count("*").alias("size")).filter(F.col("size") > MAX_RING_SIZE)
    large = durable(found.join(sizes, "component_id").select("customer_id", "component_id", "size"), "large")
    inner = durable(E.induced_subgraph(large, edges), "inner")
    nodes = CM.modularity_partition(inner, large.select("customer_id", "component_id"))[0]
    nodes = durable(nodes.select("node", "community", "component_id"), "nodes")
    together = spark.sql("""
        select source_customer_id, target_customer_id from {n} a join {e} on a.node = source_customer_id
        join {n} b on b.node = target_customer_id and b.community = a.community""", e=inner, n=nodes)
    parts = durable(C.connected_components(together), "parts")
    return spark.sql("""
        with both as (select source_customer_id as node, target_customer_id as other, double(shared_attribute_count) as w from {e}
                      union all select target_customer_id, source_customer_id, double(shared_attribute_count) from {e}),
        strength as (select node, sum(w) as k from both group by node),
        mass as (select community, sum(k) as mass from {n} join strength using (node) group by community),
        total as (select component_id, sum(k) as total from {n} join strength using (node) group by component_id),
        links as (select b.node, o.community, sum(w) as w from both b join {n} o on o.node = b.other group by b.node, o.community),
        stay as (select n.node, n.component_id, n.community, k, total, coalesce(l.w, 0) / total - k * (mass - k) / total / total as worth
                 from {n} n join strength s on s.node = n.node join mass m on m.community = n.community join total t on t.component_id = n.component_id
                 left join links l on l.node = n.node and l.community = n.community),
        gains as (select s.component_id, count(distinct s.node) as gaining from stay s join links l on l.node = s.node and l.community <> s.community
                  join mass m on m.community = l.community where l.w / total - k * mass / total / total > worth + 1e-12 group by s.component_id),
        torn as (select component_id, count(*) as torn from (select n.component_id, n.community from {n} n join {p} p on p.customer_id = n.node
                 group by n.component_id, n.community having count(distinct p.component_id) > 1) group by component_id),
        placed as (select component_id, count(*) as placed, count(distinct node) as accounts from {n} group by component_id)
        select c.component_id, c.size, placed, accounts, coalesce(gaining, 0) as gaining, coalesce(torn, 0) as torn
        from (select distinct component_id, size from {l}) c left join placed using (component_id) left join gains using (component_id)
        left join torn using (component_id)""", e=inner, n=nodes, p=parts, l=large)


QUERIES = {
    "shared_counts": shared_counts,
    "identity_edges": edges_of,
    "value_holders": lambda s, d: E.value_holders(E.link_set(fx.links(s, d))),
    "hub_report": lambda s, d: E.hub_report(fx.links(s, d)),
    "restricted_degree": restricted_degree,
    "graph_statistics": lambda s, d: E.graph_statistics(fx.customers(s, d), durable(edges_of(s, d), "edges")),
    "link_holders": lambda s, d: flags(E.link_holders(fx.links(s, d))),
    "evidence_between": evidence_between,
    "attribute_pivot": lambda s, d: FT.pivot_attributes(fx.links(s, d), fx.TYPES),
    "components": components,
    "split_groups": split_groups,
    "neighbour_list": neighbour_list,
    "high_risk_neighbours": high_risk_neighbours,
    "ego_network": ego_network,
    "induced_subgraph": induced,
    "normalised_adjacency": adjacency,
    "propagated_income": propagated,
    "ring_membership": lambda s, d: fx.membership(s, d),
    "ring_summary": ring_summary,
    "ring_evidence": ring_evidence,
    "ring_members_ordered": ring_members_ordered,
    "ring_quality": ring_quality,
    "ring_connectivity": ring_connectivity,
    "default_members": default_members,
    "boundary_accounts": boundary,
    "community_rings": community_rings,
    "community_checks": community_checks,
}

SQL = {
    "community_checks": sql(f"""
        select component_id, count(*) as size, count(*) as placed, count(*) as accounts, 0::bigint as gaining, 0::bigint as torn
        from comp group by 1 having count(*) > {MAX_RING_SIZE}""", "comp"),
    "shared_counts": sql("""
        select customer_id, name, coalesce(phone_shared_count, 0) as phone_shared_count,
               coalesce(email_shared_count, 0) as email_shared_count, coalesce(address_shared_count, 0) as address_shared_count,
               coalesce(device_shared_count, 0) as device_shared_count, coalesce(ip_shared_count, 0) as ip_shared_count,
               coalesce(network_degree, 0) as network_degree, coalesce(shared_attribute_count, 0) as shared_attribute_count
        from cust left join net using (customer_id)""", "cust", "net"),
    "identity_edges": sql("select * replace (shared_attribute_count::int as shared_attribute_count) from edge", "edge"),
    "value_holders": sql("select * from holders", "holders"),
    "hub_report": sql("""
        select attribute_type, min(attribute_value) as value, count(distinct customer_id) as customers
        from lnk group by attribute_type, attribute_id having count(distinct customer_id) > 50
        order by customers desc, attribute_id limit 10""", "lnk"),
    "restricted_degree": sql("""
        select customer_id, count(*) as network_degree, sum(shared_phone + shared_email)::bigint as shared_attribute_count
        from sym where shared_phone + shared_email > 0 group by 1""", "sym"),
    "graph_statistics": sql("""
        select (select count(*) from cust) as n_nodes, count(*) as n_edges, sum(shared_phone)::bigint as edges_phone,
               sum(shared_email)::bigint as edges_email, sum(shared_address)::bigint as edges_address,
               sum(shared_device)::bigint as edges_device, sum(shared_ip)::bigint as edges_ip,
               (select count(distinct customer_id) from sym) as linked_customers,
               count(*) filter (a.label = 0 and b.label = 0) as legit_legit,
               count(*) filter (a.label = 1 and b.label = 1) as fraud_fraud, count(*) filter (a.label <> b.label) as mixed
        from edge join cust a on a.customer_id = source_customer_id join cust b on b.customer_id = target_customer_id""", "sym", "cust"),
    "link_holders": sql("""
        select lnk.*, customers - 1 as shared_with, (customers > 50)::int as ignored
        from lnk join holders using (attribute_type, attribute_id)""", "holders"),
    "evidence_between": sql("""
        select source_customer_id, target_customer_id, a.attribute_type, b.attribute_value
        from edge join lnk a on a.customer_id = source_customer_id
        join lnk b on b.customer_id = target_customer_id and a.attribute_type = b.attribute_type and a.attribute_id = b.attribute_id""", "edge"),
    "attribute_pivot": sql("""
        select customer_id, min(attribute_id) filter (attribute_type = 'phone') as phone, min(attribute_id) filter (attribute_type = 'email') as email,
               min(attribute_id) filter (attribute_type = 'address') as address, min(attribute_id) filter (attribute_type = 'device') as device,
               min(attribute_id) filter (attribute_type = 'ip') as ip from lnk group by 1""", "lnk"),
    "components": sql("""
        select customer_id, coalesce(component_id, customer_id) as component_id
        from cust left join comp using (customer_id)""", "cust", "comp"),
    "split_groups": sql("select customer_id, coalesce(truth_ring, customer_id) as group_id from cust", "cust"),
    "neighbour_list": sql(f"""
        select other_id, concat_ws(',', case when shared_phone > 0 then 'phone' end, case when shared_email > 0 then 'email' end,
               case when shared_address > 0 then 'address' end, case when shared_device > 0 then 'device' end,
               case when shared_ip > 0 then 'ip' end) as types, shared_attribute_count::int as weight
        from sym where customer_id = '{CENTRE}'""", "sym"),
    "high_risk_neighbours": sql("""
        select sym.customer_id, count(*) filter (risk >= 0.6) as high_neighbors
        from sym join sc on sc.customer_id = sym.other_id group by 1""", "sym", "sc"),
    "ego_network": sql("select customer_id, min(hop)::int as hop from walk group by 1 order by hop, customer_id limit 30", "walk"),
    "induced_subgraph": sql("""
        select source_customer_id, target_customer_id, shared_attribute_count::int as shared_attribute_count from edge
        where source_customer_id in (select customer_id from cust where label = 1)
          and target_customer_id in (select customer_id from cust where label = 1)""", "edge", "cust"),
    "normalised_adjacency": sql("select customer_id, other_id, round(weight, 6) as weight from adj", "adj"),
    "propagated_income": sql("""
        , z as (select customer_id, (v - avg(v) over ()) / stddev_pop(v) over () as x from (select customer_id, ln(1 + greatest(income, 0)) as v from cust)),
        one as (select adj.customer_id, sum(weight * x) as x from adj join z on z.customer_id = adj.other_id group by 1)
        select adj.customer_id, round(sum(weight * x), 5) as income from adj join one on one.customer_id = adj.other_id group by 1""", "adj"),
    "ring_membership": sql("select * from ringm", "ringm"),
    "ring_summary": sql("""
        select s.ring_id, s.size, coalesce(e.n_edges, 0) as n_edges, round(coalesce(e.n_edges, 0) / (s.size * (s.size - 1) / 2), 6) as density,
               round(score, 6) as score, round(max_risk, 6) as max_risk, n_high, suspected, open_span_days, shared_types, n_labeled, n_fraud,
               truth_ring as dominant_truth_ring, coalesce(n, 0) as dominant_count
        from ringsum s
        left join (
          select ring_id, max(n_edges) as n_edges, string_agg(t || '=' || c, ',' order by c desc, i) as shared_types from (
            select m.ring_id, count(*) as n_edges, unnest([sum(shared_phone), sum(shared_email), sum(shared_address), sum(shared_device), sum(shared_ip)])::bigint as c,
                   unnest(['phone', 'email', 'address', 'device', 'ip']) as t, unnest([1, 2, 3, 4, 5]) as i
            from edge join ringm m on m.customer_id = source_customer_id join ringm o on o.customer_id = target_customer_id and o.ring_id = m.ring_id
            group by 1) where c > 0 group by 1) e using (ring_id)
        left join (
          select ring_id, truth_ring, n from (
            select ring_id, truth_ring, count(*) as n, row_number() over (partition by ring_id order by count(*) desc, truth_ring desc) as rn
            from ringm join cust using (customer_id) where truth_ring is not null group by 1, 2) where rn = 1) t using (ring_id)""", "ringsum", "edge"),
    "ring_evidence": sql("""
        select * from (
          select *, row_number() over (partition by ring_id order by members desc, attribute_type, attribute_id) as position from (
            select ring_id, attribute_type, attribute_id, min(attribute_value) as value, count(distinct customer_id) as members
            from lnk join ringm using (customer_id) group by 1, 2, 3 having count(distinct customer_id) >= 2))
        where position <= 12""", "ringm", "lnk"),
    "ring_members_ordered": sql("""
        select ring_id, customer_id, round(risk, 6) as risk, row_number() over (partition by ring_id order by risk desc, customer_id) as position
        from ringm join sc using (customer_id)""", "ringm", "sc"),
    "ring_quality": sql("""
        select count(*) as n_candidates, count(*) filter (suspected = 1) as n_suspected,
               round(count(*) filter (suspected = 1 and n_fraud > size / 2) / count(*) filter (suspected = 1), 6) as precision,
               (select count(*) from cust where label = 1) as n_fraud_customers,
               (select round(count(*) filter (ring_id in (select ring_id from ringsum where suspected = 1)) / count(*), 6)
                from cust left join ringm using (customer_id) where label = 1) as member_recall,
               (select count(*) from true_rings) as n_true_rings,
               (select round(count(*) / (select count(*) from true_rings), 6) from true_rings where truth_ring in (
                  select truth_ring from cust join ringm using (customer_id) where truth_ring is not null
                  and ring_id in (select ring_id from ringsum where suspected = 1) group by truth_ring, ring_id having count(*) >= 2)) as ring_recall
        from ringsum""", "ringsum", "true_rings"),
    "ring_connectivity": sql("""
        select ring_id, sum(total)::bigint as total_pairs, sum(connected)::bigint as connected_pairs,
               round(coalesce(sum(connected) / nullif(sum(total), 0), 0), 6) as ratio
        from (select truth_ring as ring_id, count(*) * (count(*) - 1) // 2 as total, 0 as connected from cust where truth_ring is not null group by 1
              union all
              select a.truth_ring, 0, count(*) from edge join cust a on a.customer_id = source_customer_id
              join cust b on b.customer_id = target_customer_id and a.truth_ring = b.truth_ring group by 1)
        group by rollup (ring_id)""", "cust", "edge"),
    "default_members": sql("""
        select ring_id, customer_id, (risk >= 0.3 or not bool_or(risk >= 0.3) over (partition by ring_id))::int as suggested
        from ringm join sc using (customer_id)""", "ringm", "sc"),
    "boundary_accounts": sql("""
        select other_id as customer_id, count(*) as links from sym
        where customer_id in (select 'C' || lpad(c_custkey::varchar, 9, '0') from customer where c_custkey // 6 = 0)
          and other_id not in (select 'C' || lpad(c_custkey::varchar, 9, '0') from customer where c_custkey // 6 = 0)
        group by 1 order by links desc, customer_id limit 40""", "sym"),
}
