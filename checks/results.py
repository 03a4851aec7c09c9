"""Feedback, explanations and read queries over result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.functions import phrases as P
from kithgraph.functions.values import risk_level
from kithgraph.operators import attribution as AT, edges as E, explain as X, feedback as FB, neighbourhood as N, rings as R, views as V
from kithgraph.operators.metrics import risk_ranks
from kithgraph.operators.ordered import with_rank_within
from kithgraph.operators.scoring import effective_labels
from kithgraph.session import durable
from kithgraph.sources import sinks

from . import fixtures as fx
from .fixtures import flags, rounded, sql
from .scores import feature_table

T = 0.6
WHO = "C000000024"
RING = "R-0003"


def results(spark, d, membership=None, edges=None):
    """Scored customers as the result table holds them."""
    edges = durable(fx.edges_of(spark, d), "edges") if edges is None else edges
    membership = fx.membership(spark, d) if membership is None else membership
    s = fx.scores(spark, d).select("customer_id", "risk", risk_level(F.col("risk"), T).alias("risk_level"))
    ranked = risk_ranks(s)
    degree = E.network_features(edges).select("customer_id", F.col("network_degree").alias("degree"))
    high = N.high_risk_neighbours(edges, s.withColumnRenamed("risk_level", "level"))
    return (
        fx.customers(spark, d).join(ranked, "customer_id")
        .join(membership.select("customer_id", "ring_id"), "customer_id", "left")
        .join(degree, "customer_id", "left").join(high, "customer_id", "left")
        .withColumn("top_reason", F.concat("risk_level", F.lit(" risk"))).fillna(0, ["degree", "high_neighbors"])
    )


def rings(spark, d, membership):
    return R.ring_scores(membership, fx.customers(spark, d), fx.scores(spark, d), T)


def ring_queue(spark, d):
    m = fx.membership(spark, d)
    return durable(rings(spark, d, m), "rings"), m


def statuses(spark, d):
    return FB.ring_statuses(fx.reviews(spark, d)).withColumn("reviewed_at", F.unix_seconds("reviewed_at"))


def latest(spark, d):
    return FB.latest_reviews(fx.reviews(spark, d)).select("target_type", "target_id", "id", "decision", "note", "model_version")


def effective(spark, d):
    labels = FB.feedback_labels(fx.reviews(spark, d))
    return effective_labels(fx.customers(spark, d).select("customer_id", "label"), labels).select("customer_id", "label")


def history(spark, d):
    rows = V.fb.review_history(fx.reviews(spark, d), WHO)
    return flags(rows.withColumn("created_at", F.unix_seconds("created_at")))


def clauses(spark, d):
    """One sentence part per customer and feature value."""
    table = feature_table(spark, d).join(fx.scores(spark, d).select("customer_id", "risk"), "customer_id")
    names = [c for c in table.columns if c not in ("customer_id", "risk")]
    long = table.unpivot(["customer_id", "risk"], names, "feature", "value")
    return long.select("customer_id", "feature", P.clause(F.col("feature"), F.col("value"), F.col("risk") >= 0.5, F.col("feature")).alias("clause"))


MODEL = {"network_degree": 37, "phone_shared_count": 59, "total_event_count": 83, "max_utilization_pct": 101}


def contributions(spark, d):
    """Deterministic contributions of four features."""
    key = F.substring("customer_id", 2, 9).cast("bigint")
    table = feature_table(spark, d).withColumns({f"phi_{f}": ((key * m) % 200 - 100) / 400.0 for f, m in MODEL.items()})
    return table.withColumn("contributions", X.contribution_array(list(MODEL), {}))


def explained(spark, d):
    m = fx.membership(spark, d)
    edges = durable(fx.edges_of(spark, d), "edges")
    s = fx.scores(spark, d).select("customer_id", "risk", risk_level(F.col("risk"), T).alias("level"))
    about = rings(spark, d, m).join(R.edge_summary(m, edges), "ring_id", "left").select("ring_id", F.struct(
        "ring_id", "size", "n_high", "suspected", F.coalesce(F.transform("shared_types", lambda e: e["type"]), F.array().cast("array<string>")).alias("shared_types"),
    ).alias("ring"))
    counts = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(f"{t}_shared_count").cast("bigint").alias("count")) for t in fx.TYPES])
    table = (
        contributions(spark, d).select("customer_id", "contributions", counts.alias("shared_counts"), F.col("network_degree").cast("bigint").alias("degree"))
        .join(s, "customer_id").join(N.high_risk_neighbours(edges, s), "customer_id", "left").fillna(0, ["high_neighbors"])
        .join(FB.feedback_labels(fx.reviews(spark, d)), "customer_id", "left")
        .join(m.select("customer_id", "ring_id").join(about, "ring_id"), "customer_id", "left")
    )
    return X.explain_customers(table)


def explanations(spark, d):
    return explained(spark, d).select("customer_id", "score", "summary", F.array_join("context", " | ").alias("context"), "top_reason")


def ring_sentences(spark, d):
    m = fx.membership(spark, d)
    table = rings(spark, d, m).join(R.evidence_arrays(R.ring_evidence(m, fx.links(spark, d))), "ring_id", "left")
    return table.select("ring_id", X.ring_explanation().alias("explanation"))


def stored(spark, d):
    rows = contributions(spark, d).select("customer_id", F.posexplode(X.stored_contributions(F.col("contributions"))).alias("place", "c"))
    return rows.select("customer_id", "place", "c.feature", "c.group", "c.impact")


def importance(spark, d):
    return rounded(AT.importance(contributions(spark, d), list(MODEL), {f: X.feature_group(f) for f in MODEL}, {}))


def group_importance(spark, d):
    by_feature = AT.importance(contributions(spark, d), list(MODEL), {f: X.feature_group(f) for f in MODEL}, {})
    return rounded(AT.group_importance(by_feature))


def _labels(spark, d):
    return FB.feedback_labels(fx.reviews(spark, d))


def customer_page(spark, d):
    r = results(spark, d)
    return V.customer_page(r, _labels(spark, d), q="c00000", level="medium", reviewed="unreviewed", sort="degree", limit=40, offset=10)[1]


def customer_total(spark, d):
    return V.customer_page(results(spark, d), _labels(spark, d), q="c00000", level="medium", reviewed="unreviewed")[0]


def reviewed_fraud(spark, d):
    return V.briefs(V.matching_customers(results(spark, d), _labels(spark, d), reviewed="fraud"), _labels(spark, d))


def ring_page(spark, d):
    table, m = ring_queue(spark, d)
    c = fx.customers(spark, d).join(m.select("customer_id", "ring_id"), "customer_id", "left")
    page = V.ring_page(table, c, fx.reviews(spark, d), status="pending", scope="all", q="00012")[1]
    return rounded(flags(page.select("ring_id", "size", "score", "suspected", "status", "review_note")))


def status_counts(spark, d):
    table, m = ring_queue(spark, d)
    return V.ring_page(table, fx.customers(spark, d).withColumn("ring_id", F.lit(None).cast("string")), fx.reviews(spark, d), scope="other")[0]


def top_rings(spark, d):
    table, _ = ring_queue(spark, d)
    return rounded(table.filter("suspected").orderBy(*N.queue_order()).limit(6).select("ring_id", "size", "score"))


def queue_links(spark, d):
    table, _ = ring_queue(spark, d)
    placed = with_rank_within(table.select("suspected", "score", "size", "ring_id"), ["suspected"], N.queue_order(), "place")
    return flags(V.queue_links(placed))


def connections(spark, d):
    edges = durable(fx.edges_of(spark, d), "edges")
    rows = V.connections(results(spark, d, edges=edges), edges, _labels(spark, d), WHO)
    return rounded(rows.withColumn("types", F.array_join("types", ",")))


def connection_evidence(spark, d):
    return V.connection_evidence(fx.edges_of(spark, d), fx.links(spark, d), WHO)


def ring_members(spark, d):
    m = fx.membership(spark, d)
    return rounded(flags(V.ring_members(results(spark, d, m), m, _labels(spark, d), T, RING)))


def ring_graph(spark, d):
    m = fx.membership(spark, d)
    nodes, inner = N.ring_graph(m, durable(fx.edges_of(spark, d), "edges"), RING)
    ends = inner.select(F.explode(F.array(*E.ENDS)).alias("customer_id")).groupBy("customer_id").agg(F.count("*").alias("links"))
    return flags(nodes.join(ends, "customer_id", "left").fillna(0))


def _network(spark, d):
    table, m = ring_queue(spark, d)
    return N.network_view(V.with_status(table, fx.reviews(spark, d)), m, durable(fx.edges_of(spark, d), "edges"), min_score=0.3, types=["phone", "email"], max_nodes=60)


def network_rings(spark, d):
    return rounded(_network(spark, d)[0].select("ring_id", "size", "score", "running"))


def network_nodes(spark, d):
    return _network(spark, d)[1]


def network_edges(spark, d):
    return _network(spark, d)[2].select(*E.ENDS, F.array_join("types", ",").alias("types"))


def runs(spark, d):
    c = fx.table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("dataset_id"), (F.col("c_nationkey") + 1).alias("version")).agg(
        F.round(F.avg("c_acctbal") / 10000, 6).alias("roc_auc"), F.count("*").alias("n_feedback")
    )


def export(spark, d):
    r = results(spark, d).join(_labels(spark, d), "customer_id", "left")
    summary = F.when(F.col("degree") == 0, F.concat(F.lit("=risk "), "risk_level")).otherwise(F.concat(F.lit("risk "), "risk_level"))
    return sinks.customer_export(r.withColumn("summary", summary))


def json_columns(spark, d):
    """Nested columns through JSON text and back."""
    r = fx.reviews(spark, d).select("id", F.to_json("members").alias("members"))
    return sinks.from_json_columns(r, {"members": "array<string>"}).select("id", F.size("members").alias("n"), F.array_join("members", ",").alias("members"))


def without_dataset(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset_id"))
    return sinks.without_dataset(c, "BUILDING")


QUERIES = {
    "feedback_labels": lambda s, d: _labels(s, d),
    "ring_statuses": statuses,
    "latest_reviews": latest,
    "feedback_summary": lambda s, d: flags(FB.feedback_summary(fx.reviews(s, d), 2, 5)),
    "effective_labels": effective,
    "review_history": history,
    "unknown_members": lambda s, d: FB.unknown_members(
        fx.reviews(s, d).filter("target_type = 'ring'").select(F.col("target_id").alias("ring_id"), F.explode("members").alias("customer_id")), fx.membership(s, d)),
    "clauses": clauses,
    "explanations": explanations,
    "ring_sentences": ring_sentences,
    "stored_contributions": stored,
    "feature_importance": importance,
    "group_importance": group_importance,
    "customer_page": customer_page,
    "customer_total": customer_total,
    "reviewed_fraud": reviewed_fraud,
    "top_customers": lambda s, d: V.top_customers(results(s, d), _labels(s, d)),
    "top_rings": top_rings,
    "ring_page": ring_page,
    "ring_status_counts": status_counts,
    "ring_neighbours": lambda s, d: V.ring_neighbours(ring_queue(s, d)[0], RING),
    "queue_links": queue_links,
    "customer_events": lambda s, d: rounded(V.customer_events(fx.events(s, d), WHO).withColumn("event_date", F.to_date("event_date").cast("string"))),
    "connections": connections,
    "connection_evidence": connection_evidence,
    "ring_members": ring_members,
    "ring_graph": ring_graph,
    "network_rings": network_rings,
    "network_nodes": network_nodes,
    "network_edges": network_edges,
    "review_progress": lambda s, d: V.review_progress(ring_queue(s, d)[0], fx.reviews(s, d)),
    "version_history": lambda s, d: rounded(V.version_history(runs(s, d))),
    "dataset_list": lambda s, d: V.dataset_list(
        fx.table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("dataset_id")).agg(F.count("*").alias("n_customers")), runs(s, d)),
    "customer_export": export,
    "json_columns": json_columns,
    "without_dataset": without_dataset,
    "edges_for_people": lambda s, d: V.edges_for_people(fx.edges_of(s, d)).withColumn("types", F.array_join("types", ",")),
}

_LEVEL = "case when risk >= 0.6 then 'high' when risk >= 0.3 then 'medium' else 'low' end"
_TYPES = ("concat_ws(',', case when shared_phone > 0 then 'phone' end, case when shared_email > 0 then 'email' end, case when shared_address > 0 then 'address' end, "
          "case when shared_device > 0 then 'device' end, case when shared_ip > 0 then 'ip' end)")
_N = "round_even(value, 0)::bigint"


def _s(one, many=None):
    return f"case when {_N} = 1 then '{one}' else '{many or one + 's'}' end"


def _shared(kind, article, noun):
    return (f"when '{kind}_shared_count' then case when {_N} > 0 then 'shares {article} with ' || {_N} || ' other ' || {_s('account')} "
            f"when not raised then 'doesn''t share its {noun} with any other account' end ")


_NUM = "case when abs(value - round_even(value, 0)) < 1e-9 then format('{:,}', round_even(value, 0)::bigint) else format('{:,.2f}', value) end"
_CLAUSE = f"""case feature
    {_shared('phone', 'a phone number', 'phone number')} {_shared('email', 'an email address', 'email address')}
    {_shared('address', 'an address', 'address')} {_shared('device', 'a device', 'device')} {_shared('ip', 'an IP address', 'IP address')}
    when 'network_degree' then case when {_N} > 0 then 'is linked to ' || {_N} || ' other ' || {_s('account')} || ' through shared identity details'
         when not raised then 'isn''t linked to any other account' end
    when 'shared_attribute_count' then case when {_N} > 0 then 'has ' || {_N} || ' overlapping identity ' || {_s('link')} || ' with other accounts'
         when not raised then 'has no identity details in common with other accounts' end
    when 'total_event_count' then 'has ' || {_N} || ' account ' || {_s('event')} || ' on record'
    when 'purchase_count' then case when {_N} = 0 then 'hasn''t made any purchases' else 'made ' || {_N} || ' ' || {_s('purchase')} end
    when 'payment_count' then case when {_N} = 0 then 'hasn''t made any payments' else 'made ' || {_N} || ' ' || {_s('payment')} end
    when 'limit_increase_count' then case when {_N} = 0 then 'hasn''t received any credit-limit increases' else 'received ' || {_N} || ' credit-limit ' || {_s('increase')} end
    when 'distinct_event_dates' then 'was active on ' || {_N} || ' different ' || {_s('day')}
    when 'event_span_days' then 'has account activity spanning ' || {_N} || ' ' || {_s('day')}
    when 'events_per_30_days' then 'averages ' || format('{{:.1f}}', value) || ' account events per 30 days'
    when 'max_events_single_day' then 'had at most ' || {_N} || ' account ' || {_s('event')} || ' on a single day'
    when 'max_events_7d' then 'had at most ' || {_N} || ' account ' || {_s('event')} || ' in any 7-day window'
    when 'min_days_between_events' then 'had account events as little as ' || {_N} || ' ' || {_s('day')} || ' apart'
    when 'mean_days_between_events' then 'averages ' || format('{{:.1f}}', value) || ' days between account events'
    when 'mean_utilization_pct' then 'ran an average credit utilization of ' || round_even(value * 100, 0)::bigint || '%'
    when 'max_utilization_pct' then 'reached a peak credit utilization of ' || round_even(value * 100, 0)::bigint || '%'
    when 'utilization_range' then case when round_even(value * 100, 0) = 0 then 'kept the same credit utilization throughout'
         else 'had its credit utilization swing by ' || round_even(value * 100, 0)::bigint || ' percentage points' end
    when 'max_credit_limit' then 'reached a credit limit of ' || {_NUM}
    else 'has ' || feature || ' of ' || {_NUM} end"""


def _spoken(items):
    return (f"case len({items}) when 0 then '' when 1 then {items}[1] when 2 then {items}[1] || ' and ' || {items}[2] "
            f"else {items}[1] || ', ' || {items}[2] || ' and ' || {items}[3] end")


_CAP = "upper({0}[1]) || substr({0}, 2)"
_NOUN = "case {0} when 'phone' then 'phone number' when 'email' then 'email address' when 'ip' then 'IP address' else {0} end"

fx.SQL.update({
    "res": (["cust", "sc", "ringm", "net", "sym"], f"""
        select cust.*, risk, {_LEVEL} as risk_level, row_number() over (order by risk desc, customer_id) as rank, ring_id,
               coalesce(network_degree, 0) as degree, coalesce(high, 0) as high_neighbors, {_LEVEL} || ' risk' as top_reason
        from cust join sc using (customer_id) left join ringm using (customer_id) left join net using (customer_id)
        left join (select sym.customer_id, count(*) filter (risk >= 0.6) as high from sym join sc on sc.customer_id = other_id group by 1) h using (customer_id)"""),
    "contrib": (["ftab"], "select * from (" + " union all ".join(
        f"select customer_id, {i} as place, '{f}' as feature, {f} as value, ((substr(customer_id, 2)::bigint * {m}) % 200 - 100) / 400.0::double as delta from ftab"
        for i, (f, m) in enumerate(MODEL.items())) + ")"),
    "said": (["contrib"], f"""
        select *, round(delta * 100, 2) as impact from (select *, {_CLAUSE} as clause from (select *, delta > 0 as raised from contrib))
        where abs(delta) >= 0.02 and clause is not null"""),
    "told": (["said", "res", "lab", "ringsum", "edge"], f"""
        select res.*, analyst_label, coalesce(ups, []) as ups, coalesce(downs, []) as downs, coalesce(fup, []) || coalesce(fdown, [])[:3] as named, top_impact,
               round_even(risk * 100, 0)::bigint as score, s.size as ring_size, s.n_high as ring_high, s.suspected as ring_suspected, kinds
        from res left join lab using (customer_id) left join ringsum s using (ring_id)
        left join (select customer_id, list(clause order by -impact, place) filter (raised) as ups, list(feature order by -impact, place) filter (raised) as fup,
                          max(impact) filter (raised) as top_impact,
                          list(clause order by impact, place)[:3] filter (not raised) as downs, list(feature order by impact, place) filter (not raised) as fdown
                   from said group by 1) using (customer_id)
        left join (select ring_id, list(noun order by c desc, i)[:3] as kinds from (
                     select m.ring_id, unnest([sum(shared_phone), sum(shared_email), sum(shared_address), sum(shared_device), sum(shared_ip)]) as c,
                            unnest(['phone number', 'email address', 'address', 'device', 'IP address']) as noun, unnest([1, 2, 3, 4, 5]) as i
                     from edge join ringm m on m.customer_id = source_customer_id join ringm o on o.customer_id = target_customer_id and o.ring_id = m.ring_id
                     group by 1) where c > 0 group by 1) using (ring_id)"""),
})
fx.SQL["told"] = (fx.SQL["told"][0], fx.SQL["told"][1].replace("list(clause order by impact, place)[:3] filter (not raised)", "list(clause order by impact, place) filter (not raised)").replace("list(noun order by c desc, i)[:3]", "list(noun order by c desc, i)"))

_BRIEF = "customer_id, name, risk, risk_level, rank, ring_id, degree, high_neighbors, top_reason, label, analyst_label"
_SUMMARY = f"""case
    when risk_level = 'high' and len(ups) > 0 then 'High risk (' || score || '/100): flagged because it ' || {_spoken('ups[:3]')} || '.'
    when risk_level = 'high' then 'High risk (' || score || '/100): flagged by a combination of weaker signals rather than one clear reason.'
    when risk_level = 'medium' then case when len(ups) > 0 then 'Medium risk (' || score || '/100): worth a look because it ' || {_spoken('ups[:2]')} || '.'
         else 'Medium risk (' || score || '/100): no single strong signal, but several small ones add up.' end
         || case when len(downs) > 0 then ' In its favour: it ' || downs[1] || '.' else '' end
    when len(ups) + len(downs) > 0 then 'Low risk (' || score || '/100): below the alert threshold.'
         || case when len(downs) > 0 then ' In its favour: it ' || {_spoken('downs[:2]')} || '.' else '' end
         || case when top_impact >= 5 then ' Still worth noting: it ' || ups[1] || '.' else '' end
    when degree = 0 then 'Low risk (' || score || '/100): it isn''t linked to any other account and its score is close to that of a typical legitimate customer.'
    else 'Low risk (' || score || '/100): no strong fraud signals; its score is close to that of a typical legitimate customer.' end
    || case when ring_suspected = 1 and risk_level <> 'low' then ' It belongs to suspected ring ' || ring_id || ' (' || ring_size || ' linked accounts).' else '' end"""
_SILENT = ", ".join(
    f"case when {t}_shared_count > 0 and not list_contains(named, '{t}_shared_count') then 'Shares {a} with ' || {t}_shared_count::bigint || ' other ' || "
    f"case when {t}_shared_count = 1 then 'account' else 'accounts' end || '.' end"
    for t, a in (("phone", "a phone number"), ("email", "an email address"), ("address", "an address"), ("device", "a device"), ("ip", "an IP address"))
)
_CONTEXT = f"""concat_ws(' | ',
    case when ring_suspected = 1 then 'Part of suspected fraud ring ' || ring_id || ': ' || ring_size || ' accounts' || coalesce(' linked by shared ' || {_spoken('kinds[:3]')}, '') || ', ' || ring_high || ' of them high risk.'
         when ring_id is not null then 'In connected group ' || ring_id || ' (' || ring_size || ' accounts' || coalesce(' linked by shared ' || {_spoken('kinds[:3]')}, '') || '), which is not currently suspected.' end,
    case when degree = 1 and high_neighbors > 0 then 'Its one linked account is rated high risk.' when degree = 1 then 'Its one linked account is not rated high risk.'
         when degree > 1 and high_neighbors = 0 then 'None of its ' || degree || ' linked accounts are rated high risk.'
         when degree > 1 then high_neighbors || ' of its ' || degree || ' linked accounts ' || case when high_neighbors = 1 then 'is' else 'are' end || ' rated high risk.' end,
    {_SILENT},
    case analyst_label when 1 then 'An analyst confirmed this account as fraud.' when 0 then 'An analyst marked this account as legitimate.' end)"""

_QUEUE = "order by score desc, size desc, ring_id"
_NET = """
    , shown as (select * from (select ring_id, size, score, (sum(size) over (order by score desc, size desc, ring_id))::bigint as running
                               from ringsum where suspected = 1 and score >= 0.3) where running <= 60),
    inside as (select customer_id, ring_id from ringm where ring_id in (select ring_id from shown)),
    near as (select * from edge where source_customer_id in (select customer_id from inside) and target_customer_id in (select customer_id from inside)
             and shared_phone + shared_email > 0)"""

SQL = {
    "feedback_labels": sql("select * from lab", "lab"),
    "ring_statuses": sql("select ring_id, status, epoch(reviewed_at)::bigint as reviewed_at, note from status", "status"),
    "latest_reviews": sql("""
        select target_type, target_id, id, decision, note, model_version
        from (select *, row_number() over (partition by target_type, target_id order by id desc) as rn from rev) where rn = 1""", "rev"),
    "feedback_summary": sql("""
        select count(*) as n_labels, count(*) filter (analyst_label = 1) as fraud, count(*) filter (analyst_label = 0) as legit,
               (select count(*) from rev) as n_reviews, (select count(*) from rev where model_version >= 2) as reviews_since_model,
               5::bigint as labels_in_model, ((select count(*) from rev where model_version >= 2) > 0)::int as retrain_recommended from lab""", "lab"),
    "effective_labels": sql("select customer_id, coalesce(analyst_label, label) as label from cust left join lab using (customer_id)", "cust", "lab"),
    "review_history": sql(f"""
        select id, target_type, target_id, decision, note, epoch(created_at)::bigint as created_at,
               (target_type = 'customer' or list_contains(included, '{WHO}'))::int as included
        from rev where (target_type = 'customer' and target_id = '{WHO}') or (target_type = 'ring' and list_contains(members, '{WHO}'))""", "rev"),
    "unknown_members": sql("""
        select ring_id, customer_id from (select target_id as ring_id, unnest(members) as customer_id from rev where target_type = 'ring')
        where (ring_id, customer_id) not in (select ring_id, customer_id from ringm)""", "rev", "ringm"),
    "clauses": sql(f"""
        , long as (unpivot (select * exclude (label) from ftab) on columns(* exclude (customer_id)) into name feature value value)
        select customer_id, feature, {_CLAUSE} as clause from (select long.*, risk >= 0.5 as raised from (select customer_id, feature, round(value, 6) as value from long) long join sc using (customer_id))""", "ftab", "sc"),
    "explanations": sql(f"""
        , t as (select *, {_SUMMARY} as summary, {_CONTEXT} as context from told join (select customer_id, {', '.join(f'{t}_shared_count' for t in fx.TYPES)} from ftab) using (customer_id))
        select customer_id, score, summary, context,
               coalesce(case when risk_level <> 'low' then {_CAP.format('ups[1]')} end, case when risk_level = 'low' then {_CAP.format('downs[1]')} end,
                        {_CAP.format('ups[1]')}, nullif(split_part(context, ' | ', 1), ''), 'No strong signals') as top_reason from t""", "told", "ftab"),
    "ring_sentences": sql(f"""
        , ev12 as (select * from (select *, row_number() over (partition by ring_id order by members desc, attribute_type, attribute_id) as position from (
            select ring_id, attribute_type, attribute_id, count(distinct customer_id) as members from lnk join ringm using (customer_id) group by 1, 2, 3 having count(distinct customer_id) >= 2))
          where position <= 12),
        parts as (select ring_id, list(c || ' shared ' || case when c = 1 then {_NOUN.format('attribute_type')} else
                     case attribute_type when 'phone' then 'phone numbers' when 'email' then 'email addresses' when 'address' then 'addresses' when 'device' then 'devices' else 'IP addresses' end end
                     order by c desc, p) as parts
                  from (select ring_id, attribute_type, count(*) as c, min(position) as p from ev12 group by 1, 2) group by 1)
        select ring_id, size || ' accounts' || coalesce(' linked by ' || case when len(parts) <= 1 then parts[1] else array_to_string(parts[:-2], ', ') || ' and ' || parts[-1] end, '') || '.'
               || case when members >= 3 then ' One ' || {_NOUN.format('attribute_type')} || ' is used by ' || members || ' of them.' else '' end
               || ' ' || n_high || ' of ' || size || ' members are rated high risk (average score ' || round_even(score * 100, 0)::bigint || '/100).'
               || case when open_span_days <= 60 and size >= 3 then ' All accounts were opened within ' || open_span_days || ' days of each other.' else '' end as explanation
        from ringsum left join parts using (ring_id) left join (select * from ev12 where position = 1) using (ring_id)""", "ringsum", "lnk"),
    "stored_contributions": sql("""
        select customer_id, (row_number() over (partition by customer_id order by abs(round(delta * 100, 2)) desc, place) - 1)::int as place, feature,
               case feature when 'network_degree' then 'network' when 'phone_shared_count' then 'network' else 'temporal' end as group, round(delta * 100, 2) as impact
        from contrib""", "contrib"),
    "feature_importance": sql("""
        select feature, feature as label, case feature when 'network_degree' then 'network' when 'phone_shared_count' then 'network' else 'temporal' end as group,
               round(avg(abs(delta)), 6) as importance from contrib group by 1""", "contrib"),
    "group_importance": sql("""
        select g as group, round(sum(i), 6) as importance from (
          select case feature when 'network_degree' then 'network' when 'phone_shared_count' then 'network' else 'temporal' end as g, avg(abs(delta)) as i from contrib group by feature) group by 1""", "contrib"),
    "customer_page": sql(f"""
        select {_BRIEF} from res left join lab using (customer_id)
        where (customer_id ilike '%c00000%' or name ilike '%c00000%') and risk_level = 'medium' and analyst_label is null
        order by degree desc, customer_id limit 40 offset 10""", "res", "lab"),
    "customer_total": sql("""
        select count(*) as total from res left join lab using (customer_id)
        where (customer_id ilike '%c00000%' or name ilike '%c00000%') and risk_level = 'medium' and analyst_label is null""", "res", "lab"),
    "reviewed_fraud": sql(f"select {_BRIEF} from res join lab using (customer_id) where analyst_label = 1", "res", "lab"),
    "top_customers": sql(f"select {_BRIEF} from res left join lab using (customer_id) order by rank limit 10", "res", "lab"),
    "top_rings": sql(f"select ring_id, size, round(score, 6) as score from ringsum where suspected = 1 {_QUEUE} limit 6", "ringsum"),
    "ring_page": sql("""
        select ring_id, size, round(score, 6) as score, suspected, coalesce(status, 'pending') as status, note as review_note
        from ringsum left join status using (ring_id)
        where coalesce(status, 'pending') = 'pending' and (lower(ring_id) like '%00012%' or ring_id in (
          select ring_id from ringm join cust using (customer_id) where lower(customer_id) like '%00012%' or lower(name) like '%00012%'))
        order by score desc, size desc, ring_id limit 50""", "ringsum", "status"),
    "ring_status_counts": sql("""
        select count(*) as all, count(*) filter (coalesce(status, 'pending') = 'pending') as pending, count(*) filter (status = 'confirmed') as confirmed,
               count(*) filter (status = 'dismissed') as dismissed from ringsum left join status using (ring_id) where suspected = 0""", "ringsum", "status"),
    "ring_neighbours": sql(f"""
        select ring_id, previous_ring, next_ring from (
          select ring_id, lag(ring_id) over w as previous_ring, lead(ring_id) over w as next_ring from ringsum window w as (partition by suspected {_QUEUE}))
        where ring_id = '{RING}'""", "ringsum"),
    "queue_links": sql(f"""
        select suspected, row_number() over w as place, ring_id, lag(ring_id) over w as previous_ring, lead(ring_id) over w as next_ring
        from ringsum window w as (partition by suspected {_QUEUE})""", "ringsum"),
    "customer_events": sql(f"""
        select customer_id, event_date::date::varchar as event_date, event_type, round(utilization_pct, 6) as utilization_pct, credit_limit_at_time
        from ev where customer_id = '{WHO}' order by event_date limit 1000""", "ev"),
    "connections": sql(f"""
        select res.customer_id, name, round(risk, 6) as risk, risk_level, ring_id, label, analyst_label, {_TYPES} as types
        from sym join res on res.customer_id = other_id left join lab on lab.customer_id = other_id
        where sym.customer_id = '{WHO}'""", "res", "sym", "lab"),
    "connection_evidence": sql(f"""
        select a.customer_id, attribute_type, a.attribute_value from lnk a join lnk m using (attribute_type, attribute_id)
        where m.customer_id = '{WHO}' and a.customer_id in (select other_id from sym where customer_id = '{WHO}')""", "lnk", "sym"),
    "ring_members": sql(f"""
        select {_BRIEF.replace('risk,', 'round(risk, 6) as risk,', 1)}, (risk >= 0.3 or not bool_or(risk >= 0.3) over ())::int as suggested
        from res left join lab using (customer_id) where ring_id = '{RING}'""", "res", "lab"),
    "ring_graph": sql(f"""
        , m as (select customer_id, 1 as member from ringm where ring_id = '{RING}'),
        b as (select other_id as customer_id, 0 as member from sym where customer_id in (select customer_id from m) and other_id not in (select customer_id from m)
              group by 1 order by count(*) desc, 1 limit 40),
        n as (select * from m union all select * from b)
        select customer_id, member, (select count(*) from sym where sym.customer_id = n.customer_id and other_id in (select customer_id from n)) as links from n""", "ringm", "sym"),
    "network_rings": sql(_NET + " select ring_id, size, round(score, 6) as score, running from shown", "ringsum", "edge"),
    "network_nodes": sql(_NET + """ select ring_id, customer_id from inside where customer_id in (select source_customer_id from near union select target_customer_id from near)""", "ringsum", "edge"),
    "network_edges": sql(_NET + f" select source_customer_id, target_customer_id, {_TYPES} as types from near", "ringsum", "edge"),
    "review_progress": sql("""
        select count(*) as suspected, count(*) filter (status in ('confirmed', 'dismissed')) as reviewed, count(*) filter (status = 'confirmed') as confirmed,
               count(*) filter (status = 'dismissed') as dismissed from ringsum left join status using (ring_id) where suspected = 1""", "ringsum", "status"),
    "version_history": """
        select *, round(roc_auc - lag(roc_auc) over (partition by dataset_id order by version), 6) as roc_auc_change from (
          select c_mktsegment as dataset_id, c_nationkey + 1 as version, round(avg(c_acctbal) / 10000, 6) as roc_auc, count(*) as n_feedback from customer group by 1, 2)""",
    "dataset_list": "select c_mktsegment as dataset_id, count(*) as n_customers, max(c_nationkey) + 1 as active_version from customer group by 1",
    "customer_export": sql("""
        select customer_id, name, round(risk * 100, 1) as risk_score, risk_level, rank, coalesce(ring_id, '') as ring_id, degree as linked_accounts,
               case analyst_label when 1 then 'fraud' when 0 then 'legitimate' else '' end as analyst_label,
               case when degree = 0 then '''=risk ' else 'risk ' end || risk_level as explanation from res left join lab using (customer_id)""", "res", "lab"),
    "json_columns": sql("select id, len(members)::int as n, array_to_string(members, ',') as members from rev", "rev"),
    "without_dataset": "select c_custkey, c_mktsegment as dataset_id from customer where c_mktsegment <> 'BUILDING'",
    "edges_for_people": sql(f"select source_customer_id as source, target_customer_id as target, {_TYPES} as types, shared_attribute_count::int as weight from edge", "edge"),
}
