"""Behaviour features, score metrics, splits and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.functions import vocabulary as v
from kithgraph.functions.values import risk_level
from kithgraph.operators import activity as A, features as FT, medians as MD, metrics as M, quality as Q, splits as S
from kithgraph.session import durable

from . import fixtures as fx
from .fixtures import flags, rounded, scored, sql

T = 0.6


def temporal(spark, d):
    return rounded(A.temporal_features(fx.events(spark, d)))


def feature_table(spark, d):
    """Every customer with network and behaviour features, zero where there are none."""
    from kithgraph.operators.edges import network_features

    c = fx.customers(spark, d).select("customer_id", "income")
    network = network_features(fx.edges_of(spark, d))
    table = FT.attach(c, network, [x for x in network.columns if x != "customer_id"])
    return rounded(FT.attach(table, A.temporal_features(fx.events(spark, d)), v.TEMPORAL_FEATURES))


def inner_features(spark, d):
    """Customers that have both network and behaviour features."""
    from kithgraph.operators.edges import network_features

    n = network_features(fx.edges_of(spark, d)).select("customer_id", "network_degree")
    return n.join(A.temporal_features(fx.events(spark, d)).select("customer_id", "total_event_count", "max_events_7d"), "customer_id")


def activity_medians(spark, d):
    """Exact medians over the whole event log."""
    m = MD.medians(fx.events(spark, d), ["utilization_pct", "credit_limit_at_time"])
    return spark.createDataFrame([(k, x) for k, x in m.items()], "name string, median double")


def typical(spark, d):
    c = fx.customers(spark, d).select("customer_id", "label", "income")
    table = durable(FT.attach(c, A.temporal_features(fx.events(spark, d)), ["total_event_count", "mean_days_between_events"]), "typical")
    m = FT.typical_legitimate(table, ["income", "total_event_count", "mean_days_between_events"])
    return rounded(spark.createDataFrame(list(m.items()), "feature string, median double"))


def standardised(spark, d):
    return rounded(FT.standardised(fx.customers(spark, d).select("customer_id", "income"), ["income"]), 5)


def varying(spark, d):
    """Columns with more than one value."""
    c = fx.customers(spark, d).withColumns({"always": F.lit(1), "sometimes": F.when(F.col("label") == 1, 1)})
    return spark.createDataFrame([(x,) for x in FT.non_constant(c, ["income", "label", "always", "sometimes"])], "column string")


def score_steps(spark, d):
    return M.score_steps(scored(spark, d)).select("risk", "pos", "neg", "tp", "fp", "step")


def class_metrics(spark, d):
    return rounded(M.classification_metrics(scored(spark, d), T))


def best_threshold(spark, d):
    return spark.createDataFrame([(M.best_f1_threshold(M.score_steps(scored(spark, d))),)], "threshold double")


def pr_curve(spark, d):
    return rounded(M.pr_curve(durable(M.score_steps(scored(spark, d)), "steps")))


def roc_curve(spark, d):
    return rounded(M.roc_curve(durable(M.score_steps(scored(spark, d)), "steps")))


def version_changes(spark, d):
    s = fx.scores(spark, d)
    now = s.select("customer_id", "risk", risk_level(F.col("risk"), T).alias("level"))
    before = s.select("customer_id", F.col("previous_risk").alias("risk"), risk_level(F.col("previous_risk"), T).alias("level"))
    return rounded(M.version_changes(now, before))


def _ring_suspicion(spark, d, column):
    from kithgraph.operators.rings import ring_scores

    s = fx.scores(spark, d).select("customer_id", F.col(column).alias("risk"))
    return ring_scores(fx.membership(spark, d), fx.customers(spark, d), s, T).select("ring_id", "suspected")


def ring_changes(spark, d):
    return M.ring_changes(_ring_suspicion(spark, d, "risk"), _ring_suspicion(spark, d, "previous_risk"))


def hidden_labels(spark, d):
    from kithgraph.operators.feedback import feedback_labels

    return rounded(M.evaluation_on_labels(scored(spark, d), feedback_labels(fx.reviews(spark, d)), T))


def same_customers(spark, d):
    s = scored(spark, d)
    return rounded(M.same_customers_before(s, s.select("customer_id", F.col("previous_risk").alias("risk")), T))


def groups(spark, d):
    c = fx.customers(spark, d)
    return c.select("customer_id", F.coalesce("truth_ring", "customer_id").alias("group_id"), "label", "truth_ring")


def train_test(spark, d):
    return S.split_by_group(groups(spark, d))


def folds(spark, d):
    g = durable(groups(spark, d), "groups")
    return S.stratified_folds(g, S.fold_count(g))


def training_possible(spark, d):
    return flags(S.training_possible(groups(spark, d)))


def split_report(spark, d):
    return S.split_report(train_test(spark, d), fx.customers(spark, d))


def rings_on_both_sides(spark, d):
    return S.rings_on_both_sides(durable(train_test(spark, d), "split"), fx.customers(spark, d))


def repeated_runs(spark, d):
    """Mean and deviation of a metric over repeats, here of balances over customers."""
    c = fx.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("model"), F.col("c_nationkey").cast("string").alias("experiment"), F.col("c_acctbal").alias("f1")
    )
    return rounded(M.repeated_runs(c, ["f1"]), 4)


def truth(spark, d):
    return fx.customers(spark, d).filter("truth_ring is not null").select("customer_id", F.col("truth_ring").alias("ring_id"))


def means_by_label(spark, d):
    table = feature_table(spark, d).join(fx.customers(spark, d).select("customer_id", "label"), "customer_id")
    return rounded(Q.feature_means(table, ["network_degree", "phone_shared_count", "total_event_count"]))


QUERIES = {
    "temporal_features": temporal,
    "feature_table": feature_table,
    "inner_features": inner_features,
    "activity_medians": activity_medians,
    "typical_legitimate": typical,
    "standardised_income": standardised,
    "varying_columns": varying,
    "score_steps": score_steps,
    "classification_metrics": class_metrics,
    "best_threshold": best_threshold,
    "precision_at_k": lambda s, d: rounded(M.at_k(scored(s, d))),
    "pr_curve": pr_curve,
    "roc_curve": roc_curve,
    "risk_ranks": lambda s, d: rounded(M.risk_ranks(fx.scores(s, d).select("customer_id", "risk"))),
    "risk_histogram": lambda s, d: rounded(M.risk_histogram(scored(s, d))),
    "level_counts": lambda s, d: M.level_counts(scored(s, d), T),
    "version_changes": version_changes,
    "ring_changes": ring_changes,
    "hidden_label_metrics": hidden_labels,
    "previous_version_metrics": same_customers,
    "train_test_split": train_test,
    "stratified_folds": folds,
    "training_possible": training_possible,
    "split_report": split_report,
    "rings_on_both_sides": rings_on_both_sides,
    "repeated_runs": repeated_runs,
    "class_balance": lambda s, d: Q.class_balance(fx.customers(s, d)),
    "ring_sizes": lambda s, d: Q.ring_size_distribution(truth(s, d)),
    "class_histogram": lambda s, d: Q.class_histogram(fx.customers(s, d), "income"),
    "distribution_gap": lambda s, d: rounded(Q.distribution_gap(fx.customers(s, d), "income")),
    "shared_values_among_fraud": lambda s, d: Q.shared_values_among_fraud(fx.customers(s, d), fx.links(s, d)),
    "integrity_report": lambda s, d: Q.integrity_report(fx.customers(s, d), fx.links(s, d)),
    "dataset_summary": lambda s, d: Q.dataset_summary(fx.customers(s, d), fx.links(s, d), fx.edges_of(s, d), fx.events(s, d)),
    "means_by_label": means_by_label,
}

fx.SQL.update({
    "steps": (["scored"], """
        select risk, pos, neg, (sum(pos) over (order by risk desc))::bigint as tp, (sum(neg) over (order by risk desc))::bigint as fp,
               row_number() over (order by risk desc) as step
        from (select risk, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from scored group by 1)"""),
    "grp": (["cust"], "select customer_id, coalesce(truth_ring, customer_id) as group_id, label, truth_ring from cust"),
    "sides": (["grp"], """
        select customer_id, group_id, side from grp join (
          select group_id, case when row_number() over (order by md5('42' || group_id), group_id) <= floor(0.8 * count(*) over ()) then 'train' else 'test' end as side
          from (select distinct group_id from grp)) using (group_id)"""),
    "ftab": (["cust", "net", "temporal"], f"""
        select customer_id, label, income, {', '.join(f'coalesce({c}, 0)::double as {c}' for c in
          ['phone_shared_count', 'email_shared_count', 'address_shared_count', 'device_shared_count', 'ip_shared_count', 'network_degree', 'shared_attribute_count'] + v.TEMPORAL_FEATURES)}
        from cust left join net using (customer_id) left join temporal using (customer_id)"""),
})

_METRICS = """
    select count(*) as n, count(*) filter (label = 1) as n_positive, count(*) filter (risk < {t} and label = 0) as tn,
           count(*) filter (risk >= {t} and label = 0) as fp, count(*) filter (risk < {t} and label = 1) as fn,
           count(*) filter (risk >= {t} and label = 1) as tp, {t}::double as threshold,
           round(count(*) filter ((risk >= {t})::int = label) / count(*), 6) as accuracy,
           round(coalesce(count(*) filter (risk >= {t} and label = 1) / nullif(count(*) filter (risk >= {t}), 0), 0), 6) as precision,
           round(count(*) filter (risk >= {t} and label = 1) / count(*) filter (label = 1), 6) as recall,
           round(2 * count(*) filter (risk >= {t} and label = 1) / (count(*) filter (risk >= {t}) + count(*) filter (label = 1)), 6) as f1,
           (select round(sum(case when p.risk > q.risk then 1.0 when p.risk = q.risk then 0.5 else 0 end) / count(*), 6)
            from m p, m q where p.label = 1 and q.label = 0) as roc_auc,
           (select round(sum(pos * tp / (tp + fp)) / sum(pos), 6) from (
              select pos, sum(pos) over (order by risk desc) as tp, sum(neg) over (order by risk desc) as fp
              from (select risk, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from m group by 1))) as pr_auc
    from m"""

_TEMPORAL = ", ".join(
    f"round({c}, 6) as {c}" if c in ("events_per_30_days", "mean_days_between_events", "mean_utilization_pct", "max_utilization_pct", "utilization_range")
    else c for c in v.TEMPORAL_FEATURES
)

SQL = {
    "temporal_features": sql(f"select customer_id, {_TEMPORAL} from temporal", "temporal"),
    "feature_table": sql("select customer_id, round(columns(* exclude (customer_id, label)), 6) from ftab", "ftab"),
    "inner_features": sql("select customer_id, network_degree, total_event_count, max_events_7d from net join temporal using (customer_id)", "net", "temporal"),
    "activity_medians": sql("""
        select 'utilization_pct' as name, median(utilization_pct) as median from ev
        union all select 'credit_limit_at_time', median(credit_limit_at_time) from ev""", "ev"),
    "typical_legitimate": sql("""
        select 'income' as feature, round(median(income), 6) as median from ftab where label = 0
        union all select 'total_event_count', round(median(total_event_count), 6) from ftab where label = 0
        union all select 'mean_days_between_events', round(median(mean_days_between_events), 6) from ftab where label = 0""", "ftab"),
    "standardised_income": sql("""
        select customer_id, round((x - avg(x) over ()) / stddev_pop(x) over (), 5) as income
        from (select customer_id, ln(1 + greatest(income, 0)) as x from cust)""", "cust"),
    "varying_columns": sql("""
        select c as column from (
          select 'income' as c, count(distinct income) + max((income is null)::int) as n from cust
          union all select 'label', count(distinct label) + max((label is null)::int) from cust
          union all select 'always', 1
          union all select 'sometimes', count(distinct nullif(label, 0)) + max((nullif(label, 0) is null)::int) from cust)
        where n > 1""", "cust"),
    "score_steps": sql("select * from steps", "steps"),
    "classification_metrics": sql(", m as (select risk, label from scored)" + _METRICS.format(t=T), "scored"),
    "best_threshold": sql("""
        select risk as threshold from (
          select risk, 2 * (tp / (tp + fp)) * (tp / p) / greatest(tp / (tp + fp) + tp / p, 1e-12) as f1
          from steps, (select sum(pos) as p from steps)) order by f1 desc, risk limit 1""", "steps"),
    "precision_at_k": sql("""
        select k::int as k, round(count(*) filter (label = 1) / k, 6) as precision,
               round(count(*) filter (label = 1) / (select count(*) from scored where label = 1), 6) as recall
        from (select label, row_number() over (order by risk desc, customer_id) as n from scored), (select unnest([25, 50, 100, 200, 500, 1000]) as k)
        where n <= k and k <= (select count(*) from scored) group by k""", "scored"),
    "pr_curve": sql("""
        , pts as (select 0 as i, 0.0::double as recall, 1.0::double as precision union all
                  select step, tp / (select sum(pos) from steps), tp / (tp + fp) from steps)
        select i::bigint as i, round(recall, 6) as recall, round(precision, 6) as precision from pts
        where (select count(*) from pts) <= 200 or i in (
          select round_even(j * ((select count(*) from pts) - 1) / 199, 0)::bigint from (select unnest(range(200)) as j))""", "steps"),
    "roc_curve": sql("""
        , kept as (select row_number() over (order by step) as i, fp, tp from (
                     select *, lead(pos) over (order by step) as pos2, lead(neg) over (order by step) as neg2, count(*) over () as k from steps)
                   where step = 1 or step = k or pos <> pos2 or neg <> neg2),
        pts as (select 0 as i, 0.0::double as fpr, 0.0::double as tpr union all
                select i, fp / (select sum(neg) from steps), tp / (select sum(pos) from steps) from kept)
        select i::bigint as i, round(fpr, 6) as fpr, round(tpr, 6) as tpr from pts
        where (select count(*) from pts) <= 200 or i in (
          select round_even(j * ((select count(*) from pts) - 1) / 199, 0)::bigint from (select unnest(range(200)) as j))""", "steps"),
    "risk_ranks": sql("select customer_id, round(risk, 6) as risk, row_number() over (order by risk desc, customer_id) as rank from sc", "sc"),
    "risk_histogram": sql("""
        select b::int as bin, round(b * 0.05::double, 6) as start, round((b + 1) * 0.05::double, 6) as "end", count(risk) as count,
               count(*) filter (label = 1) as fraud, count(*) filter (label = 0) as legit
        from (select unnest(range(20)) as b) left join scored
          on risk >= case when b = 0 then -1 else b * 0.05::double end and risk < case when b = 19 then 2 else (b + 1) * 0.05::double end
        group by b""", "scored"),
    "level_counts": sql("""
        select case when risk >= 0.6 then 'high' when risk >= 0.3 then 'medium' else 'low' end as level, count(*) as customers from scored group by 1""", "scored"),
    "version_changes": sql("""
        select count(*) filter (l <> o) as level_changes, count(*) filter (l = 'high' and o <> 'high') as newly_high,
               count(*) filter (l <> 'high' and o = 'high') as no_longer_high, round(avg(abs(risk - previous_risk)), 6) as mean_abs_score_change
        from (select *, case when risk >= 0.6 then 'high' when risk >= 0.3 then 'medium' else 'low' end as l,
                     case when previous_risk >= 0.6 then 'high' when previous_risk >= 0.3 then 'medium' else 'low' end as o from sc)""", "sc"),
    "ring_changes": sql("""
        select count(*) filter (now and not was) as rings_newly_suspected, count(*) filter (was and not now) as rings_cleared
        from (select count(*) filter (risk >= 0.6) >= 2 or avg(risk) >= 0.6 as now,
                     count(*) filter (previous_risk >= 0.6) >= 2 or avg(previous_risk) >= 0.6 as was
              from ringm join sc using (customer_id) group by ring_id)""", "ringm", "sc"),
    "hidden_label_metrics": sql(", m as (select risk, label from scored where customer_id not in (select customer_id from lab))" + _METRICS.format(t=T), "scored", "lab"),
    "previous_version_metrics": sql(", m as (select previous_risk as risk, label from scored)" + _METRICS.format(t=T), "scored"),
    "train_test_split": sql("select * from sides", "sides"),
    "stratified_folds": sql("""
        , g as (select group_id, count(*) filter (label = 1) as pos, count(*) as size from grp group by 1)
        select group_id, ((row_number() over (partition by pos > 0 order by size desc, md5('42' || group_id), group_id) - 1)
                 % (select least(5, count(*) filter (pos > 0), count(*) filter (size > pos)) from g))::int as fold from g""", "grp"),
    "training_possible": sql("""
        select *, (n_fraud >= 10 and n_legit >= 10 and fraud_groups >= 2 and legit_groups >= 2)::int as possible
        from (select count(*) filter (label = 1) as n_fraud, count(*) filter (label = 0) as n_legit,
                     count(distinct group_id) filter (label = 1) as fraud_groups, count(distinct group_id) filter (label = 0) as legit_groups from grp)""", "grp"),
    "split_report": sql("""
        select side, count(*) as customers, count(*) filter (label = 1) as fraud, count(distinct truth_ring) filter (label = 1) as rings
        from sides join cust using (customer_id) group by 1""", "sides"),
    "rings_on_both_sides": sql("""
        select truth_ring from sides join cust using (customer_id) where side = 'train' and label = 1
        intersect select truth_ring from sides join cust using (customer_id) where side = 'test' and label = 1""", "sides"),
    "repeated_runs": """
        select c_mktsegment as model, c_nationkey::varchar as experiment, round(avg(c_acctbal), 4) as f1_mean,
               round(stddev_samp(c_acctbal), 4) as f1_sd from customer group by 1, 2""",
    "class_balance": sql("select label, count(*) as customers from cust group by 1", "cust"),
    "ring_sizes": sql("""
        select size, count(*) as rings from (select count(*) as size from cust where truth_ring is not null group by truth_ring) group by 1""", "cust"),
    "class_histogram": sql("""
        , e as (select min(income) as low, (max(income) - min(income)) / 20 as w from cust)
        select b::int as bin, count(*) filter (label = 0) as legitimate, count(*) filter (label = 1) as fraud
        from e, (select unnest(range(20)) as b) left join cust
          on income >= (select case when b = 0 then -1e18 else low + b * w end from e) and income < (select case when b = 19 then 1e18 else low + (b + 1) * w end from e)
        group by b""", "cust"),
    "distribution_gap": sql("""
        , e as (select min(income) as low, max(income) as high, (max(income) - min(income)) / 20 as w from cust),
        h as (select b, count(*) filter (label = 0) as l, count(*) filter (label = 1) as f
              from e, (select unnest(range(20)) as b) left join cust
                on income >= (select case when b = 0 then -1e18 else low + b * w end from e) and income < (select case when b = 19 then 1e18 else low + (b + 1) * w end from e)
              group by b)
        select round(abs(avg(income) filter (label = 0) - avg(income) filter (label = 1)) / avg(income) filter (label = 0), 6) as mean_difference,
               (select round(sum(abs(l / (select sum(l) from h) - f / (select sum(f) from h)) / ((high - low) / 20)) / 20, 6) from h, e) as total_variation
        from cust""", "cust"),
    "shared_values_among_fraud": sql("""
        select attribute_type, count(*) as values from (
          select attribute_type, attribute_id from lnk join cust using (customer_id) where label = 1 group by 1, 2 having count(*) > 1)
        group by 1""", "lnk", "cust"),
    "integrity_report": sql("""
        select (select count(*) from (select customer_id from cust group by 1 having count(*) > 1)) as repeated_ids,
               (select count(*) from lnk where customer_id not in (select customer_id from cust)) as orphan_links,
               (select count(*) from (select customer_id, attribute_type from lnk join cust using (customer_id) where label = 0 group by 1, 2 having count(*) > 1)) as several_values_of_a_type,
               (select count(*) from true_rings where truth_ring not in (
                  select truth_ring from lnk join cust using (customer_id) where truth_ring is not null group by truth_ring, attribute_type, attribute_id having count(*) > 1)) as rings_sharing_nothing""",
        "lnk", "true_rings"),
    "dataset_summary": sql("""
        select (select count(*) from cust) as n_customers, (select count(label) from cust) as n_labeled, (select count(*) from cust where label = 1) as n_fraud_labels,
               (select count(*) from lnk) as n_links, (select string_agg(distinct attribute_type, ',' order by attribute_type) from lnk) as attribute_types,
               (select count(*) from edge) as n_edges, (select count(*) from events) as n_events""", "cust", "edge"),
    "means_by_label": sql("""
        select label, round(avg(network_degree), 6) as network_degree, round(avg(phone_shared_count), 6) as phone_shared_count,
               round(avg(total_event_count), 6) as total_event_count from ftab group by 1""", "ftab"),
}
