"""Model feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocabulary as v
from ..functions.metadata import feature_label
from ..functions.values import log_standardised
from ..model import Dataset, FeatureTable
from ..session import durable
from .activity import temporal_features
from .edges import ENDS, both_directions, network_features, restrict_edges
from .medians import medians

NETWORK_TOTALS = ["network_degree", "shared_attribute_count"]


def count_feature(kind: str) -> str:
    return f"{kind}_shared_count"


def core_types_present(types: list[str]) -> list[str]:
    return [t for t in v.CORE_TYPES if t in types]


def temporal_available(event_columns: frozenset[str] | set[str]) -> list[str]:
    """Behaviour features whose source column was supplied."""
    return [f for f in v.TEMPORAL_FEATURES if v.TEMPORAL_NEEDS.get(f, "") in {"", *event_columns}]


def attach(customers: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of features, zero where a customer has none."""
    joined = customers.join(features.select("customer_id", *columns), "customer_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def customer_network(customers: DataFrame, edges: DataFrame, degree_types: list[str] | None = None) -> DataFrame:
    """Network features of every customer; the two totals can be limited to ``degree_types``."""
    base = network_features(edges)
    columns = [c for c in base.columns if c != "customer_id"]
    if degree_types is None:
        return attach(customers.select("customer_id"), base, columns)
    counts = [c for c in columns if c not in NETWORK_TOTALS]
    limited = network_features(restrict_edges(edges, degree_types))
    return attach(attach(customers.select("customer_id"), base, counts), limited, NETWORK_TOTALS)


def columns_with_signal(frame: DataFrame, columns: list[str]) -> list[str]:
    """Columns with any value above zero: one aggregate row reaches the driver."""
    if not columns:
        return []
    row = frame.agg(*[F.max(F.col(c) > 0).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def non_constant(frame: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one distinct value, a missing value being one of them.

    Two distinct values show as a minimum below the maximum, so no distinct count is needed.
    """
    if not columns:
        return []
    varies = [
        ((F.min(c) < F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))).alias(c) for c in columns
    ]
    row = frame.agg(*varies).first()
    return [c for c in columns if row[c]]


def assemble_features(data: Dataset, edges: DataFrame, types: list[str]) -> FeatureTable:
    """Profile, network and behaviour features of every customer; types nobody shares are left out."""
    network = network_features(edges)
    network_columns = [c for c in network.columns if c != "customer_id"]
    frame = attach(data.customers.select("customer_id", *data.tabular), network, network_columns)
    temporal: list[str] = []
    if data.events is not None:
        temporal = temporal_available(data.event_columns)
        frame = attach(frame, temporal_features(data.events), v.TEMPORAL_FEATURES)
    else:
        frame = frame.withColumns({c: F.lit(0.0) for c in v.TEMPORAL_FEATURES})
    # Written once: the check for signal and every later use read it, and the graph and the events are gone through once.
    frame = durable(frame, "features")
    shared = columns_with_signal(frame, [count_feature(t) for t in types])
    labels = {c: feature_label(c, data.labels) for c in frame.columns if c != "customer_id"}
    return FeatureTable(frame, list(data.tabular), shared + NETWORK_TOTALS if shared else [], temporal, labels)


def feature_sets(tabular: list[str], network: list[str], temporal: list[str]) -> dict[str, list[str]]:
    """The compared feature sets, without empty ones and without repeats of the combined set."""
    sets = {
        "tabular": tabular,
        "tabular_network": tabular + network,
        "tabular_temporal": tabular + temporal,
    } if tabular else {"network": network, "temporal": temporal}
    combined = tabular + network + temporal
    chosen: dict[str, list[str]] = {}
    for name, features in sets.items():
        if features and features != combined and features not in chosen.values():
            chosen[name] = features
    return {**chosen, "combined": combined} if combined else chosen


def typical_legitimate(frame: DataFrame, features: list[str]) -> dict[str, float]:
    """Median of each feature over the legitimate customers."""
    found = medians(frame.filter("label = 0"), features)
    return {f: 0.0 if found[f] is None else found[f] for f in features}


def pivot_attributes(links: DataFrame, types: list[str]) -> DataFrame:
    """One row per customer, one column per attribute type; the types are given, so there is no extra pass."""
    return links.groupBy("customer_id").pivot("attribute_type", types).agg(F.min("attribute_id"))


# Graph encoding -------------------------------------------------------------------------------


def standardised(frame: DataFrame, features: list[str]) -> DataFrame:
    """log1p then zero mean and unit (population) deviation. The moments are one row of literals."""
    moments = frame.agg(*[
        e for f in features
        for e in (F.avg(F.log1p(F.greatest(F.col(f), F.lit(0.0)))).alias(f"{f}_m"),
                  F.stddev_pop(F.log1p(F.greatest(F.col(f), F.lit(0.0)))).alias(f"{f}_s"))
    ]).first()
    return frame.withColumns({
        f: log_standardised(F.col(f), F.lit(float(moments[f"{f}_m"] or 0.0)), F.lit(float(moments[f"{f}_s"] or 0.0)))
        for f in features
    })


def normalised_adjacency(customers: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries of D^-1/2 (A + I) D^-1/2 as ``customer_id, other_id, weight``; an isolated node keeps weight 1."""
    both = both_directions(edges.select(*ENDS))
    ids = customers.select("customer_id")
    loops = ids.select("customer_id", F.col("customer_id").alias("other_id"))
    degree = both.groupBy("customer_id").agg((F.count("*") + 1).alias("d"))
    known = ids.join(degree, "customer_id", "left").select("customer_id", F.coalesce("d", F.lit(1)).alias("d"))
    far = known.select(F.col("customer_id").alias("other_id"), F.col("d").alias("e"))
    return (
        both.unionByName(loops).join(known, "customer_id").join(far, "other_id")
        .select("customer_id", "other_id", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))
    )


def propagate(adjacency: DataFrame, frame: DataFrame, features: list[str], steps: int = 2) -> DataFrame:
    """Features averaged over the neighbourhood ``steps`` times."""
    current = frame.select("customer_id", *features)
    for _ in range(steps):
        far = current.withColumnRenamed("customer_id", "other_id")
        current = adjacency.join(far, "other_id").groupBy("customer_id").agg(
            *[F.sum(F.col("weight") * F.col(f)).alias(f) for f in features]
        )
    return current
