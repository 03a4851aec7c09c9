"""Plain-language explanations of scores and rings.

An account carries its contributions as one array (one entry per model feature, so bounded), and
the whole explanation is computed from it row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..functions import phrases as p, vocabulary as v
from ..functions.metadata import feature_group, feature_label


def contribution_array(features: list[str], labels: dict[str, str], prefix: str = "phi_") -> Column:
    """Entries ``feature, label, group, value, delta`` from the wide columns."""
    return F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit(labels.get(f, feature_label(f))).alias("label"),
            F.lit(feature_group(f)).alias("group"), F.col(f).cast("double").alias("value"),
            F.col(prefix + f).cast("double").alias("delta"),
        )
        for f in features
    ])


def stored_contributions(contributions: Column) -> Column:
    """Contributions by absolute impact, in points with two decimals."""
    impact = F.transform(contributions, lambda c: F.struct(
        c["feature"].alias("feature"), c["label"].alias("label"), c["group"].alias("group"),
        c["value"].alias("value"), F.bround(c["delta"] * 100, 2).alias("impact"),
    ))
    keyed = F.transform(impact, lambda c, i: F.struct((-F.abs(c["impact"])).alias("order"), i.alias("place"), c.alias("row")))
    return F.transform(F.array_sort(keyed), lambda k: k["row"])


def _reasons(contributions: Column, limit: int, raised: bool) -> Column:
    """The largest contributions in one direction that can be said in words."""
    sign = 1 if raised else -1
    strong = F.filter(contributions, lambda c: c["delta"] * sign >= settings.MIN_REASON_IMPACT)
    said = F.transform(strong, lambda c, i: F.struct(
        (F.bround(c["delta"] * 100, 2) * -sign).alias("order"), i.alias("place"),
        c["feature"].alias("feature"), c["label"].alias("label"), c["value"].alias("value"),
        F.bround(c["delta"] * 100, 2).alias("impact"),
        p.clause(c["feature"], c["value"], F.lit(raised), c["label"]).alias("clause"),
    ))
    kept = F.array_sort(F.filter(said, lambda c: c["clause"].isNotNull()))
    return F.slice(kept, 1, limit)


def _clauses(reasons: Column, limit: int) -> Column:
    return p.spoken_list(F.transform(F.slice(reasons, 1, limit), lambda r: r["clause"]))


def _first_text(reasons: Column) -> Column:
    return p.capitalised(F.try_element_at(reasons, F.lit(1))["clause"])


def _summary() -> Column:
    ups, downs = F.col("reasons"), F.col("mitigating")
    has_up, has_down = F.size(ups) > 0, F.size(downs) > 0
    score = F.col("score")

    def text(name: str, **fields: Column) -> Column:
        return p.fill(v.SUMMARY[name], {"score": score, **fields})

    favour_one = F.when(has_down, text("favour", downs=_clauses(downs, 1))).otherwise("")
    favour_two = F.when(has_down, text("favour", downs=_clauses(downs, 2))).otherwise("")
    noting = F.when(F.try_element_at(ups, F.lit(1))["impact"] >= 5, text("noting", up=_clauses(ups, 1))).otherwise("")
    high = F.when(has_up, text("high", ups=_clauses(ups, 3))).otherwise(text("high_plain"))
    medium = F.when(has_up, text("medium", ups=_clauses(ups, 2))).otherwise(text("medium_plain"))
    low = (
        F.when(has_up | has_down, F.concat(text("low"), favour_two, noting))
        .when(F.col("degree") == 0, text("low_unlinked"))
        .otherwise(text("low_plain"))
    )
    body = F.when(F.col("level") == "high", high).when(F.col("level") == "medium", F.concat(medium, favour_one)).otherwise(low)
    in_ring = F.coalesce(F.col("ring.suspected"), F.lit(False)) & (F.col("level") != "low")
    return F.concat(body, F.when(in_ring, p.fill(v.SUMMARY["ring"], {"ring_id": F.col("ring.ring_id"), "size": F.col("ring.size")})).otherwise(""))


def _context() -> Column:
    """Ring, neighbours, further shared values and the analyst's decision, in this order."""
    ring, degree, high = F.col("ring"), F.col("degree"), F.col("high_neighbors")
    kinds = F.transform(F.slice(ring["shared_types"], 1, 3), p.kind_noun)
    linked_by = F.when(F.size(kinds) > 0, p.fill(v.CONTEXT["linked_by"], {"kinds": p.spoken_list(kinds)})).otherwise("")
    of_ring = {"ring_id": ring["ring_id"], "size": ring["size"], "n_high": ring["n_high"], "linked_by": linked_by}
    about_ring = F.when(ring.isNotNull(), F.when(ring["suspected"], p.fill(v.CONTEXT["suspected"], of_ring)).otherwise(p.fill(v.CONTEXT["group"], of_ring)))
    about_links = (
        F.when((degree == 1) & (high > 0), F.lit(v.CONTEXT["one_high"]))
        .when(degree == 1, F.lit(v.CONTEXT["one_not_high"]))
        .when((degree > 1) & (high == 0), p.fill(v.CONTEXT["none_high"], {"degree": degree}))
        .when(degree > 1, p.fill(v.CONTEXT["some_high"], {"high": high, "degree": degree, "is_are": p.word_for(high, "is", "are")}))
    )
    named = F.transform(F.concat("reasons", "mitigating"), lambda r: r["feature"])
    silent = F.filter(
        "shared_counts",
        lambda s: (s["count"] > 0) & ~F.array_contains(named, F.concat(s["kind"], F.lit("_shared_count"))),
    )
    shares = F.transform(silent, lambda s: p.fill(v.CONTEXT["shares"], {
        "kind": p.kind_with_article(s["kind"]), "n": s["count"], "account": p.word_for(s["count"], "account", "accounts"),
    }))
    analyst = F.when(F.col("analyst_label") == 1, F.lit(v.CONTEXT["confirmed"])).when(F.col("analyst_label") == 0, F.lit(v.CONTEXT["cleared"]))
    return F.concat(F.array_compact(F.array(about_ring, about_links)), shares, F.array_compact(F.array(analyst)))


def explain_customers(scored: DataFrame) -> DataFrame:
    """Add ``score, reasons, mitigating, summary, context, top_reason`` to scored customers.

    Needs ``risk, level, contributions`` (array of feature, label, group, value, delta),
    ``shared_counts`` (array of kind, count), ``degree, high_neighbors, analyst_label`` and ``ring``
    (struct of ring_id, size, n_high, suspected, shared_types, or NULL).
    """
    base = scored.withColumns({
        "score": p.whole(F.col("risk") * 100),
        "reasons": _reasons(F.col("contributions"), 4, True),
        "mitigating": _reasons(F.col("contributions"), 3, False),
    })
    told = base.withColumns({"summary": _summary(), "context": _context()})
    up, down = _first_text(F.col("reasons")), _first_text(F.col("mitigating"))
    top = F.coalesce(
        F.when(F.col("level") != "low", up), F.when(F.col("level") == "low", down), up,
        F.try_element_at("context", F.lit(1)), F.lit(v.CONTEXT["nothing"]),
    )
    return told.withColumn("top_reason", top)


def ring_explanation() -> Column:
    """Sentence about one ring from ``size, evidence, n_high, score, open_span_days``."""
    evidence = F.coalesce(F.col("evidence"), F.expr("array()").cast("array<struct<position:int,attribute_type:string,value:string,members:bigint>>"))
    kinds = F.transform(evidence, lambda e: e["attribute_type"])
    # Distinct types keep first-appearance order; sorting by count leaves ties in that order.
    distinct = F.array_distinct(kinds)
    counted = F.transform(distinct, lambda k, i: F.struct(
        (-F.size(F.filter(kinds, lambda x: x == k))).alias("order"), i.alias("place"), k.alias("kind"),
    ))
    parts = F.transform(F.array_sort(counted), lambda c: p.fill(v.RING_TEXT["part"], {
        "count": -c["order"],
        "noun": F.when(c["order"] == -1, p.kind_noun(c["kind"])).otherwise(p.kind_plural(c["kind"])),
    }))
    linked = F.when(F.size(parts) > 0, p.fill(v.RING_TEXT["linked"], {"parts": p.spoken_list(parts)})).otherwise("")
    first = F.try_element_at(evidence, F.lit(1))
    widest = F.when(first["members"] >= 3, p.fill(v.RING_TEXT["widest"], {"noun": p.kind_noun(first["attribute_type"]), "members": first["members"]})).otherwise("")
    risk = p.fill(v.RING_TEXT["risk"], {"n_high": F.col("n_high"), "size": F.col("size"), "score": p.whole(F.col("score") * 100)})
    opened = F.when(
        (F.col("open_span_days") <= 60) & (F.col("size") >= 3),
        p.fill(v.RING_TEXT["opened"], {"days": F.col("open_span_days")}),
    ).otherwise("")
    return F.concat(p.fill(v.RING_TEXT["opening"], {"size": F.col("size"), "linked": linked}), widest, risk, opened)
