"""URL filters by association rules.

Given rules (host suffix and path prefix, longest wins) judge the pages they fit. These judged pages are the labels:
FP-growth mines which combinations of URL tokens go with a verdict, rules below the support or confidence asked for are
pruned, and the rest judge the other pages through an inverted index from token to rule.

Mined rules may have any number of tokens. Each holds for at least ``SUPPORT`` of the labelled pages, which bounds their
number. A rule of three or more tokens is dropped only if some of its tokens alone give the same verdict with no lower
confidence, so that no page is judged otherwise without it. The index joins on tokens, and a page answers to a rule when as many of its tokens hit
the rule as the rule has.

Defined results: a NULL URL or one without ``://`` has an empty host and path, no rule and the verdict of no evidence,
``allow``; ties go to the higher support, then to block, then to the smaller rule text; repeated rows are answered alike;
without labelled pages no rule is mined; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable

# Verdict, host, path.
BASE_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SUPPORT = 0.005
CONFIDENCE = 0.9
PLAIN = 2  # rules up to this length stay even where a shorter one implies them
DEFAULT = "allow"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path, empty where there are none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = _ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def base_rule(host: Column, path: Column) -> Column:
    """Struct of the longest given rule that fits; NULL where none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(BASE_RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels and path segments, marked by kind."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, parts), lambda x: F.length(x) > 2))


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``rule_tokens, verdict, support, confidence`` from rows of ``tokens, verdict``."""
    label = F.concat(F.lit("v:"), F.col("verdict"))
    baskets = labelled.select(F.concat(F.col("tokens"), F.array(label)).alias("items"))
    # One job over the counts of single tokens first: a token below the support is in no frequent set.
    total = baskets.count()
    if not total:
        return labelled.select(F.col("tokens").alias("rule_tokens"), "verdict", F.lit(0).cast("bigint").alias("support"), F.lit(0.0).alias("confidence")).limit(0)
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    of_label = lambda mark: F.filter("items", lambda x: x.startswith("v:") if mark else ~x.startswith("v:"))
    sets = sets.select(F.array_sort(of_label(False)).alias("rule_tokens"), of_label(True).alias("label"), "freq").filter(
        F.size("rule_tokens") > 0
    )
    alone = sets.filter(F.size("label") == 0).select("rule_tokens", F.col("freq").alias("seen"))
    both = sets.filter(F.size("label") == 1).select("rule_tokens", F.expr("substring(label[0], 3)").alias("verdict"), F.col("freq").alias("support"))
    rules = durable(both.join(alone, "rule_tokens").withColumn("confidence", F.col("support") / F.col("seen")), "rules")
    kept = not_implied(rules)
    return kept.filter(F.col("confidence") >= confidence).select("rule_tokens", "verdict", "support", "confidence")


def not_implied(rules: DataFrame) -> DataFrame:
    """``rules`` without those of more than ``PLAIN`` tokens that a part of their tokens implies with no lower confidence.

    All parts of a frequent set are frequent, so the best confidence of all parts goes up from length to length.
    """
    longest = rules.agg(F.max(F.size("rule_tokens"))).first()[0] or 0
    kept, best = rules.filter(F.size("rule_tokens") <= PLAIN), None
    for length in range(1, longest + 1):
        level = rules.filter(F.size("rule_tokens") == length)
        if best is None:
            best = level.select("rule_tokens", "verdict", F.col("confidence").alias("best"))
            continue
        parts = level.select(
            "rule_tokens", "verdict", F.explode(F.transform("rule_tokens", lambda x: F.filter("rule_tokens", lambda y: y != x))).alias("part")
        )
        below = parts.join(best.select(F.col("rule_tokens").alias("part"), "verdict", "best"), ["part", "verdict"])
        judged = durable(level.join(below.groupBy("rule_tokens", "verdict").agg(F.max("best").alias("below")), ["rule_tokens", "verdict"]), "rules")
        if length > PLAIN:
            kept = kept.unionByName(judged.filter("below < confidence").select(*rules.columns))
        best = judged.select("rule_tokens", "verdict", F.greatest("below", "confidence").alias("best"))
    return kept


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, verdict, mined`` of the best rule by page, through an index from token to rule."""
    numbered = rules.withColumn("mined", F.array_join("rule_tokens", " "))
    index = numbered.select(F.explode("rule_tokens").alias("token"), F.size("rule_tokens").alias("n"), "mined", "verdict", "confidence", "support")
    hits = urls.select("url", F.explode("tokens").alias("token")).join(index, "token")
    whole = hits.groupBy("url", "mined", "verdict", "n", "confidence", "support").agg(F.count("*").alias("hit")).filter("hit = n")
    order = F.struct(-F.col("confidence"), -F.col("support"), (F.col("verdict") != "block").cast("int"), F.col("mined"))
    return whole.groupBy("url").agg(F.min_by(F.struct("verdict", "mined", "confidence"), order).alias("best")).select("url", "best.*")


def judge_urls(pages: DataFrame) -> DataFrame:
    """One row per page: parts, given rule, verdict, and the mined rule with its confidence where one decided."""
    host, path = url_parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("base", base_rule(F.col("host"), F.col("path")))
    tokens = split.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    rules = mine_rules(tokens.filter("base is not null").select("tokens", F.col("base.verdict").alias("verdict")))
    others = tokens.filter("base is null and url is not null").select("url", "tokens").distinct()
    best = match_rules(others, rules).withColumnRenamed("verdict", "mined_verdict")
    return split.join(best, "url", "left").select(
        "page_id", "host", "path", F.col("base.rule").alias("rule"),
        F.coalesce("base.verdict", "mined_verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("base").isNull(), F.col("mined")).alias("mined"),
        F.when(F.col("base").isNull(), F.col("confidence")).alias("confidence"),
    )


def _sql_tokens() -> str:
    return (
        "list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x), "
        "list_transform(string_split(path, '/'), lambda x: 'p:' || x)), lambda x: length(x) > 2))"
    )


def _sql_rule(value: str) -> str:
    cases = "".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p if value == 'rule' else verdict}' "
        for verdict, h, p in sorted(BASE_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"case {cases}end"


SQL = rf"""
with rest as (select page_id, url, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, url,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
judged as (select *, {_sql_rule('rule')} as rule, {_sql_rule('verdict')} as base, {_sql_tokens()} as tokens from parts),
labelled as (select row_number() over () as nr, tokens, base from judged where base is not null),
single as (select nr, base, unnest(tokens) as t from labelled),
frequent as (select t from single group by t having count(*) >= ceil({SUPPORT} * (select count(*) from labelled))),
kept as (select * from single where t in (select t from frequent)),
sets as (select nr, base, [t] as s from kept
    union all select a.nr, a.base, [a.t, b.t] from kept a join kept b on a.nr = b.nr and a.t < b.t),
counted as (select s, base, count(*) as support, sum(count(*)) over (partition by s) as seen from sets group by s, base),
rules as (select s, array_to_string(s, ' ') as mined, base as verdict, support, support::double / seen::double as confidence from counted
    where support >= ceil({SUPPORT} * (select count(*) from labelled)) and support::double / seen::double >= {CONFIDENCE}),
asked as (select distinct url, tokens from judged where base is null and url is not null),
hits as (select url, r.* from asked join rules r on list_has_all(asked.tokens, r.s)),
best as (select * from hits qualify row_number() over (partition by url order by confidence desc, support desc, verdict <> 'block', mined) = 1)
select page_id, host, path, rule, coalesce(base, best.verdict, '{DEFAULT}') as verdict,
    case when base is null then mined end as mined, case when base is null then confidence end as confidence
from judged left join best using (url)
"""
