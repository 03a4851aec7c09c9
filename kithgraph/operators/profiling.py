"""Column statistics and the roles they suggest.

Statistics are taken over the whole table, not over its first rows: each cell is counted per column
and value with partial aggregation, and the tests run once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings
from ..functions import metadata as md, vocabulary as v
from ..functions.values import parse_label, to_moment, to_number
from ..sources.tables import ROW, spread

EXAMPLES = 3


def _cells(frame: DataFrame) -> DataFrame:
    """Distinct values per column with their count."""
    columns = [c for c in frame.columns if c != ROW]
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    return spread(frame).select(cell.alias("c")).select("c.*").groupBy("column", "value").agg(F.count("*").alias("n"))


def column_statistics(frame: DataFrame) -> DataFrame:
    """One row per column: distinct, empty and filled cells, and the shares that read as number, date, label."""
    filled = F.col("value").isNotNull()
    n = F.col("n")

    def share(test):
        return F.coalesce(F.try_divide(F.sum(F.when(filled & test.isNotNull(), n).otherwise(0)), F.sum(F.when(filled, n))), F.lit(0.0))

    return _cells(frame).groupBy("column").agg(
        F.count_if(filled).alias("n_unique"),
        F.sum(F.when(filled, 0).otherwise(n)).alias("n_empty"),
        F.sum(F.when(filled, n).otherwise(0)).alias("n_filled"),
        share(to_number(F.col("value"))).alias("numeric_share"),
        share(to_moment(F.col("value"))).alias("date_share"),
        share(parse_label(F.col("value"))).alias("label_share"),
    )


def column_examples(frame: DataFrame, count: int = EXAMPLES) -> DataFrame:
    """The first few distinct values per column.

    Rows are spread once; each pass over them finds the next value of every column as one aggregate row, so no cell is kept or sorted.
    """
    columns = [c for c in frame.columns if c != ROW]
    dealt = spread(frame)
    found = None
    for _ in range(count):
        rows = dealt if found is None else dealt.crossJoin(F.broadcast(found))
        step = []
        for i, c in enumerate(columns):
            new = F.col(c).isNotNull() if found is None else ~F.array_contains(f"_found{i}", F.col(c))
            following = F.min(F.when(new, F.struct(F.col(ROW).alias("first"), F.col(c).alias("value"))))
            values = F.array_compact(F.array(following["value"]))
            step.append((values if found is None else F.concat(F.first(f"_found{i}"), values)).alias(f"_found{i}"))
        found = rows.agg(*step)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_found{i}").alias("examples")) for i, c in enumerate(columns)]))
    return found.select(each.alias("c")).select("c.*").filter(F.size("examples") > 0)


def profile_columns(frame: DataFrame) -> DataFrame:
    return column_statistics(frame).join(column_examples(frame), "column", "left")


def _base_role(name: str, stats: dict) -> str:
    """Role of one column from its name and statistics; ID and address parts are settled later."""
    words, joined = set(md.name_words(name)), md.joined_name(name)
    numeric = stats["numeric_share"] >= 0.95
    opened = words.intersection(v.OPEN_DATE_TOKENS) and stats["date_share"] >= 0.8
    ladder = [
        (joined in v.ID_NAMES, "id-name"),
        (joined in v.LABEL_NAMES and stats["label_share"] >= 0.9, "label"),
        (joined in v.RING_NAMES or "ring" in words, "ring"),
        (joined in v.BIRTH_NAMES, "ignore"),
        (joined in v.OPEN_DATE_NAMES or opened, "open_date"),
        (joined in v.PERSON_NAMES, "name"),
        (words.intersection(v.NUMERIC_TOKENS) and numeric, "feature"),
        (md.identity_role(name), md.identity_role(name)),
        (words.intersection(v.ADDRESS_PART_TOKENS), "address-part"),
        (numeric and stats["n_unique"] > 1 and not (words.intersection(v.ID_TOKENS) and stats["n_unique"] == stats["n_filled"]), "feature"),
    ]
    return next((role for holds, role in ladder if holds), "ignore")


def roles_from_statistics(columns: list[str], stats: dict[str, dict]) -> dict[str, str]:
    """Suggested role per column from one row of statistics per column."""
    roles = {c: _base_role(c, stats[c]) for c in columns}
    named = [c for c in columns if roles[c] == "id-name"]
    id_column = min(named, key=lambda c: (v.ID_NAMES.index(md.joined_name(c)), c), default=None)
    if id_column is None:
        def unique_id(c):
            s = stats[c]
            full = s["n_empty"] == 0 and s["n_unique"] == s["n_filled"] > 0
            return roles[c] in ("ignore", "feature", "address-part") and full and set(md.name_words(c)).intersection(v.ID_TOKENS)
        id_column = next((c for c in columns if unique_id(c)), None)
    has_address = "address" in roles.values()
    for c in columns:
        if roles[c] == "id-name":
            roles[c] = "ignore"
        elif roles[c] == "address-part":
            roles[c] = "address" if has_address else "ignore"
    if id_column is not None:
        roles[id_column] = "customer_id"
    for role in ("label", "ring", "open_date"):
        for extra in [c for c in columns if roles[c] == role][1:]:
            roles[extra] = "ignore"
    return roles


def suggest_customer_roles(frame: DataFrame) -> dict[str, str]:
    stats = {r["column"]: r.asDict() for r in column_statistics(frame).collect()}
    return roles_from_statistics([c for c in frame.columns if c != ROW], stats)


def preview(frame: DataFrame, kind: str) -> dict:
    """Row count, column profile, first rows and suggested mapping of an uploaded table."""
    columns = [c for c in frame.columns if c != ROW]
    profile = {r["column"]: r.asDict() for r in profile_columns(frame).collect()}
    out = {
        "n_rows": sum(profile[columns[0]][k] for k in ("n_empty", "n_filled")),
        "columns": [profile[c] for c in columns],
        "sample_rows": [r.asDict() for r in frame.orderBy(ROW).select(*columns).limit(settings.PREVIEW_ROWS).collect()],
    }
    if kind == "customers":
        out["suggested_roles"] = roles_from_statistics(columns, profile)
    else:
        out["suggested_fields"] = md.suggest_fields(columns, v.LINK_FIELDS if kind == "links" else v.EVENT_FIELDS)
    return out
