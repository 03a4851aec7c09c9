"""Global order without a one-task window.

A window with no partition key, or with a key that holds a third of the rows, would sort in one
task. Here rows are range-partitioned on a unique ordering, numbered inside each range, written
once, and shifted by the row counts (or sums) of the ranges before: one number per range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

_LOW_BITS = (1 << 33) - 1


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their range number and position in it; ``order`` must end in a unique column."""
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)))
    )
    return durable(laid, "ordered")


def _before(totals: DataFrame, columns: list[str]) -> DataFrame:
    """Exclusive prefix sums over the ranges. One row per range, so one task and a broadcast are safe."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns]
    )


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in the whole table."""
    laid = _ranges(df, order)
    before = _before(laid.groupBy("_range").agg(F.count("*").alias("n")), ["n"])
    ranked = laid.join(F.broadcast(before), "_range")
    return ranked.select(*df.columns, (F.col("_before_n") + F.col("_at") + 1).alias(name))


def with_rank_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1-based position inside each group; a group of any size is spread over ranges, and rows are sorted once.

    A piece is what a group has in one range. A row's position is its place in the range, less the place of the first row of
    its piece, plus the rows that its group has in earlier ranges. The pieces are written, so their true size tells whether
    they go to the rows as they lie or, where groups are as many as rows, rows and pieces are joined by a shuffle.
    """
    laid = _ranges(df, [F.col(g) for g in groups] + order)
    pieces = laid.groupBy("_range", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carried = durable(carried.select((F.col("_carry") - F.col("_first") + 1).alias("_shift"), *[F.col(g).alias(f"_of_{g}") for g in ["_range", *groups]]), "pieces")
    # A NULL group is a group like any other.
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in ["_range", *groups]])
    return laid.join(carried, same).select(*df.columns, (F.col("_at") + F.col("_shift")).cast("bigint").alias(name))


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str | None = None) -> DataFrame:
    """Running totals over the whole table: ``sums`` maps a new column to the column it adds up."""
    laid = _ranges(df, order)
    sources = list(dict.fromkeys(sums.values()))
    totals = laid.groupBy("_range").agg(
        F.count("*").alias("_rows"), *[F.sum(c).alias(c) for c in sources]
    )
    before = _before(totals, ["_rows", *sources])
    here = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(F.broadcast(before), "_range")
    columns = [(F.sum(src).over(here) + F.col(f"_before_{src}")).alias(name) for name, src in sums.items()]
    if rank:
        columns.append((F.col("_before__rows") + F.col("_at") + 1).alias(rank))
    return out.select(*df.columns, *columns)
