"""Best-fit packing of documents into sequences of fixed length, with conflicts.

Pieces are dealt by hash to shards of bounded size, and each shard is packed alone, largest piece first. Open bins are
ordered by what is left in them. A bin carries two bitmaps: the source slots it holds and the duplicate clusters it holds.
The search for a piece starts at the smallest residual that fits and goes on to the successors until a bin shares no bit
with the piece, which is then the tightest compatible bin; if there is none a new bin is opened.

A source has as many slots as its share of the pieces lets one expect in a bin, and one more; its pieces take the slots in
turn. So a source with a third of all words still fills bins, and a small source does not fill one alone. Copies never share a
bin: rows of the same text, of the same id, or of ids in one group of near copies (``clusters``; a caller that knows them, or
knows that there are none, hands them in). A row without an id conflicts with the same text only.

A text longer than a bin is cut into full bins and a rest, in order, so nothing is dropped. Defined results: a NULL or
empty text is one piece of size 0; a NULL source is a source; ties go by size, then by id and piece, then by hash of the
text; repeated rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.components import connected_components
from ..session import durable
from .jaccard import join_similar, word_counts

CAPACITY = 2048
SHARD_ROWS = 8192


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece (size, source bits, cluster bits), in the order given."""
    order: list[tuple[int, int]] = []  # (residual, bin) of the open bins
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for size, source, cluster in pieces:
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
        else:
            residual, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= source
        clusters[number] |= cluster
        placed.append((number, capacity - residual))
        if residual > size:
            insort(order, (residual - size, number))
    return placed


def pack_shard(rows: list[dict], capacity: int) -> list[tuple[int, int]]:
    """Bins of the rows of one shard; bits are numbered by first use, and only clusters and texts met twice need one."""
    named = [[("text", r["same"]), *([] if r["cluster"] is None else [("group", r["cluster"])])] for r in rows]
    seen: dict = {}
    for names in named:
        for name in names:
            seen[name] = seen.get(name, 0) + 1
    bits: dict = {}
    slots: dict = {}
    turns: dict = {}
    pieces = []
    for r, names in zip(rows, named, strict=True):
        turn = turns[r["source"]] = turns.get(r["source"], -1) + 1
        source = 1 << slots.setdefault((r["source"], turn % r["slots"]), len(slots))
        cluster = 0
        for name in names:
            if seen[name] > 1:
                cluster |= 1 << bits.setdefault(name, len(bits))
        pieces.append((r["size"], source, cluster))
    return best_fit(pieces, capacity)


def cut_documents(docs: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, source, same, piece, size``: full pieces and the rest of every document; ``same`` is a hash of the text."""
    chosen = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), "text")

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], word_counts(batch, 3)], ["doc_id", "source", "same", "words"])

    words = chosen.mapInArrow(count, StructType([*chosen.schema.fields[:3], StructField("words", LongType())]))
    number = F.explode(F.expr(f"sequence(0L, greatest(0L, (words - 1) div {capacity}))"))
    cut = words.withColumn("piece", number)
    return cut.select("doc_id", "source", "same", "piece", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("bigint").alias("size"))


def clusters(docs: DataFrame) -> DataFrame:
    """``id, cluster``: the group of every id that has near copies; all texts of one id are in one group."""
    labels = join_similar(docs).filter("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").cast("bigint").alias("a"), F.col("component_id").cast("bigint").alias("b"))
    rows = docs.count()
    return connected_components(durable(labels.distinct(), "labels", rows), ["a", "b"], rows).select(F.col("customer_id").alias("id"), F.col("component_id").alias("cluster"))


def source_slots(pieces: DataFrame, capacity: int) -> DataFrame:
    """``source, slots``: from the source's share of all words and the mean number of pieces that a bin takes."""
    by = pieces.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    words, n = by.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    in_bin = capacity * n / max(words, 1)
    slots = (1 + F.ceil(F.col("n") / F.lit(max(n, 1)) * F.lit(float(in_bin)))).cast("bigint")
    return by.select(F.col("source").alias("_source"), slots.alias("slots"))


def pack(docs: DataFrame, groups: DataFrame | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, piece, size, bin, offset, filled``: where each piece of each document goes.

    ``groups`` (``id, cluster``) names the group of every id that has near copies; without it only copies of one id and equal
    texts conflict.
    """
    # Row numbers are fixed by writing them, so that any number of equal rows is dealt to all shards.
    pieces = durable(cut_documents(docs, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces", docs.count())
    shards = max(1, -(-pieces.count() // shard_rows))
    own = F.col("doc_id").cast("bigint")
    if groups is None:
        pieces = pieces.withColumn("cluster", own)
    else:
        pieces = pieces.join(groups, own == F.col("id"), "left").drop("id").withColumn("cluster", F.coalesce("cluster", own))
    keyed = pieces.join(source_slots(pieces, capacity), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    spread = keyed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    order = [F.desc("size"), F.col("doc_id").asc_nulls_first(), "piece", "same"]
    names = ["doc_id", "piece", "size", "bin", "offset", "filled"]

    def flush(shard, rows):
        placed = pack_shard(rows, capacity)
        filled: dict[int, int] = {}
        for r, (number, _) in zip(rows, placed, strict=True):
            filled[number] = filled.get(number, 0) + r["size"]
        columns = [
            [r["doc_id"] for r in rows], [r["piece"] for r in rows], [r["size"] for r in rows],
            [shard * (1 << 24) + b for b, _ in placed], [o for _, o in placed], [filled[b] for b, _ in placed],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if rows:
                        yield flush(shard, rows)
                    shard, rows = row["shard"], []
                rows.append(row)
        if rows:
            yield flush(shard, rows)

    laid = spread.select("shard", F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "size", "source", "slots", "same", "cluster")
    sorted_ = laid.repartition("shard").sortWithinPartitions("shard", *order)
    return sorted_.mapInArrow(run, "doc_id bigint, piece bigint, size bigint, bin bigint, offset bigint, filled bigint")
