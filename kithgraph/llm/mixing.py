"""Mixing sources to target weights, in fixed-length blocks of words, with DataFrame functions only.

The words of a source, in order of document, are packed into blocks of ``BLOCK`` words; the last block may be shorter. A
source needs a number of words (its target), hence a number of slots of one block each. How many slots of each source an output
shard holds is drawn first: every slot of a source falls into a shard by hash, so the counts are multinomial (``shard_counts``).
The slots are then numbered shard by shard from these counts, the running numbers go through the source's blocks once in every
epoch, and within an epoch a slot finds its block through a pseudorandom permutation of the source's block numbers (a
swap-or-not shuffle, arithmetic only). Slots and blocks are joined by number. The last slot takes only what is missing, so a
source misses its target by rounding alone, and a document is never taken more often than epochs allow.

The mix has three forms: ``mixed_shards`` is the filled shards, slot by slot; ``mixed_documents`` is the stretches of documents
that were taken, as documents; ``mix_digest`` counts what was taken of each document, and over how many shards it went.

Targets: sources in code-point order, NULL last, weigh 1, 2, 3, 1, ... and share all words; a target stops at three
times its source's size, and the excess goes to the others by weight until none is above.

Defined results: a NULL text has no words and takes none; a NULL source is a source; repeated rows are documents of their
own; a stretch keeps the white space between its words, a document taken whole keeps all; columns of any name are handed on;
running totals use ranges, so a source with a third of all rows is spread over tasks; nothing is drawn at random outside the
hash, so reruns agree; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ordered import with_running_sums
from ..session import durable
from .common import WORD, word_count

BLOCK = 64
MOST = 3
SHARDS = 64
ROUNDS = 10
# A prime modulus and multipliers for the arithmetic hash; every product stays below 2^63.
PRIME = 2147483647
STEPS = (48271, 69621)


def _hash(value: str, salt: str) -> str:
    """A number below PRIME from two whole numbers, as SQL; every step stays below 2^63."""
    first = f"((({value}) % {PRIME}) * {STEPS[0]} + ({salt}) % {PRIME} + 1) % {PRIME}"
    return f"((({first}) % 65536) * {STEPS[1]} + (({first}) div 65536) * {STEPS[0]} + ({salt}) % 65521) % {PRIME}"


def _drawn(value: str, salt: str) -> str:
    """A number below 2^19 for each value, independent of its neighbours' numbers: the hash squared twice, less its low bits."""
    once = _hash(value, salt)
    twice = f"(({once}) * ({once}) + ({salt}) % 65521) % {PRIME}"
    return f"((({twice}) * ({twice}) + 1) % {PRIME}) div 4096"


def round_keys() -> list[str]:
    """One key for each round of the permutation of a source and epoch."""
    return [_hash(f"source_nr * 1009 + epoch * 31 + {n * 7907}", f"{n * 15485863 + 11}") for n in range(ROUNDS)]


def shuffle_round(number: int) -> str:
    """One swap-or-not round: position ``x`` and its partner change places if the hash of the larger says so."""
    partner = f"((k{number} % blocks) + blocks - x) % blocks"
    return f"case when (({_hash(f'greatest(x, {partner})', f'k{number}')}) div 4096) % 2 = 1 then {partner} else x end"


def _shuffled(rows: DataFrame, start: str, rounds: list[int], name: str) -> DataFrame:
    """``rows`` with the end of ``start`` under the rounds; in reverse order they are the inverse.

    Each round is a generator of one row, which keeps the optimizer from writing all rounds into one expression.
    """
    rows = rows.withColumn("x", F.expr(start))
    for number in rounds:
        kept = [c for c in rows.columns if c != "x"]
        rows = rows.select(*kept, F.expr(f"stack(1, {shuffle_round(number)}) as x"))
    return rows.withColumnRenamed("x", name)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_nr, source_size, target`` from ``source, source_size``."""
    named = with_running_sums(sizes, [F.col("source").asc_nulls_last()], {}, rank="source_nr")
    weighed = named.withColumn("weight", (F.col("source_nr") - 1) % 3 + 1)
    words, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    cap = F.col("source_size") * MOST
    # In order of cap / weight: a source is capped when the level that all before it leave reaches its cap.
    ratio = F.col("ratio")
    laid = with_running_sums(weighed.withColumn("ratio", cap / F.col("weight")), [ratio, F.col("source_nr")], {"_s": "source_size", "_w": "weight"})
    level = (F.lit(words) - MOST * (F.col("_s") - F.col("source_size"))) / (F.lit(weights) - (F.col("_w") - F.col("weight")))
    marked = laid.withColumn("capped", level >= ratio)
    capped, free = marked.agg(
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)),
    ).first()
    share = F.col("weight") * F.lit(float(words - MOST * capped)) / F.lit(float(free or 1))
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.least(share, cap.cast("double")))
    return marked.select("source", "source_nr", "source_size", target.alias("target"))


def _sized(rows: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """``row, doc_id, source, size, tie`` of numbered documents, written once: words are counted a single time."""
    return durable(rows.select(
        "row", F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("tie")
    ), "sized")


def place_documents(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, doc_id, size, source_nr, source_size, target, start`` (first word in the source) of every document; the sources."""
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    laid = with_running_sums(sized, order, {"through": "size"})
    sizes = durable(laid.groupBy("source").agg(F.sum("size").alias("source_size"), F.min(F.col("through") - F.col("size")).alias("first")), "sizes")
    sources = durable(source_targets(sizes.select("source", "source_size")), "sources")
    firsts = sizes.join(sources.select(F.col("source").alias("_s"), "source_nr", "target"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_source"), "first", "source_nr", "source_size", "target"
    )
    placed = laid.join(firsts, F.col("source").eqNullSafe(F.col("_source")))
    start = (F.col("through") - F.col("size") - F.col("first")).alias("start")
    return placed.select("row", "doc_id", "size", "source_nr", "source_size", "target", start), sources


def source_epochs(sources: DataFrame) -> DataFrame:
    """``source_nr, source_size, blocks, epoch, left, slots, k0, ..., tail_slot``: the epochs of each source, with the keys of their
    permutations and the slot of the short last block. At most three rows for each source, written once.
    """
    asked = sources.filter("source_size > 0 and target > 0").select(
        "source_nr", "source_size", F.round("target").cast("bigint").alias("need"),
        F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("epoch"),
    )
    epochs = asked.withColumn("left", F.least(F.col("need") - F.col("epoch") * F.col("source_size"), F.col("source_size"))).filter("left > 0")
    for number, key in enumerate(round_keys()):
        epochs = epochs.withColumn(f"k{number}", F.expr(key))
    # One slot more than full blocks ask for makes up for the short last block.
    epochs = epochs.drop("need").withColumn("slots", F.least(F.col("blocks"), F.expr(f"(left + {BLOCK - 1}) div {BLOCK} + 1")))
    return durable(_shuffled(epochs, "blocks - 1", list(reversed(range(ROUNDS))), "tail_slot"), "epochs")


def _dealt(rows: DataFrame, first: str, count: str, name: str) -> DataFrame:
    """Each row once for every number from ``first`` on, ``count`` of them; runs of 1024 are dealt out over tasks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.filter(F.col(count) > 0).withColumn("_run", F.explode(F.expr(f"sequence(0L, ({count} - 1) div 1024)"))).repartition(tasks, "source_nr", "_run")
    return runs.withColumn(name, F.explode(F.expr(f"sequence({first} + _run * 1024, {first} + least({count}, _run * 1024 + 1024) - 1)"))).drop("_run")


def shard_counts(epochs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source_nr, shard, slots, first, blocks``: the multinomial draw, and the number of each shard's first slot in its source."""
    slots = epochs.groupBy("source_nr", "blocks").agg(F.sum("slots").alias("all"))
    shard = F.expr(f"({_drawn('ticket', 'source_nr * 104729 + 3')}) % {shards}").alias("shard")
    drawn = _dealt(slots.withColumn("zero", F.lit(0).cast("bigint")), "zero", "all", "ticket").select("source_nr", "blocks", shard)
    counts = drawn.groupBy("source_nr", "blocks", "shard").agg(F.count("*").alias("slots"))
    # At most one row for each shard of a source.
    earlier = Window.partitionBy("source_nr").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return durable(counts.withColumn("first", F.coalesce(F.sum("slots").over(earlier), F.lit(0))), "shard-counts")


def draw_slots(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source_nr, block, epoch, shard, slot, words``: every slot of the mix, numbered in its source, and how many words it takes of its block."""
    epochs = source_epochs(sources)
    numbered = _dealt(shard_counts(epochs, shards), "first", "slots", "slot").select(
        "source_nr", "shard", "slot", F.expr("int(slot div blocks)").alias("epoch"), F.expr("slot % blocks").alias("at")
    )
    each = _shuffled(numbered.join(epochs.drop("slots"), ["source_nr", "epoch"]), "at", list(range(ROUNDS)), "block")
    last = F.col("block") == F.col("blocks") - 1
    short = F.col("source_size") - (F.col("blocks") - 1) * BLOCK
    before = F.col("at") * BLOCK - F.when(F.col("tail_slot") < F.col("at"), BLOCK - short).otherwise(0)
    words = F.least(F.when(last, short).otherwise(F.lit(BLOCK)), F.greatest(F.col("left") - before, F.lit(0)))
    return each.select("source_nr", "block", "epoch", "shard", "slot", words.cast("bigint").alias("words")).filter("words > 0")


def pieces(placed: DataFrame, sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row, source_nr, epoch, shard, slot, low, high``: the stretches of words (from 0, end exclusive) that slots take of documents."""
    # A document is cut at block borders; the pieces of a very long one are ordinary rows.
    met = placed.filter("size > 0").select(
        "row", "source_nr", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block")
    )
    # The slots are many more than the sources they are made from suggest; they must not be broadcast.
    taken = met.hint("merge").join(draw_slots(sources, shards).hint("merge"), ["source_nr", "block"])
    low = F.greatest(F.col("start"), F.col("block") * BLOCK) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("words")) - F.col("start")
    return taken.select("row", "source_nr", "epoch", "shard", "slot", low.alias("low"), high.alias("high")).filter("high > low")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes of it, and over how many shards they go."""
    placed, sources = place_documents(_sized(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"), "doc_id", "source", "text"))
    taken = pieces(placed, sources).groupBy("row").agg(F.sum(F.col("high") - F.col("low")).alias("taken"), F.size(F.collect_set("shard")).alias("shards"))
    return placed.hint("merge").join(taken.hint("merge"), "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("shards", F.lit(0)).cast("bigint").alias("n_shards")
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """``row, doc``: all columns of a document as one, so that names of any kind cannot clash."""
    return durable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered", docs.count())


def _stretch(text: str, low: str, high: str) -> F.Column:
    """The words from ``low`` to ``high`` of a text with the white space between them."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col(low) + 1).cast("int"), (F.col(high) - F.col(low)).cast("int")), "")
    return F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each stretch of a document that an epoch takes, with the columns of ``docs``.

    Only numbers are mixed; the texts are joined once, at the end.
    """
    rows = _numbered(docs)
    placed, sources = place_documents(_sized(rows, "doc.doc_id", "doc.source", "doc.text"))
    order = Window.partitionBy("row", "epoch").orderBy("low")
    cut = F.coalesce((F.col("low") != F.lag("high").over(order)).cast("int"), F.lit(0))
    parts = pieces(placed, sources).select("row", "epoch", "low", "high").withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(order))
    taken = parts.groupBy("row", "epoch", "_part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sized = placed.select("row", "size").hint("merge").join(taken.hint("merge"), "row")
    met = rows.hint("merge").join(sized.hint("merge"), "row")
    whole = (F.col("low") == 0) & (F.col("high") == F.col("size"))
    text = F.when(whole, F.col("doc.text")).otherwise(_stretch("doc.text", "low", "high"))
    mixed = met.select(F.col("doc").withField("text", text).alias("doc"))
    if "n_chars" in docs.columns:
        mixed = mixed.select(F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)).alias("doc"))
    return mixed.select("doc.*")


def mixed_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The filled output shards: ``shard, slot, source, doc_id, text`` of every piece; a slot holds at most ``BLOCK`` words.

    Pieces of one slot stand in order of their documents. Write it partitioned by ``shard`` to get a file set for each.
    """
    rows = _numbered(docs)
    placed, sources = place_documents(_sized(rows, "doc.doc_id", "doc.source", "doc.text"))
    taken = pieces(placed, sources, shards).select("row", "shard", "slot", "low", "high")
    met = rows.hint("merge").join(taken.hint("merge"), "row")
    return met.select("shard", "slot", F.col("doc.source").alias("source"), F.col("doc.doc_id").alias("doc_id"), _stretch("doc.text", "low", "high").alias("text"))


def _sql() -> str:
    duck = lambda text: text.replace(" div ", " // ")
    keys = ", ".join(f"{duck(k)} as k{n}" for n, k in enumerate(round_keys()))
    rounds, before = "", "each"
    for n in range(ROUNDS):
        rounds += f"r{n} as (select * replace ({duck(shuffle_round(n))} as x) from {before}),\n"
        before = f"r{n}"
    return f"""
with docs as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
named as (select *, row_number() over (order by source nulls last) as source_nr from sizes),
weighed as (select *, (source_nr - 1) % 3 + 1 as weight from named),
level as (select *, {MOST} * source_size / weight as ratio,
    (sum(source_size) over () - {MOST} * (sum(source_size) over w - source_size)) / (sum(weight) over () - (sum(weight) over w - weight)) as lvl
    from weighed window w as (order by {MOST} * source_size / weight, source_nr rows unbounded preceding)),
targets as (select *, case when lvl >= ratio then cast({MOST} * source_size as double) else least(cast({MOST} * source_size as double),
    weight * cast(sum(source_size) over () - {MOST} * coalesce(sum(source_size) filter (lvl >= ratio) over (), 0) as double)
    / cast(sum(weight) filter (lvl < ratio) over () as double)) end as target from level),
epochs as (select source_nr, source_size, cast(round(target) as bigint) as need, (source_size + {BLOCK - 1}) // {BLOCK} as blocks,
    unnest(range({MOST})) as epoch from targets where source_size > 0 and target > 0),
lefts as (select *, least(need - epoch * source_size, source_size) as words_left, {keys} from epochs),
each as (select *, slot as x from (select *, unnest(range(least(blocks, (words_left + {BLOCK - 1}) // {BLOCK} + 1))) as slot from lefts where words_left > 0)),
tickets as (select source_nr, shard, row_number() over (partition by source_nr order by shard) - 1 as number from (
    select source_nr, ({duck(_drawn('ticket', 'source_nr * 104729 + 3'))}) % {SHARDS} as shard
    from (select source_nr, unnest(range(count(*))) as ticket from each group by source_nr))),
{rounds}
tails as (select source_nr, epoch, slot as tail_slot from {before} where x = blocks - 1),
slots as (select r.source_nr, r.x as block, tickets.shard, least(case when x = blocks - 1 then source_size - (blocks - 1) * {BLOCK} else {BLOCK} end,
    greatest(words_left - (slot * {BLOCK} - case when tail_slot < slot then {BLOCK} - (source_size - (blocks - 1) * {BLOCK}) else 0 end), 0)) as words
    from {before} r left join tails using (source_nr, epoch) join tickets on tickets.source_nr = r.source_nr and tickets.number = r.epoch * r.blocks + r.slot),
placed as (select doc_id, size, source_nr, d.source, sum(size) over (partition by d.source order by doc_id rows unbounded preceding) - size as start, source_size, target
    from docs d join targets t on d.source is not distinct from t.source),
cut as (select doc_id, source_nr, start, size, unnest(range(cast(start as bigint) // {BLOCK}, (cast(start as bigint) + size - 1) // {BLOCK} + 1)) as block
    from placed where size > 0),
parts as (select doc_id, source_nr, start, shard, least(start + size, block * {BLOCK} + words) - greatest(start, block * {BLOCK}) as n
    from cut join slots using (source_nr, block)),
taken as (select doc_id, source_nr, start, sum(n) as taken, count(distinct shard) as n_shards from parts where n > 0 group by all)
select p.doc_id, p.size, p.source_size, p.target, cast(case when p.size > 0 then coalesce(t.taken, 0) else 0 end as bigint) as taken,
    case when p.size > 0 then coalesce(t.n_shards, 0) else 0 end as n_shards
from placed p left join taken t on p.doc_id = t.doc_id and p.source_nr = t.source_nr and p.start = t.start
"""


SQL = _sql()
