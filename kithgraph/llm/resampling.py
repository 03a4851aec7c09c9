"""Importance resampling towards a target distribution, with segments counted once.

Hashed features of the raw documents and of the target texts are compared bucket by bucket; a document's weight is the
mean gain of its features, and a seeded Gumbel key on top of the weight draws without replacement.

Newlines separate words, so they cut texts into lines and no word crosses one. Equal lines are gathered first; the feature
counts of a distinct line are computed once and multiplied by its occurrences for the totals, and its summed gain is computed
once and joined back to every document that holds it. Runs of words that cross a line end (only for ``longest`` > 1) are not
in any line; they are taken from the seams of each text and added separately.

Scale: lines are counted with partial aggregation before their shuffle, so a line held by a third of all documents is one row
per task. The join back carries 16-byte digests and row numbers, never text; a hot line is split by the skew join. Only
``BUCKETS`` sums reach the driver. The draw numbers scores over ranges, no task sees them all.

Defined results: a NULL text has no words; a document without features weighs 0 and is drawn only if it has ``LEAST_WORDS``
words; a NULL doc_id hashes as the empty text and comes first in ties; repeated rows are documents of their own; an empty
target has T = 0; an empty table gives an empty result; columns other than those read are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import with_rank
from ..session import durable
from .common import CRC_TABLE, crc32_sql

BUCKETS = 10000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# Distinct lines that one task sums.
LINES = 200_000
# Documents that one task of the draw takes.
DOCUMENTS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_word = re.compile(WORD.encode())


def buckets_of(grams: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, grams), np.uint32, len(grams)) % np.uint32(buckets)).astype(np.int32)


def line_grams(line: bytes, longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words of one line."""
    words = _word.findall(line.lower())
    if longest == 1:
        return words
    return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def seam_grams(text: bytes, longest: int) -> list[bytes]:
    """The runs of up to ``longest`` words that cross at least one line end.

    Of every line only the first and last ``longest - 1`` words can be part of one; ``None`` stands for what lies between.
    """
    reach, strip = longest - 1, []
    for number, line in enumerate(text.lower().split(b"\n")):
        words = _word.findall(line)
        kept = words if len(words) <= 2 * reach else [*words[:reach], None, *words[-reach:]]
        strip += [(number, word) for word in kept]
    found = []
    for n in range(2, longest + 1):
        for i in range(len(strip) - n + 1):
            run = strip[i : i + n]
            if run[0][0] != run[-1][0] and all(word is not None for _, word in run):
                found.append(b" ".join(word for _, word in run))
    return found


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32()))


def _featured(rows: DataFrame, text: str, grams, longest: int, buckets: int) -> DataFrame:
    """``rows`` with ``text`` replaced by the bucket of each of its features, as ``features``."""
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        for batch in batches:
            lists = [buckets_of(grams(t.as_py() or b"", longest), buckets) for t in batch.column(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _lists(lists)], [*kept, "features"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*kept, text).mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in kept], "features array<int>"]))


def segments(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``digest, occurrences, features``: every distinct line of ``texts`` (column ``text``), its features computed once."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line"))
    counted = lines.groupBy("line").agg(F.count("*").alias("occurrences"))
    keyed = counted.select(F.unhex(F.md5("line")).alias("digest"), "occurrences", "line")
    return _featured(keyed, "line", line_grams, longest, buckets)


def seams(texts: DataFrame, longest: int, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` with the runs that cross line ends, as ``features``, in place of ``text``."""
    return _featured(texts, "text", seam_grams, longest, buckets)


def bucket_counts(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, of ``occurrences, features``; a task sends one number per bucket and no more."""

    def run(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(1)
            times = np.repeat(batch.column(0).to_numpy(), np.diff(column.offsets.to_numpy()))
            np.add.at(held, column.flatten().to_numpy(), times)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    parts = counted.select("occurrences", "features").mapInArrow(run, "bucket int, n bigint")
    sums = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        sums[bucket] = n
    return sums


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, each count raised by one."""
    size, goal = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.floor(1000 * np.log((target + 1.0) * size / ((raw + 1.0) * goal))).astype(np.int64)


def _gained(featured: DataFrame, keys: list[str], gains: np.ndarray) -> DataFrame:
    """``keys, n, gain``: the number of features of each row and their summed gain."""
    kinds = dict(featured.dtypes)

    def run(batches):
        for batch in batches:
            column = batch.column(len(keys))
            sums = np.concatenate([[0], np.cumsum(gains[column.flatten().to_numpy()])])
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            n = np.diff(ends)
            counts = [pa.array(n, pa.int64()), pa.array(np.diff(sums[ends]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *counts], [*keys, "n", "gain"])

    return featured.select(*keys, "features").mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n bigint, gain bigint"]))


def document_weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight``, one row per row of ``docs``."""
    # The numbers are fixed by writing them: a task that is run again may read its rows in another order.
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(RAW_WORD)) if longest > 1 else F.lit(None)
    places = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.cast("bigint").alias("words"), text.alias("text"))
    if longest > 1:
        places = durable(places, "places")
    lines = durable(segments(docs, longest, buckets), "segments")
    # Whole tasks of lines are summed before the shuffle, however many files the lines were written to.
    totals = bucket_counts(lines.coalesce(1 + lines.count() // LINES), buckets)
    goal = target.select(F.coalesce("text", F.lit("")).alias("text"))
    wanted = bucket_counts(segments(goal, longest, buckets), buckets)
    extra = None
    if longest > 1:
        extra = durable(seams(places, longest, buckets), "seams")
        once = F.lit(1).cast("bigint").alias("occurrences")
        totals = totals + bucket_counts(extra.select(once, "features"), buckets)
        wanted = wanted + bucket_counts(seams(goal, longest, buckets).select(once, "features"), buckets)
    gains = bucket_gains(totals, wanted)
    about = ["row", "doc_id", "words"]
    held = durable(places.select(*about, F.explode(F.split("text", "\n")).alias("line")).select(*about, F.unhex(F.md5("line")).alias("digest")), "held")
    met = held.hint("merge").join(_gained(lines, ["digest"], gains).hint("merge"), "digest").select(*about, "n", "gain")
    if extra is not None:
        met = met.unionByName(_gained(extra, about, gains))
    # The numbers of a document go along with its lines, which saves a join.
    whole = met.groupBy(*about).agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    mean = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n)) div n"))
    # Runs of one word are the words.
    return whole.select("doc_id", F.coalesce("words", "n").alias("n_words"), F.col("n").alias("n_features"), mean.cast("bigint").alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is NULL where it is not drawn."""
    weighed = document_weights(docs, target, longest, buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    # One narrow row per document: few files, however many partitions the lines took.
    scored = durable(weighed.withColumn("score", F.col("weight") + gumbel).coalesce(1 + docs.count() // DOCUMENTS), "scored")
    able = scored.filter(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.desc("weight"), F.desc("n_features")]
    ranked = with_rank(able, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


# One order of runs, as registered: features are words.
SQL = f"""
with {CRC_TABLE},
texts as (select row_number() over () as row, doc_id, false as wanted, text from documents union all select null, null, true, text from benchmark),
words as (select row, wanted, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{WORD}')) as word from texts),
vocabulary as (select word, {crc32_sql('word')} % {BUCKETS} as bucket from (select distinct word from words) cross join crc_table),
totals as (select bucket, count(*) filter (not wanted) as s, count(*) filter (wanted) as t from words join vocabulary using (word) group by 1),
gains as (select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from totals) + {BUCKETS})::double
    / ((s + 1)::double * ((select sum(t) from totals) + {BUCKETS})::double)))::bigint as gain from totals),
means as (select row, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from words join vocabulary using (word) join gains using (bucket)
    where not wanted group by 1),
scored as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score
    from texts left join means using (row) where not texts.wanted),
ranked as (select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls first) as place from scored)
select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS}
    and place <= (select count(*) from scored where n_features >= {LEAST_WORDS}) * {PERCENT} // 100 then place end as rank from ranked
"""
