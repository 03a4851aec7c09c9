"""Similarity join of documents on word shingles by Jaccard, with prefixes of token combinations.

A document's tokens are its distinct shingles of five words (64-bit hashes). All tokens are put in one order, rarest
first. Of ``n`` tokens at most ``n - ceil(0.8 n)`` are missing in a document that is similar enough, so two such
documents share a signature among their prefixes, where rare tokens are signatures alone and frequent tokens only in
pairs: frequent tokens are dealt to classes, the prefix is extended by one token for each class, and all pairs of prefix
tokens of one class are signatures. The number of classes grows with the length of the documents (by bands of length; a
document uses its own band and the next), so the signatures of a document stay in proportion to its tokens.

Frequencies come from a count sketch over all tokens of all documents. Its size is fixed, so it can be broadcast at any
size of the input; an error in it changes the order and the cost, never the result, because all documents use the same.

Equal sets are one item. Signatures are shuffled and sorted, and a run of equal signatures gives pairs of neighbours by
length first. Those that the parity bitmaps of the two sets leave possible are verified on the whole texts and connected. Only runs whose items are then still in several
components are looked at again: an item is compared with every larger component that it meets in a run, unless the
parity bitmaps of the two sets already tell that too many tokens differ. For that, items and members are packed, so a
component of thousands of near copies costs a few packs and not a row for each pair, and no link is lost.

Defined results: NULL texts and texts without a word have no tokens and link with nothing; texts of less than five words
are one token; repeated rows are copies; a NULL id is never the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import durable, few_files

SHINGLE = 5
LEAST_PERCENT = 80
SKETCH_BITS = 22
SLICE = 1 << 16
FREQUENT = 64
WINDOW = 3
CLASS_TOKENS = 32
FLUSH = 1 << 16
CHUNK = 1 << 16
SEEN_MOST = (1 << 20) - 1
BITS_LEAST, BITS_MOST = 256, 8192
PACK_ROWS, PACK_BYTES, PACK_PARTS = 256, 2 << 20, 16

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(11).integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, base, np.uint64)])
    return _powers


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with A-Z lower-cased, where each word starts and stops in them, and the number of words of each text."""
    b = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    inside = np.r_[False, ~_SPACE[b], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    last = np.cumsum([len(t) + 1 for t in texts])
    return b, starts, stops, np.diff(np.searchsorted(starts, last), prepend=0)


def word_counts(batch: pa.RecordBatch, column: int) -> pa.Array:
    """Number of words between white space of each text of a batch; 0 for NULL."""
    return pa.array([n for texts in _chunks(batch, column) for n in _words(texts)[3].tolist()], pa.int64())


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, with A-Z lower-cased, text after text, and the number of words of each text."""
    b, starts, stops, counts = _words(texts)
    power, inverse = _power(len(b))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)]
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64) * _MUL), counts


def token_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each text, sorted, text after text, and the number of tokens of each text."""
    words, counts = word_hashes(texts)
    begins = np.cumsum(counts) - counts
    runs = np.where(counts < SHINGLE, counts > 0, counts - SHINGLE + 1)
    stops = np.cumsum(runs)
    starts = stops - runs
    padded = np.r_[words, np.zeros(SHINGLE, np.uint64)]
    summed = np.full(len(words), SHINGLE, np.uint64) * _MUL
    for i in range(SHINGLE):
        summed += padded[i : len(words) + i] * _MIX[i]
    total = summed[np.repeat(begins - starts, runs) + np.arange(len(words) and stops[-1])]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):  # all words are one run
        whole = counts[short].astype(np.uint64) * _MUL
        for i in range(SHINGLE - 1):
            whole += np.where(counts[short] > i, padded[begins[short] + i] * _MIX[i], np.uint64(0))
        total[starts[short]] = whole
    total = mix(total)
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        total[a:b].sort()
    keep = np.ones(len(total), bool)
    keep[1:] = total[1:] != total[:-1]
    keep[starts[runs > 0]] = True
    before = np.r_[0, np.cumsum(keep)]
    return total[keep], before[stops] - before[starts]


def shingles(text: bytes) -> np.ndarray:
    """The distinct tokens of a text, sorted."""
    return token_sets([text])[0]


def set_keys(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set; 0 for an empty one."""
    keys, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        sums = np.add.reduceat(mix(tokens ^ _MUL), (np.cumsum(sizes) - sizes)[some])
        keys[some] = mix(sums + sizes[some].astype(np.uint64) * _MUL)
    return keys.view(np.int64)


def parities(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap for each set, about as long as the set, of the parities of token slots; sets that differ in d tokens differ in d bits at most."""
    widths = np.clip(1 << np.frexp(sizes)[1].astype(np.int64), BITS_LEAST, BITS_MOST)
    stops = np.cumsum(widths)
    slots = (tokens & np.repeat(widths - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(stops - widths, sizes)
    packed = np.packbits(np.bincount(slots, minlength=int(stops[-1])).astype(np.uint8) & 1).tobytes()
    return [packed[a:b] for a, b in zip(((stops - widths) // 8).tolist(), (stops // 8).tolist(), strict=True)]


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit numbers, the longer ones folded to ``width`` bytes."""
    rows = []
    for b in bits:
        row = np.frombuffer(b, np.uint64)
        while len(row) * 8 > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows)


def bands() -> np.ndarray:
    """Lowest length of each band; the longest length similar to one of a band lies in it or the next."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(lows[-1] * 100 // LEAST_PERCENT + 1)
    return np.array(lows)


_BANDS = bands()


def ranks(tokens: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A number of each token that orders tokens rarest first: a rare token's signature."""
    return (np.minimum(seen, SEEN_MOST).astype(np.uint64) << np.uint64(44)) | (tokens >> np.uint64(20))


def signatures(tokens: np.ndarray, seen: np.ndarray, frequent: int) -> np.ndarray:
    """The signatures of a set of tokens, given how often each is seen at most in the corpus (by the sketch)."""
    n = len(tokens)
    wanted = n - (LEAST_PERCENT * n + 99) // 100 + 1
    alone = seen <= min(frequent, SEEN_MOST - 1)
    rare = int(np.count_nonzero(alone))
    ranked = ranks(tokens[alone], seen[alone])
    if rare >= wanted:
        ranked.sort()
        return ranked[:wanted]
    found, common = [ranked], tokens[~alone]
    common = common[np.lexsort((common, seen[~alone]))]
    band = int(np.searchsorted(_BANDS, n, side="right")) - 1
    for b in (band, band + 1):
        classes = max(1, int(_BANDS[b]) // CLASS_TOKENS)
        kind = (common >> np.uint64(20)) % np.uint64(classes)
        first = np.zeros(len(common), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        # The first token of a class adds nothing yet: it is no pair.
        stop = int(np.searchsorted(np.cumsum(~first), wanted - rare)) + 1
        prefix, kind = common[:stop], kind[:stop]
        by = np.argsort(kind, kind="stable")
        prefix, kind = prefix[by], kind[by]
        for gap in range(1, int(np.bincount(kind.astype(np.int64)).max(initial=0))):
            same = kind[gap:] == kind[:-gap]
            one, two = prefix[:-gap][same], prefix[gap:][same]
            found.append(mix(np.minimum(one, two) * _MIX[0] + np.maximum(one, two) * _MIX[1] + _MIX[2] ** np.full(1, b, np.uint64)))
    return np.unique(np.concatenate(found))


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _texts(batch: pa.RecordBatch, column: int):
    return (value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist())


def _chunks(batch: pa.RecordBatch, column: int):
    """The texts of a batch in stretches of up to CHUNK bytes; a longer text is alone."""
    held, size = [], 0
    for text in _texts(batch, column):
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def survey(docs: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members ``doc_id, n, key, digest, bits`` and partial sketches ``slice, counts``, both written once from one pass over the texts.

    ``digest`` is of the whole text: it finds the text of a set again without its tokens.
    """

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "key", "digest", "bits", "slice", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            sizes, keys, digests, bits = [], [], [], []
            for texts in _chunks(batch, 1):
                tokens, lengths = token_sets(texts)
                sizes += lengths.tolist()
                keys += set_keys(tokens, lengths).tolist()
                digests += map(_digest, texts)
                bits += parities(tokens, lengths)
                np.add.at(counts, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            columns = [batch.column(0).to_pylist(), sizes, keys, digests, bits, [None] * len(sizes), [None] * len(sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        for number, data in _slices(counts):
            columns = [[None], [None], [None], [None], [None], [number], [data]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    both = durable(chosen.mapInArrow(run, "doc_id bigint, n bigint, key bigint, digest binary, bits binary, slice int, counts binary"), "survey", rows)
    return both.filter("slice is null").select("doc_id", "n", "key", "digest", "bits"), both.filter("slice is not null").select("slice", "counts")


def _slices(counts: np.ndarray):
    """The parts of a sketch that are not empty."""
    pack = zstandard.ZstdCompressor(level=1)
    for i in range(0, len(counts), SLICE):
        if counts[i : i + SLICE].any():
            yield i // SLICE, pack.compress(_narrow(counts[i : i + SLICE]))


def key_sketch(keys: DataFrame) -> np.ndarray:
    """A sketch of keys: a key whose slot is 0 is not among them."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            counts += np.bincount(_slot(batch.column(0).to_numpy()), minlength=len(counts)).astype(np.uint32)
        rows = list(_slices(counts))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "counts"])

    return sum_sketch(keys.mapInArrow(run, "slice int, counts binary"))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the smallest type; the length tells which."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {SLICE: np.uint8, 2 * SLICE: np.uint16, 4 * SLICE: np.uint32}[len(data)])


def sum_sketch(parts: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus: 2^SKETCH_BITS counts, whatever the input."""

    def run(batches):
        unpack, totals = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number not in totals:
                    totals[number] = np.zeros(SLICE, np.uint64)
                totals[number] += _wide(unpack.decompress(data.as_py()))
        pack = zstandard.ZstdCompressor(level=1)
        rows = [pack.compress(_narrow(np.minimum(t, np.uint64((1 << 32) - 1)).astype(np.uint32))) for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(rows, pa.binary())], ["slice", "counts"])

    # Partial sums by input group first, so that no task gets a part from every task of a large input.
    folded = parts.withColumn("fold", F.pmod(F.xxhash64("counts"), F.lit(32)))
    once = folded.repartition("slice", "fold").select("slice", "counts").mapInArrow(run, "slice int, counts binary")
    summed = once.repartition("slice").mapInArrow(run, "slice int, counts binary").collect()
    sketch, unpack = np.zeros(1 << SKETCH_BITS, np.uint32), zstandard.ZstdDecompressor()
    for row in summed:
        sketch[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = _wide(unpack.decompress(row["counts"]))
    return sketch


def index(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``sig, key, n``: the signatures of every set, once per task and set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    frequent = FREQUENT + 2 * int(sketch.mean(dtype=np.float64))

    def run(batches):
        counts, done = shared.value, set()
        for batch in batches:
            found, keys, sizes = [], [], []
            for texts in _chunks(batch, 0):
                tokens, lengths = token_sets(texts)
                seen = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                stops = np.cumsum(lengths).tolist()
                for key, size, stop in zip(set_keys(tokens, lengths).tolist(), lengths.tolist(), stops, strict=True):
                    if size and key not in done:
                        done.add(key)
                        found.append(signatures(tokens[stop - size : stop], seen[stop - size : stop], frequent))
                        keys.append(key)
                        sizes.append(size)
            if found:
                lengths = [len(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths))],
                    ["sig", "key", "n"],
                )

    return docs.select("text").mapInArrow(run, "sig bigint, key bigint, n int")


def _similar_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= LEAST_PERCENT * np.maximum(a, b).astype(np.int64)


def runs(signed: DataFrame) -> DataFrame:
    """``sig, a, b, n``: pairs of near items of a run (sig NULL), and the items of runs longer than the window (b NULL)."""
    names = ["sig", "a", "b", "n"]

    def part(sig, key, n, long):
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        sig, key, n = sig[keep], key[keep], n[keep]
        for gap in range(1, WINDOW + 1):
            near = (sig[gap:] == sig[:-gap]) & _similar_length(n[gap:], n[:-gap])
            one, two = key[gap:][near], key[:-gap][near]
            if len(one):
                low, high = np.minimum(one, two), np.maximum(one, two)
                by = np.lexsort((high, low))
                low, high = low[by], high[by]
                new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
                count = int(new.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(count, pa.int64()), pa.array(low[new]), pa.array(high[new]), pa.nulls(count, pa.int32())], names)
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        lengths = np.diff(np.r_[starts, len(sig)])
        parts = long & (np.arange(len(starts)) == 0)
        many = np.repeat((lengths > WINDOW + 1) | parts, lengths)
        # Runs of the same items are one run: they are named by their items, unless they come in parts.
        same = np.add.reduceat(mix(key.view(np.uint64)), starts).view(np.int64)
        sig = np.repeat(np.where(parts, sig[starts], same), lengths)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[many]), pa.array(key[many]), pa.nulls(int(many.sum()), pa.int64()), pa.array(n[many])], names)

    def run(batches):
        rest, long = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)], False
        for columns in _stretches(batches):
            sig, key, n = (np.concatenate([r, c]) for r, c in zip(rest, columns, strict=True))
            if not len(sig):
                continue
            cut = int(np.searchsorted(sig, sig[-1]))  # the last run may go on
            if cut:
                yield from part(sig[:cut], key[:cut], n[:cut], long)
                long = False
            rest = [sig[cut:], key[cut:], n[cut:]]
            if len(rest[0]) > FLUSH:  # a very long run goes out in parts that overlap by the window
                yield from part(*rest, True)
                rest, long = [r[-WINDOW:] for r in rest], True
        if len(rest[0]):
            yield from part(*rest, long)

    laid = signed.repartition("sig").sortWithinPartitions("sig", "n", "key")
    return laid.mapInArrow(run, "sig bigint, a bigint, b bigint, n int")


def blobs_of(docs: DataFrame, keys: DataFrame, members: DataFrame, rows: int | None = None) -> DataFrame:
    """``key, blob``: one compressed text for each key; a sketch of the digests keeps most other texts from the shuffle.

    Texts are known by their digests, so their tokens are not made again.
    """
    # A set held by very many documents is one row before it is joined.
    first = members.groupBy("key").agg(F.min("digest").alias("digest"))
    wanted = durable(first.hint("merge").join(keys.hint("merge"), "key", "left_semi"), "wanted", rows)
    slots = wanted.select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(key_sketch(slots) > 0)

    def pack(batches):
        # A set fills eight bytes a token; the compressed text is less and gives the same tokens.
        shrink, done = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            found = [], []
            for text in _texts(batch, 0):
                digest = _digest(text)
                if digest not in done and shared.value[_slot(np.array([int.from_bytes(digest[:7])], np.int64))[0]]:
                    done.add(digest)
                    found[0].append(digest)
                    found[1].append(shrink.compress(text))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in found], ["digest", "blob"])

    texts = docs.select("text").mapInArrow(pack, "digest binary, blob binary")
    return durable(texts.hint("merge").join(wanted.hint("merge"), "digest").groupBy("key").agg(F.first("blob").alias("blob")), "texts", rows)


def plausible(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that the parity bitmaps leave possible: no text is fetched for the others."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    bits = members.join(ends, "key", "left_semi").groupBy("key").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    side = lambda end: bits.select(F.col("key").alias(end), F.struct("n", "bits").alias(f"of_{end}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a.n", "of_a.bits", F.col("of_b.n").alias("m"), F.col("of_b.bits").alias("others"))

    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            apart = np.zeros(len(total), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                one, two = folded([x, y], min(len(x), len(y)))
                apart[i] = np.bitwise_count(one ^ two).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(_near(apart, total)))

    return known.mapInArrow(run, "a bigint, b bigint")


def _near(apart: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` tokens together, whose bitmaps differ in ``apart`` bits, may be similar."""
    # At most this share of all tokens of two similar sets is in only one of them.
    return apart * (100 + LEAST_PERCENT) <= (100 - LEAST_PERCENT) * total


def verify(blobs: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """The pairs ``a, b`` whose texts reach the similarity, judged on whole sets."""
    # One item with very many partners is dealt to several tasks, each with the item's own text. Own texts and those of the
    # partners are fetched in one join.
    parts = 16
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("own"))
    own = dealt.select("a", F.col("a").alias("b"), "part").distinct().withColumn("own", F.lit(True))
    asked = dealt.unionByName(own).hint("merge").join(blobs.select(F.col("key").alias("b"), "blob").hint("merge"), "b")
    texts = asked.select("a", F.when(~F.col("own"), F.col("b")).alias("b"), "blob", "part")
    laid = texts.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        unpack, a, mine = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            out = [], []
            for x, y, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = shingles(unpack.decompress(blob.as_py()))
                if y is None:
                    a, mine = x, tokens
                elif x == a and _similar(mine, tokens):
                    out[0].append(x)
                    out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return durable(laid.mapInArrow(run, "a bigint, b bigint").distinct(), "links", rows)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not _similar_length(np.array(len(x)), np.array(len(y))):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= LEAST_PERCENT * (len(x) + len(y) - shared)


def late_candidates(long_runs: DataFrame, members: DataFrame, group: DataFrame) -> DataFrame:
    """``key, component``: items to compare with a larger component that they meet in a long run."""
    sizes = group.groupBy("component").agg(F.count("*").alias("size"))
    placed = long_runs.join(group.join(sizes, "component"), "key", "left").select(
        "sig", "key", "n", F.coalesce("component", "key").alias("component"), F.coalesce("size", F.lit(1)).alias("size")
    )
    several = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("sig")
    kept = placed.join(several, "sig")
    bits = members.join(kept.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("bits").alias("bits"))
    rows = kept.join(bits, "key").select("sig", "key", "n", "component", "size", "bits").repartition("sig").sortWithinPartitions("sig", "n", "key")

    def candidates(key, n, component, size, bits):
        """Unique (item, component) of a run sorted by length."""
        out = []
        for i in range(0, len(n), PACK_ROWS):
            for j in range(0, i + 1, PACK_ROWS):
                a, b = slice(i, i + PACK_ROWS), slice(j, j + PACK_ROWS)
                if 100 * n[b][-1] < LEAST_PERCENT * n[a][0]:
                    continue
                width = min(map(len, bits[a] + bits[b]))
                apart = np.zeros((len(n[a]), len(n[b])), np.int64)
                one, two = folded(bits[a], width), folded(bits[b], width)
                for w in range(one.shape[1]):
                    apart += np.bitwise_count(one[:, w, None] ^ two[None, :, w])
                total = n[a][:, None] + n[b][None]
                near = _near(apart, total)
                near &= _similar_length(n[a][:, None], n[b][None]) & (component[a][:, None] != component[b][None])
                x, y = np.nonzero(near)
                x, y = x + i, y + j
                smaller = (size[x] < size[y]) | ((size[x] == size[y]) & (component[x] < component[y]))
                out.append(np.stack([np.where(smaller, key[x], key[y]), np.where(smaller, component[y], component[x])]))
        return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)

    def run(batches):
        rest, bits = [np.zeros(0, np.int64)] * 5, []
        for last, batch in _with_end(batches):
            if batch is not None:
                rest = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
                bits += batch.column(5).to_pylist()
            sig = rest[0]
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
            stops = np.r_[starts[1:], len(sig)] if len(sig) else starts
            whole = len(starts) if last else max(0, len(starts) - 1)  # the last run may go on
            found = [candidates(*(r[a:b] for r in rest[1:]), bits[a:b]) for a, b in zip(starts[:whole], stops[:whole], strict=True)]
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["key", "component"])
            done = int(stops[whole - 1]) if whole else 0
            rest, bits = [r[done:] for r in rest], bits[done:]

    return rows.mapInArrow(run, "key bigint, component bigint").distinct()


def _stretches(batches):
    """The columns of batches, FLUSH rows or more at a time."""
    held, size = [], 0
    for last, batch in _with_end(batches):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
        if held and (last or size >= FLUSH):
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, size = [], 0


def _with_end(batches):
    for batch in batches:
        yield False, batch
    yield True, None


def _packs(rows: DataFrame) -> DataFrame:
    """``component, part, keys, blobs``: rows of ``component, key, blob`` in packs of bounded size."""

    def run(batches):
        held, keys, blobs, size = None, [], [], 0
        for last, batch in _with_end(batches):
            for row in [] if batch is None else zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (row[:2] != held or len(keys) >= PACK_ROWS or size > PACK_BYTES):
                    yield flush(held, keys, blobs)
                    keys, blobs, size = [], [], 0
                held = row[:2]
                keys.append(row[2])
                blobs.append(row[3])
                size += len(row[3])
        if keys:
            yield flush(held, keys, blobs)

    def flush(held, keys, blobs):
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]]), pa.array([held[1]], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([blobs], pa.list_(pa.binary()))],
            ["component", "part", "keys", "blobs"],
        )

    parted = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PACK_PARTS)).cast("int")).select("component", "part", "key", "blob")
    laid = parted.repartition("component", "part").sortWithinPartitions("component", "part", "key")
    return laid.mapInArrow(run, "component bigint, part int, keys array<bigint>, blobs array<binary>")


def verify_late(blobs: DataFrame, candidates: DataFrame, group: DataFrame, rows: int | None = None) -> DataFrame:
    """``a, b``: for each item and component at least one link, if there is any."""
    asked = _packs(candidates.join(blobs, "key")).select("component", F.col("keys").alias("asks"), F.col("blobs").alias("ask_blobs"))
    targets = candidates.select("component").distinct()
    lone = targets.join(group.select("component").distinct(), "component", "left_anti").select("component", F.col("component").alias("key"))
    inside = group.join(targets, "component", "left_semi").select("component", "key").unionByName(lone)
    own = durable(_packs(inside.join(blobs, "key")), "packs", rows)
    # Items go to the parts that their component has: one for a lone item, PACK_PARTS for a large component.
    spread = asked.join(own.select("component", "part").distinct(), "component")
    met = spread.join(own, ["component", "part"]).select("asks", "ask_blobs", "keys", "blobs")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [], []
            for asks, ask_blobs, keys, stored in zip(*(batch.column(i) for i in range(4)), strict=True):
                asks, keys = asks.as_py(), keys.as_py()
                sets = [shingles(unpack.decompress(b.as_py())) for b in stored]
                lengths = np.array([len(t) for t in sets])
                every = np.concatenate(sets)
                by = np.argsort(every, kind="stable")
                every, owner = every[by], np.repeat(np.arange(len(sets)), lengths)[by]
                for x, blob in zip(asks, ask_blobs, strict=True):
                    tokens = shingles(unpack.decompress(blob.as_py()))
                    low, high = np.searchsorted(every, tokens), np.searchsorted(every, tokens, side="right")
                    hits = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
                    shared = np.bincount(owner[hits], minlength=len(sets))
                    similar = np.flatnonzero(100 * shared >= LEAST_PERCENT * (len(tokens) + lengths - shared))
                    if len(similar):
                        out[0].append(x)
                        out[1].append(keys[similar[0]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return durable(met.mapInArrow(run, "a bigint, b bigint").filter("a <> b"), "links", rows)


def join_similar(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, key``: the group of every document under links of at least 0.8."""
    # Tables of steps get files in proportion to the documents, however many partitions a shuffle has.
    rows = docs.count()
    members, parts = survey(docs, rows)
    found = durable(runs(index(docs, sum_sketch(parts))), "runs", rows)
    pairs = durable(plausible(found.filter("b is not null").select("a", "b").distinct(), members), "pairs", rows)
    long_runs = durable(found.filter("b is null").select("sig", F.col("a").alias("key"), F.col("n").cast("bigint").alias("n")).distinct(), "long_runs", rows)
    # An item is compared in a pair or in a long run, so these are all keys that can be asked for.
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(long_runs.select("key"))
    blobs = blobs_of(docs, durable(keys.distinct(), "keys", rows), members, rows)
    links = verify(blobs, pairs, rows)
    group = durable(_groups(links, rows), "groups", rows)
    late = durable(late_candidates(long_runs, members, group), "late", rows)
    if not late.isEmpty():
        group = _groups(links.unionByName(verify_late(blobs, late, group, rows)), rows)
    return _label(members, group)


def _groups(links: DataFrame, rows: int | None = None) -> DataFrame:
    return connected_components(links, ["a", "b"], rows).select(F.col("customer_id").alias("key"), F.col("component_id").alias("component"))


def _label(members: DataFrame, group: DataFrame) -> DataFrame:
    """Every document with the smallest id of its component."""
    known = members.join(group, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = known.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    labelled = known.join(least, "component", "left")
    mine = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"), "key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row of each group, with the smallest id (NULL last), and all without a word."""
    # Rows are told apart by numbers, which are fixed by writing them, so repeated rows and equal or NULL ids are copies too.
    # All columns of a document travel as one, so that names of any kind cannot clash.
    rows = docs.count()
    numbered = durable(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered", rows)
    labels = durable(join_similar(numbered.select(F.col("row").alias("doc_id"), "doc.text")), "labels", rows).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    placed = labels.filter("n_shingles > 0").join(numbered.select("row", F.col("doc.doc_id").alias("id")), "row")
    least = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("least"))
    stay = least.select("least.row").unionByName(labels.filter("n_shingles = 0").select("row"))
    return few_files(numbered.join(stay, "row", "left_semi").select("doc.*"), rows)


SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) as na, any_value(b.n) as nb
    from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared where 100 * common >= 80 * (na + nb - common)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as seen from sets union select r.node, l.b from reach r join both_ways l on r.seen = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.seen) as component_id
from sets s join reach r on s.doc_id = r.node group by s.doc_id, len(s.s)
"""
