"""Language-model scores from a weighted backoff automaton.

Model: n-grams up to ``ORDER`` with Dirichlet smoothing (MacKay and Peto, 1995): P(w | c) = (n(c w) + K P(w | c')) / (n(c) + K),
where c' is c without its first word, and P(w) = (n(w) + 1) / (N + V + 1). Every trained context is a state; a trained
n-gram is an arc with its log-probability; the failure arc of a state weighs log10 K / (n(c) + K) and leads to the state of
c'. A text is walked once from left to right: the state is carried from token to token, failure arcs are followed until an arc
takes the token, and the logarithms on the way add up. The root has an arc for every token, so the walk never sticks.

All n-grams of all training texts are kept: there is no cut by count and no cap. The automaton as a whole is never in one place.
Texts are packed into blocks of ``BLOCK`` bytes. A block asks for the counts of its distinct n-grams: keys are dealt by range
to parts of bounded size, a part adds up what the blocks trained and answers each block in the order of its keys. With the
answers a block has all arcs that its own texts can take, builds that part of the automaton and walks its texts. So a key
sends one entry per block however often it occurs, and a hot word makes no hot task.

Words and n-grams are told apart by 64 bits of a hash, so of 10^9 n-grams 0.03 pairs are expected to be taken as one.

Defined results: a NULL or empty text has the end token only; a NULL doc_id hashes as the empty text; very long texts are a
block of their own; repeated rows are scored and trained each; without any training text N = V = 0 and every token has
probability 1; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import CRC_TABLE, WORD, crc32_sql

ORDER = 2
STRENGTH = 200.0
BLOCK = 6 << 20
PART = 12 << 20
FOLDS, HELD_OUT = 7, 2
# No word holds white space, so these are no words.
START, END = b"\n", b" "


def _key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


START_KEY = _key(START)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes first."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising keys as their steps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Grams:
    """The n-grams of the texts of a block.

    All texts stand one after the other, each between a start and an end. ``keys[n]`` are the distinct n-grams in rising order,
    ``at[n]`` tells which of them ends at each token (-1: too few tokens before it), ``firsts`` where each text starts.
    """

    def __init__(self, texts: list[bytes], order: int) -> None:
        numbers, flat, lengths = _Numbers({START: 0, END: 1}), [], []
        for text in texts:
            words = text.lower().split()
            flat.append(0)
            flat.extend(map(numbers.__getitem__, words))
            flat.append(1)
            lengths.append(len(words) + 2)
        self.lengths = np.array(lengths, np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(flat)) - np.repeat(self.firsts, self.lengths)
        hashes = np.fromiter(map(_key, numbers), np.uint64, len(numbers))[np.array(flat, np.int64)]
        running, self.keys, self.at = hashes, {}, {}
        for n in range(1, order + 1):
            if n > 1:
                before = np.concatenate([np.zeros(1, np.uint64), running[:-1]])
                running = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashes + np.uint64(n))
            whole = np.flatnonzero(place >= n - 1)
            self.keys[n], inverse = np.unique(running[whole], return_inverse=True)
            self.at[n] = np.full(len(flat), -1)
            self.at[n][whole] = inverse

    def trained(self, n: int, train: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram occurs in the texts that train."""
        held = self.at[n][np.repeat(train, self.lengths) & (self.at[n] >= 0)]
        return np.bincount(held, minlength=len(self.keys[n]))


class Automaton:
    """The part of the backoff automaton that the texts of a block can reach, laid out along their tokens.

    The state of depth m at a token is the context of the m tokens that end there, if it was trained; its failure arc leads to
    the state of depth m - 1 at the same token and weighs ``back[m]``. An arc of order n is the trained n-gram that ends at the
    token it takes: from the state of depth n - 1 at the token before, with weight ``arc[n]``, to the state of depth n there, or
    of depth ``order`` - 1 if that is less. The root has depth 0 and an arc for every token.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], tokens: int, vocabulary: int, order: int, strength: float) -> None:
        self.grams, self.order = grams, order
        count = {n: np.where(grams.at[n] >= 0, counts[n][grams.at[n]], 0) for n in range(1, order + 1)}
        chance = (count[1] + 1.0) / (tokens + vocabulary + 1.0)
        self.met, self.arc, self.back = {1: count[1] > 0}, {1: np.log10(chance)}, {}
        for n in range(2, order + 1):
            context = np.concatenate([np.zeros(1, np.int64), count[n - 1][:-1]])
            chance = (count[n] + strength * chance) / (context + strength)
            self.met[n], self.arc[n] = count[n] > 0, np.log10(chance)
            self.back[n - 1] = np.log10(strength / (count[n - 1] + strength))

    def _by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each text; its start is none."""
        each = values.copy()
        each[self.grams.firsts] = 0
        return np.add.reduceat(each, self.grams.firsts)

    def known(self) -> np.ndarray:
        """Tokens of each text that training met."""
        return self._by_text(self.met[1].astype(np.int64))

    def base_scores(self) -> np.ndarray:
        """Each text's score by root arcs alone."""
        return self._by_text(self.arc[1])

    def walk(self, text: int) -> float:
        """log10 of the probability of the tokens of a text, in one traversal from left to right."""
        own = slice(self.grams.firsts[text], self.grams.firsts[text] + self.grams.lengths[text])
        met, arc = {n: v[own].tolist() for n, v in self.met.items()}, {n: v[own].tolist() for n, v in self.arc.items()}
        back = {n: v[own].tolist() for n, v in self.back.items()}
        deepest, known, total = self.order - 1, met[1], 0.0
        depth = min(deepest, 1) if known[0] else 0
        for at in range(1, len(known)):
            n = depth + 1
            while n > 1 and not met[n][at]:
                n -= 1
                total += back[n][at - 1]
            total += arc[n][at]
            depth = min(n, deepest) if known[at] else 0
        return total


def pack_blocks(docs: DataFrame, block: int = BLOCK, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``block, ids, held, sizes, texts``: texts side by side, compressed, about ``block`` bytes of them in a row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "ids", "held", "sizes", "bytes", "texts"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        number, squeeze, rows, size = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3), [], 0

        def flush() -> pa.RecordBatch:
            ids, held, texts = zip(*rows, strict=True)
            columns = [[number], [list(ids)], [list(held)], [[len(t) for t in texts]], [sum(map(len, texts))], [squeeze.compress(b"".join(texts))]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, out, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
                rows.append((doc.as_py(), out.as_py(), text.as_py() or b""))
                size += len(rows[-1][2]) + 64
                if size >= block:
                    yield flush()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield flush()

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    texts = docs.select("doc_id", (fold == held_out).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<bigint>, bytes bigint, texts binary")


def texts_of(row) -> list[bytes]:
    whole, at, texts = zstandard.ZstdDecompressor().decompress(row["texts"]), 0, []
    for size in row["sizes"]:
        texts.append(whole[at : at + int(size)])
        at += int(size)
    return texts


def ask(blocks: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """``part, n, block, keys, counts``: the distinct n-grams of each block that lie in each part, and how often they train."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(texts_of(row), order)
                for n in range(1, order + 1):
                    keys, counts = grams.keys[n], grams.trained(n, ~np.array(row["held"], bool))
                    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                    out = [(p, n, row["block"], pack_keys(keys[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    names, types = ["part", "n", "block", "keys", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return blocks.select("block", "held", "sizes", "texts").mapInArrow(run, "part bigint, n bigint, block bigint, keys binary, counts binary")


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one part and order, for each block in the order of its keys; what was trained in all is told once."""
    keys = [unpack_keys(k.as_py()) for k in asked["keys"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate([unpack(c.as_py()) for c in asked["counts"]])).astype(np.int64)
    replies = np.split(totals[inverse], np.cumsum([len(k) for k in keys])[:-1])
    words = totals[every != np.uint64(START_KEY)] if asked["n"][0].as_py() == 1 else np.zeros(0, np.int64)
    once = np.arange(len(keys)) == 0
    return asked.select(["block", "n", "part"]).append_column("totals", pa.array([pack(r) for r in replies], pa.binary())).append_column(
        "tokens", pa.array(once * words.sum(), pa.int64())
    ).append_column("vocabulary", pa.array(once * (words > 0).sum(), pa.int64()))


def score(
    docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, block: int = BLOCK, part: int = PART, folds: int = FOLDS, held_out: int = HELD_OUT
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = durable(pack_blocks(docs, block, folds, held_out), "blocks")
    parts = 1 + (blocks.agg(F.sum("bytes")).first()[0] or 0) // part
    asked = ask(blocks, parts, order)
    answers = durable(asked.groupBy("part", "n").applyInArrow(
        _answer, "block bigint, n bigint, part bigint, totals binary, tokens bigint, vocabulary bigint"
    ), "answers")
    tokens, vocabulary = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()

    def walk(packed: pa.Table, told: pa.Table) -> pa.Table:
        row = {c: packed[c][0].as_py() for c in ("sizes", "texts")}
        grams = Grams(texts_of(row), order)
        told = told.sort_by([("n", "ascending"), ("part", "ascending")])
        counts = {n: [np.zeros(0, np.uint64)] for n in range(1, order + 1)}
        for n, totals in zip(told["n"].to_pylist(), told["totals"], strict=True):
            counts[n].append(unpack(totals.as_py()))
        machine = Automaton(grams, {n: np.concatenate(c).astype(np.int64) for n, c in counts.items()}, tokens, vocabulary, order, strength)
        columns = [
            packed["ids"].combine_chunks().flatten(), packed["held"].combine_chunks().flatten(), pa.array(grams.lengths - 1), pa.array(machine.known()),
            pa.array(np.full(len(grams.lengths), tokens)), pa.array(machine.base_scores()), pa.array([machine.walk(text) for text in range(len(grams.lengths))]),
        ]
        return pa.table(columns, names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    met = blocks.groupBy("block").cogroup(answers.select("block", "n", "part", "totals").groupBy("block"))
    types = [kind, "boolean", "bigint", "bigint", "bigint", "double", "double"]
    return met.applyInArrow(walk, ", ".join(f"{name} {type_}" for name, type_ in zip(names, types, strict=True)))


def score_digest(docs: DataFrame) -> DataFrame:
    """Scores rounded to 6 decimals, since the last bits of a sum depend on the order of addition."""
    return score(docs).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


SQL = f"""
with {CRC_TABLE},
docs as (select row_number() over () as row, doc_id, {crc32_sql("coalesce(doc_id::varchar, '')")} % {FOLDS} = {HELD_OUT} as held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), [' ']) as words
    from documents cross join crc_table),
tokens as (select row, held_out, unnest(words) as w, unnest(range(len(words))) as i from docs),
pairs as (select row, held_out, w, i, coalesce(lag(w) over (partition by row order by i), chr(10)) as u from tokens),
unigrams as (select w, count(*) as c from pairs where not held_out group by 1),
bigrams as (select u, w, count(*) as c from pairs where not held_out group by 1, 2),
contexts as (select u, count(*) as c from pairs where not held_out group by 1),
size as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from unigrams),
judged as (select p.row, coalesce(unigrams.c, 0) as c, (coalesce(unigrams.c, 0) + 1.0::double) / (n + v + 1.0::double) as chance,
    coalesce(bigrams.c, 0) as met, coalesce(contexts.c, 0) as led
    from pairs p cross join size left join unigrams on unigrams.w = p.w left join bigrams on bigrams.u = p.u and bigrams.w = p.w left join contexts on contexts.u = p.u),
sums as (select row, count(*) as n_tokens, count(*) filter (c > 0) as n_known, fsum(log10(chance)) as base_score,
    fsum(log10(case when led = 0 then chance else (met + {STRENGTH}::double * chance) / (led + {STRENGTH}::double) end)) as score from judged group by 1)
select doc_id, held_out, n_tokens, n_known, (select n from size) as train_tokens, round(base_score, 6) as base_score, round(score, 6) as score
from docs join sums using (row)
"""
