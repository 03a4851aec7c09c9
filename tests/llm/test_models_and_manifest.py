"""Resampling, the backoff automaton and the Merkle manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kithgraph.llm import manifest, resampling, scoring
from kithgraph.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(seed=3, n=90):
    rng = np.random.default_rng(seed)
    common = "The same LINE in many texts, over and over."
    rows = []
    for i in range(n):
        lines = [" ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(0, 9)))) for _ in range(int(rng.integers(1, 8)))]
        if i % 3 == 0:
            lines.insert(int(rng.integers(0, len(lines) + 1)), common)
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}" if i % 7 else None, 1))
    odd = [None, "", "\n\n", " \t", "Ünïcode ÄB çd", "one", "a " * 30000, "x\n" * 5000, "ONE two\r\nthree"]
    rows += [(1000 + i, t, None, "odd", None) for i, t in enumerate(odd)]
    rows += [(None, "no id " * 12, "en", "s1", 5), (None, "no id " * 12, "en", "s1", 5), (1005, "again " * 25, "en", "s2", 2), (1005, "again " * 25, "en", "s2", 2)]
    return rows


def extended(session, rows):
    """The table with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    docs = session.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit(7).alias(c) for c in ("row", "rank", "score", "digest", "line", "grp", "at", "size", "block", "held", "weight", "n")])


def runs(text, longest):
    words = WORDS.findall(ascii_lower(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, longest, buckets, percent=10, least=20, seed=2024):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    raw, goal = Counter(), Counter()
    for r in rows:
        raw.update(map(place, runs(r[1], longest)))
    for t in target:
        goal.update(map(place, runs(t, longest)))
    size, wanted = sum(raw.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (size + buckets) / ((raw[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for doc, text, *_ in rows:
        held = runs(text, longest)
        weight = sum(gain[place(g)] for g in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(runs(text, 1))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_matches_brute_force(session, longest):
    rows = documents()
    target = ["w1 w2 w3\nw4 w1", None, "", "Same line in w7"]
    goal = session.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(extended(session, rows), goal, longest=longest, buckets=500)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target, longest, 500)


def test_seams_and_lines_make_all_runs():
    for text in ("a b\nc\n\nd e f g h i\nj", "", "\n", "a", "a\nb\nc\nd", "p q r s t u v\nw x y z"):
        for longest in (1, 2, 3, 4):
            parts = resampling.seam_grams(text.encode(), longest)
            for line in text.encode().split(b"\n"):
                parts += resampling.line_grams(line, longest)
            assert Counter(parts) == Counter(g.encode() for g in runs(text, longest))


def test_equal_lines_are_counted_once(session):
    docs = session.createDataFrame([(i, "shared line\nown " + str(i)) for i in range(50)], "doc_id long, text string")
    lines = resampling.segments(docs).collect()
    assert len(lines) == 51 and sorted(r.occurrences for r in lines)[-1] == 50


def brute_scores(rows, order, strength):
    split = lambda text: ["\n", *re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text)), " "]
    held = lambda doc: zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2
    counts = Counter()
    for doc, text, *_ in rows:
        if not held(doc):
            words = split(text)
            counts.update(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1))
    single = {g: c for g, c in counts.items() if len(g) == 1 and g != ("\n",)}
    tokens = sum(single.values())

    def chance(context, word):
        if context is None:
            return (single.get((word,), 0) + 1) / (tokens + len(single) + 1)
        lower = chance(context[1:] if len(context) > 1 else None, word)
        return (counts[(*context, word)] + strength * lower) / (counts[context] + strength)

    out = []
    for doc, text, *_ in rows:
        words = split(text)
        base = sum(math.log10(chance(None, w)) for w in words[1:])
        score = sum(math.log10(chance(tuple(words[max(0, i - order + 1) : i]) or None, words[i])) for i in range(1, len(words)))
        out.append((doc, held(doc), len(words) - 1, sum((w,) in single for w in words[1:]), tokens, base, score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("order", "block", "part"), [(1, 1 << 20, 1 << 20), (2, 3000, 1500), (3, 20000, 700), (4, 1 << 22, 1 << 22)])
def test_automaton_scores_match_brute_force(session, order, block, part):
    """Small blocks and parts: contexts, arcs and failure arcs come from many answers."""
    rows = documents()
    got = scoring.score(extended(session, rows), order=order, strength=2.5, block=block, part=part).collect()
    want = brute_scores(rows, order, 2.5)
    got = sorted(map(tuple, got), key=lambda r: repr((*r[:5], round(r[6], 4))))
    want = sorted(want, key=lambda r: repr((*r[:5], round(r[6], 4))))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_automaton_is_a_distribution_that_beats_its_base(session):
    """Held-out texts whose words follow each other in few ways score higher with contexts."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        at, words = int(rng.integers(0, 30)), []
        for _ in range(40):
            words.append(f"w{at}")
            at = (at * 7 + int(rng.integers(0, 2))) % 30
        rows.append((i, " ".join(words)))
    got = [r for r in scoring.score(session.createDataFrame(rows, "doc_id long, text string"), strength=5.0).collect() if r.held_out]
    assert len(got) > 20 and all(r.score > r.base_score for r in got)


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (scoring.unpack_keys(scoring.pack_keys(keys)) == keys).all()
        assert (scoring.unpack(scoring.pack(keys)) == keys).all()


def brute_manifest(rows, fan):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(value(r[0]), value(r[3]), value(r[2]), value(r[4]), value(text))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        return levels

    def way(levels, at):
        path = []
        for level in levels[:-1]:
            low = at // fan * fan
            path.append((level[low:at], level[at + 1 : low + fan]))
            at //= fan
        return path

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0], leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[name]]))
    top = tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for g, name in enumerate(names):
        for i, (doc, digest, r) in enumerate(groups[name]):
            path = way(trees[g], i) + way(top, g)
            at = digest
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and r[1] is not None:
                at = leaf(r, ascii_lower(r[1]))
            for left, right in path:
                at = h(*left, at, *right)
            out.append((doc, digest, trees[g][-1][0], root, h(*[s for sides in path for side in sides for s in side]), at, at == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "step"), [(16, 2), (2, 1), (2, 3), (3, 2)])
def test_manifest_matches_brute_force(session, fan, step):
    """Sources of one leaf, of whole runs, and of a last run of one; several levels between the stored ones."""
    rows = [r for r in documents() if len(r[1] or "") < 9000]
    rows += [(2000 + i, f"Text {i}", None, "runs", i) for i in range(fan**3 + 1)] + [(5000 + i, "A", "x", f"many{i}", None) for i in range(2 * fan + 1)]
    got = manifest.Manifest(extended(session, rows), fan, step).proofs().collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(rows, fan)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_only_every_few_levels_are_kept(session):
    docs = session.createDataFrame([(i, "t", "en", "one", 1) for i in range(600)], DOCS)
    kept = manifest.Manifest(docs).levels
    assert [level.count() for level in kept] == [600, 3, 1]


def test_empty_tables(session):
    empty = session.createDataFrame([], DOCS)
    target = session.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, target).count() == 0
    assert scoring.score(empty).count() == 0
    assert manifest.manifest_digest(empty).count() == 0
    some = session.createDataFrame([(1, "a b " * 20, "en", "s", 3)], DOCS)
    assert resampling.resample(some, target).count() == 1
    # Every text is held out: nothing is known.
    alone = session.createDataFrame([(6, "a b c")], "doc_id long, text string")
    assert scoring.score(alone).first().n_known == 0
