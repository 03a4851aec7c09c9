"""Jaccard join, mixing, packing, chat repair and the pipeline."""

import re
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from kithgraph.llm import chat, jaccard, mixing, packing
from kithgraph.llm.common import prepare, table
from kithgraph.session import steps

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def documents(seed=0, n=120):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, int(rng.integers(1, 120)))) for _ in range(n // 4)]
    shared = " ".join(f"s{x}" for x in range(60))
    for i in range(n // 2):
        words = texts[i % len(texts)].split()
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 9)}"
        texts.append(" ".join(words) if i % 5 else shared + " " + " ".join(words))
    group = [f"g{x}" for x in range(100)]
    for _ in range(n // 4):
        words = list(group)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 100))] = f"h{rng.integers(0, 9)}"
        texts.append(" ".join(words).upper())
    texts += [None, "", " \t\n", "one two", "One TWO", "x" * 200_000, "a b c d", texts[0], texts[0]]
    return [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


def brute_groups(rows):
    sets = {}
    for key, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in ((a, b) for a, b in product(sets, sets) if a < b and sets[a] and sets[b]):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(k, len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize("frequent", [64, 2])
def test_join_matches_brute_force(session, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FLUSH", 40)
    rows = documents(frequent)
    found = jaccard.join_similar(session.createDataFrame(rows, DOCS).withColumn("key", jaccard.F.lit(1)))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_groups(rows)


@given(st.integers(0, 10**6), st.integers(4, 200), st.integers(0, 3), st.floats(0, 1))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_signature(seed, n, classes, share):
    rng = np.random.default_rng(seed)
    universe = np.sort(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
    x = np.sort(universe[rng.permutation(2 * n)[:n]])
    y = x[rng.permutation(n)[: max(1, int(n * rng.uniform(0.8, 1)))]]
    extra = np.setdiff1d(universe, x)[: int(rng.integers(0, max(1, n // 8)))]
    y = np.unique(np.r_[y, extra])
    seen = dict(zip(universe.tolist(), (rng.random(2 * n) < share) * 1000 + rng.integers(0, 3, 2 * n)))
    if jaccard._similar(x, y) and not np.array_equal(x, y):
        one, two = (jaccard.signatures(s, np.array([seen[t] for t in s.tolist()]), 64) for s in (x, y))
        assert len(np.intersect1d(one, two))
        assert len(one) <= 4 * n + 4


def test_join_of_empty_table_and_ids(session):
    assert jaccard.join_similar(session.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f", None, None, None), (3, "A b c d e f", None, None, None), (3, "other words", None, None, None)]
    found = sorted(map(tuple, jaccard.join_similar(session.createDataFrame(rows, DOCS)).select("doc_id", "component_id").collect()), key=repr)
    assert found == [(3, 3), (3, 3), (None, 3)]


def test_one_row_of_each_group_stays(session):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(None, "g h i j k l", "en", "s", 1)] * 2 + [(None, "m n o p q r", "en", "s", 1), (4, "m n o p q r", "en", "s", 1)]
    rows += [(5, "other words here", "en", "s", 1), (5, "A b c d e f", "en", "s", 1), (6, None, None, None, None), (6, "", None, None, None)]
    left = sorted((tuple(r)[:2] for r in jaccard.one_of_each(session.createDataFrame(rows, DOCS)).collect()), key=repr)
    want = [(1, "a b c d e f"), (None, "g h i j k l"), (4, "m n o p q r"), (5, "other words here"), (6, None), (6, "")]
    assert left == sorted(want, key=repr)
    assert jaccard.one_of_each(session.createDataFrame([], DOCS)).collect() == []


@pytest.fixture
def many_partitions(session):
    """Shuffles of 64 partitions that are not merged: what a small table is dealt over on a large cluster."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: session.conf.get(key) for key in conf}
    for key, value in conf.items():
        session.conf.set(key, value)
    yield session
    for key, value in old.items():
        session.conf.set(key, value)


def files_by_table(folder):
    return Counter(path.parent.name for path in Path(folder.removeprefix("file://")).glob("*/part-*.parquet"))


@pytest.mark.parametrize("work", [lambda docs: packing.pack(docs, packing.clusters(docs)), jaccard.one_of_each], ids=["packing", "near copies"])
def test_steps_on_few_rows_write_few_files(many_partitions, work):
    rows = [(i, " ".join(f"w{(i // 2 * 31 + k * (i // 2 + 7)) % 997}" for k in range(40)), "en", "s", 200) for i in range(400)]
    docs = many_partitions.createDataFrame(rows, DOCS).repartition(64)
    with steps(many_partitions) as folder:
        assert work(docs).count() == (400 if work is not jaccard.one_of_each else 200)
        files = files_by_table(folder)
    assert {"survey", "runs", "texts", "links", "stars", "groups"} <= {name.split("-")[0] for name in files}
    assert max(files.values()) <= 2 * many_partitions.sparkContext.defaultParallelism


def test_mix_targets_and_reruns(session):
    docs = session.createDataFrame([*documents(), *[(900, "a b c", "en", "s1", 5)] * 3], DOCS)
    rows = mixing.mix_digest(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_digest(docs.repartition(3)).collect()))
    by = defaultdict(lambda: [0, 0, 0.0, 0.0])
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        at = by[sources[r["doc_id"]]]
        at[0], at[1], at[2], at[3] = at[0] + r["size"], at[1] + r["taken"], r["source_size"], r["target"]
    left, caps = sum(v[0] for v in by.values()), {}
    order = sorted(by, key=lambda s: (s is None, s))
    while True:  # the definition, literally
        free = [s for s in order if s not in caps]
        weight = {s: order.index(s) % 3 + 1 for s in order}
        share = {s: (left - sum(caps.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * by[s][0] for s in free if share[s] > 3 * by[s][0]}
        if not over:
            break
        caps |= over
    for s, (size, taken, source_size, target) in by.items():
        assert source_size == size and abs(target - {**share, **caps}[s]) < 1e-6 and abs(taken - target) <= 1
    assert mixing.mix_digest(docs.limit(0)).collect() == []


def test_slots_permute_blocks(session):
    sources = session.createDataFrame([("a", 1, 1000, 2500.0), ("b", 2, 64, 64.0), ("c", 3, 10, 7.0), ("d", 4, 0, 0.0)], "source string, source_nr long, source_size long, target double")
    slots = mixing.draw_slots(sources).collect()
    for source, epoch, words in ((1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 0, 64), (3, 0, 7)):
        mine = [r for r in slots if (r["source_nr"], r["epoch"]) == (source, epoch)]
        assert sum(r["words"] for r in mine) == words and len({r["block"] for r in mine}) == len(mine)
    counts = {(r["source_nr"], r["shard"]): r["slots"] for r in mixing.shard_counts(mixing.source_epochs(sources)).collect()}
    # Only slots that take words are kept; the counts are drawn for all.
    assert sum(counts.values()) >= len(slots) and {(r["source_nr"], r["shard"]) for r in slots} <= set(counts)
    assert all(len({s["slot"] for s in slots if (s["source_nr"], s["shard"]) == key}) <= n for key, n in counts.items())


def test_shard_counts_are_multinomial(session):
    """Slots of a source fall into shards independently and evenly, and each shard's slots are numbered on from the last one's."""
    sources = session.createDataFrame([("a", 1, 64 * 20000, 64.0 * 50000), ("b", 2, 64 * 3000, 64.0 * 3000)], "source string, source_nr long, source_size long, target double")
    rows = mixing.shard_counts(mixing.source_epochs(sources), 16).collect()
    for source, n in ((1, 50001), (2, 3000)):
        mine = sorted((r["shard"], r["slots"], r["first"]) for r in rows if r["source_nr"] == source)
        assert [s for s, _, _ in mine] == list(range(16)) and sum(c for _, c, _ in mine) == n
        assert [f for _, _, f in mine] == [sum(c for _, c, _ in mine[:i]) for i in range(16)]
        chi = sum((c - n / 16) ** 2 / (n / 16) for _, c, _ in mine)
        assert 3 < chi < 38  # 15 degrees of freedom: neither lopsided nor dealt in turn


def test_shards_hold_the_mix(session):
    docs = session.createDataFrame(documents(), DOCS)
    digest = {r["doc_id"]: r for r in mixing.mix_digest(docs).collect()}
    found, slots = defaultdict(lambda: [0, set()]), Counter()
    texts = {r[0]: r[1] for r in documents()}
    for r in mixing.mixed_shards(docs).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["text"] in texts[r["doc_id"]] and r["text"].strip() == r["text"]
        found[r["doc_id"]][0] += n
        found[r["doc_id"]][1].add(r["shard"])
        slots[r["source"], r["slot"]] += n
    assert {k: (v[0], len(v[1])) for k, v in found.items()} == {k: (r["taken"], r["n_shards"]) for k, r in digest.items() if r["taken"]}
    assert max(slots.values()) <= mixing.BLOCK


def test_mixed_documents_hold_the_taken_words(session):
    docs = session.createDataFrame(documents(), DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(docs).collect()}
    words, texts = defaultdict(int), {r[0]: r[1] for r in documents()}
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        # A stretch stands in its text as it is.
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_line_breaks_and_columns_of_any_name_survive_the_stages(session, tmp_path):
    from pyspark.sql import functions as F

    lines = [(i, "\n".join(f"The cat of house {i} and {j} went\tto the  dog number {i * j} with words" for j in range(30)), "en", f"s{i % 3}", 1) for i in range(30)]
    clash = ["size", "epoch", "target", "row_nr", "row", "start", "source_nr", "source_size", "score", "lang_pred", "_in", "doc", "sha", "spans", "low", "high", "shard", "tie", "_row", "_id", "_sha", "_spans"]
    docs = session.createDataFrame(lines, DOCS).select("*", *[F.lit(f"given {c}").alias(c) for c in clash])
    texts = {r[0]: r[1] for r in lines}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(session, docs, "")
        docs.write.parquet(f"{tmp_path}/{number}")
        docs = session.read.parquet(f"{tmp_path}/{number}")
        rows = docs.collect()
        assert rows and all(r[c] == f"given {c}" for r in rows for c in clash), name
        assert all(r["text"] in texts[r["doc_id"]] for r in rows)
    assert any("\n" in r["text"] and r["text"] != texts[r["doc_id"]] for r in rows)
    assert corpus_pipeline.STAGES[-1][1](session, docs, "").count() >= len(rows)


def test_small_texts_of_one_source_fill_their_bins(session):
    docs = session.createDataFrame([(i, f"a{i} b{i} c{i} d{i}", "en", "one", 1) for i in range(4000)], DOCS)
    filled = {r["bin"]: r["filled"] for r in packing.pack(docs).collect()}
    assert sum(filled.values()) == 16000 and sum(filled.values()) / (len(filled) * packing.CAPACITY) >= 0.85
    assert sorted(filled.values())[-7] >= 0.95 * packing.CAPACITY


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, 5)), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit_matches_brute_force(items):
    pieces = sorted(((s, 1 << a, 1 << b) for s, a, b in items), reverse=True)
    bins: list[list] = []
    for (size, source, cluster), (number, offset) in zip(pieces, packing.best_fit(pieces, 20)):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= max(size, 1) and not b[1] & source and not b[2] & cluster]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([20, 0, 0])
        assert (number, offset) == (i, 20 - bins[i][0])
        bins[i] = [bins[i][0] - size, bins[i][1] | source, bins[i][2] | cluster]


def test_packing_keeps_everything(session, sf):
    docs = table(session, sf, "documents").unionByName(session.createDataFrame([*documents(), *[(7, "same text here", "en", "s1", 1)] * 50], DOCS))
    rows = packing.pack(docs, packing.clusters(docs), shard_rows=100).collect()
    assert sum(r["size"] for r in rows) == docs.select(mixing.word_count(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    by = defaultdict(list)
    for r in rows:
        by[r["bin"]].append(r)
    for mine in by.values():
        assert sum(r["size"] for r in mine) == mine[0]["filled"] <= packing.CAPACITY
        at = 0
        for r in sorted(mine, key=lambda r: (r["offset"], r["size"])):
            assert r["offset"] == at
            at += r["size"]
    same = [r["bin"] for r in rows if r["doc_id"] == 7 and r["size"] == 3]
    assert len(same) == len(set(same)) == 50
    assert packing.pack(docs.limit(0)).collect() == []


def test_near_and_cut_copies_do_not_share_a_bin(session):
    words = [f"g{x}" for x in range(60)]
    near = [(i, " ".join([*words[:-1], f"h{i}"]), "en", "s1", 1) for i in range(12)]
    cut = [(100 + i // 2, " ".join(f"c{i // 2}x{x}" for x in range(60 if i % 2 else 20)), "en", "s2", 1) for i in range(24)]
    others = [(200 + i, " ".join(f"o{i}x{x}" for x in range(40)), "en", "s3", 1) for i in range(40)]
    twins = [(300, "t u v w x y", "en", "s4", 1), (None, "t u v w x y", "en", "s4", 1)]
    docs = session.createDataFrame([*near, *cut, *others, *twins], DOCS)
    rows = packing.pack(docs, packing.clusters(docs)).collect()
    assert len(rows) == docs.count() and sum(r["size"] for r in rows) == sum(len(r[1].split()) for r in [*near, *cut, *others, *twins])
    held = Counter((r["bin"], "near" if r["doc_id"] < 12 else r["doc_id"]) for r in rows if r["doc_id"] is not None)
    assert max(held.values()) == 1
    assert len({r["bin"] for r in rows if r["doc_id"] in (300, None)}) == 2


def test_texts_of_a_stretch_give_the_tokens_of_each_alone():
    texts = [(r[1] or "").encode() for r in documents(3, 40)]
    together, sizes = jaccard.token_sets(texts)
    alone = [jaccard.token_sets([t])[0] for t in texts]
    assert sizes.tolist() == [len(x) for x in alone] and np.array_equal(together, np.concatenate(alone))
    keys, bits = jaccard.set_keys(together, sizes), jaccard.parities(together, sizes)
    for text, tokens, key, bitmap in zip(texts, alone, keys.tolist(), bits, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
        assert len(tokens) == len({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, len(words) > 0))})
        width = 8 * len(bitmap)
        odd = {slot for slot, n in Counter(int(t) % width for t in tokens).items() if n % 2}
        assert {i for i in range(width) if bitmap[i // 8] >> (7 - i % 8) & 1} == odd
        assert jaccard.set_keys(tokens, np.array([len(tokens)])).tolist() == [key] and (key != 0 or not words)
    assert jaccard.word_counts(jaccard.pa.record_batch([[*(t.decode() for t in texts), None]], ["text"]), 0).to_pylist() == [*(len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts), 0]


def test_only_plausible_pairs_ask_for_texts(session):
    rows = [(i, " ".join(f"w{i}x{x if x != i else 'y'}" for x in range(80)), "en", "s", 1) for i in range(30)]
    rows += [(100 + i, " ".join(f"w{i}x{x}" for x in range(80)), "en", "s", 1) for i in range(30)]
    members, _ = jaccard.survey(session.createDataFrame(rows, DOCS))
    keys = {r["doc_id"]: r["key"] for r in members.collect()}
    pairs = [(keys[i], keys[j]) for i in range(30) for j in range(100, 130)]
    left = {tuple(r) for r in jaccard.plausible(session.createDataFrame(pairs, "a long, b long"), members).collect()}
    near = {(keys[i], keys[100 + i]) for i in range(30)}
    assert near <= left and len(left) < 2 * len(near)


def cheapest(roles):
    """Least cost over all sequences of out roles, by trying every one."""
    best = None
    for out in product(chat.ROLES, repeat=len(roles)):
        state, cost = "start", 0
        for role, target in zip(roles, out):
            step = min([*([chat.MERGE] if target == state else []), *([chat.INSERT * len(f)] if (f := chat._fill(state, target)) is not None else [])], default=None)
            if step is None:
                break
            cost += step + chat.RELABEL * (target != role)
            state = target
        else:
            cost += chat.INSERT * len(chat.ENDINGS[state])
            best = cost if best is None else min(best, cost)
    return best


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    assert text.count("<|im_end|>") == len(roles)
    roles = roles[1:] if roles[0] == "system" else roles
    assert roles == ["user", "assistant"] * (len(roles) // 2) and roles


@pytest.mark.parametrize("stretch", [1000, 2])
def test_repair_is_legal_and_cheapest(session, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rng = np.random.default_rng(5)
    names = ["system", "user", "assistant", "tool", None]
    given_ = {c: [names[i] for i in rng.integers(0, 5, int(rng.integers(1, 7)))] for c in range(40)}
    rows = [(c, t, r, f"t{t}" if t % 3 else None, "x") for c, roles in given_.items() for t, r in enumerate(roles)]
    rows += [(None, 1, "user", "hi <|im_end|>", "x"), (None, 1, "user", "hi <|im_end|>", "x")]
    found = chat.format_chats(session.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r["conv_id"]].append(r)
    for key, mine in by.items():
        mine.sort(key=lambda r: r["position"])
        legal("".join(r["piece"] for r in mine))
        assert sum(r["cost"] for r in mine) == cheapest(given_.get(key, ["user", "user"]))
    empty = session.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).collect() == []


def test_very_long_turns_stay_whole(session):
    long = "word " * 300_000
    rows = [(1, 1, "user", long), (1, 2, "assistant", "short"), (2, 1, "assistant", long)]
    found = chat.format_chats(session.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 3 and sum(long.strip() in r["piece"] for r in found) == 2
    for key in (1, 2):
        legal("".join(r["piece"] for r in sorted((r for r in found if r["conv_id"] == key), key=lambda r: r["position"])))


def test_pipeline_on_odd_rows(session, tmp_path):
    rows = [(i, f"The cat and the dog went to the house number {i} with token=abcdef{i:06d} and more words {i * 7}", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", None, 1) for i in range(5)] + [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, "123 456", "en", "s0", 7)]
    docs = session.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(session, at, str(tmp_path))
        assert at.columns == docs.columns
        kept = at.collect()
        if name == "language":
            assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {200, 201, 202}
        if name == "near_copies":
            assert sorted(r["doc_id"] for r in kept) == list(range(40))
        if name == "secrets":
            assert all("[secret]" in r["text"] and "abcdef" not in r["text"] for r in kept)
        at = session.createDataFrame(kept, docs.schema)
    packed = corpus_pipeline.run(session, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= set(range(40)) and sum(r["size"] for r in packed) > 500
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(session, str(empty)).collect() == []
