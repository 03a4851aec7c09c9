"""License scans, secret scans, language and URL rules against brute force and on odd rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from kithgraph.llm import language, licenses, secrets, urls
from kithgraph.llm.common import prepare, scratch, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, sha string"
ODD = [
    (1, None, None, None, None, "k", "s"), (2, "", "en", "a", 0, None, None), (3, "x" * 300_000, "en", "a", 1, "", ""),
    (4, "CC by cc BY", "en", "b", 1, "k", "k"), (4, "CC by cc BY", "en", "b", 1, "k", "k"), (5, "1234 !?", "fr", None, 1, "k", "k"),
    (None, "General Public-License, v3", "en", "b", 1, "k", "k"), (7, "éall rights reserved all Rights\nRESERVED", "en", "b", 1, "k", "k"),
]
SECRETS = [
    (1, "Password = 'abc12345' token:short api-key=zzzzzzzz"), (2, "é\U0001f600 secret=abcdef AKIA" + "A" * 16 + " " + "0f" * 12),
    (3, "AKIA" + "B" * 15 + " " + "a" * 23 + " API_KEY: \"x=y/z+1\""), (4, None), (5, ""), (6, "Password = 'abc12345' token:short api-key=zzzzzzzz"),
    (7, "ſecret=abcdefgh toKen=abcdefgh ghp_" + "x" * 36 + " -----BEGIN RSA PRIVATE KEY-----"),
]


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def naive_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted(
        (i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )
    return len(words), places


def test_base_phrases_match_brute_force(session, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(session, sf, "documents").collect()] + [(r[0], r[1]) for r in ODD]
    docs = session.createDataFrame(rows, "doc_id long, text string").withColumn("extra", licenses.F.lit(1))
    found = sorted(map(tuple, licenses.license_digest(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    expected = []
    for key, text in rows:
        n, places = naive_licenses(text)
        at = [p for p, _ in places]
        expected.append((key, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert found == sorted(expected, key=repr)


@given(st.lists(st.sampled_from("licensed under the cc by nc general public license gnu all rights reserved mit xx".split()), max_size=60))
@settings(max_examples=200, deadline=None)
def test_matching_statistics_match_brute_force(words):
    m = licenses.matcher()
    texts = [" " + " ".join(w.decode() for w in t) + " " for _, t in m.phrases + m.templates]
    known = [m.vocabulary[w.encode()] for w in words if w.encode() in m.vocabulary]
    kept = [w for w in words if w.encode() in m.vocabulary]
    for i, (_, length) in enumerate(m.statistics(known)):
        longest = max(n for n in range(i + 2) if not n or any(" " + " ".join(kept[i + 1 - n : i + 1]) + " " in t for t in texts))
        assert length == longest


def test_templates_and_empty_table(session):
    text = "Foo. Licensed under the Apache License, Version 2.0. bar"
    edited = " ".join(w for i, w in enumerate(licenses.TEMPLATES[0][1].split()) if i != 9)
    docs = session.createDataFrame([(1, text), (2, edited), (3, "nothing of that kind")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.license_digest(docs).collect()}
    assert rows[1]["labels"] == "apache-2.0" and rows[1]["score"] == 1.0
    assert rows[2]["labels"] == "mit" and 0.75 <= rows[2]["score"] < 1
    assert rows[3]["labels"] == "" and rows[3]["score"] == 0
    assert licenses.license_digest(docs.limit(0)).collect() == []


def naive_secrets(text):
    text = text or ""
    kinds = {"assign": (f"(?ai){secrets.ASSIGN}", lambda m: len(m[2]) >= 6), "access": (secrets.ACCESS, lambda m: len(m[0]) >= 20), "hex": (secrets.HEX, lambda m: len(m[0]) >= 24)}
    found = [(m.start(), list(kinds).index(k), k, m.end()) for k, (p, good) in kinds.items() for m in re.finditer(p, text) if good(m)]
    return sorted(found)


def test_secrets_match_brute_force_and_the_ledger_scans_once(session, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(session, sf, "documents").collect()] + SECRETS
    docs = session.createDataFrame(rows, "doc_id long, text string")
    ledger = secrets.open_ledger(session, scratch(session, "ledger"))
    found = sorted(map(tuple, secrets.secret_digest(docs, ledger).drop("spans").collect()), key=repr)
    expected = []
    for key, text in rows:
        spans = naive_secrets(text)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
        expected.append((key, *[sum(k == kind for _, _, k, _ in spans) for kind in secrets.BASE_KINDS], digest))
    assert found == sorted(expected, key=repr)
    scanned = session.read.parquet(f"{ledger}/scanned").count()
    assert scanned == len({t or "" for _, t in rows})
    more = session.createDataFrame([*SECRETS, (99, "new token=abcdefgh")], "doc_id long, text string")
    again = {r["doc_id"]: r["n_assign"] for r in secrets.secret_digest(more, ledger).collect()}
    assert again[99] == 1 and again[1] == 1 and session.read.parquet(f"{ledger}/scanned").count() == scanned + 1
    assert secrets.secret_digest(docs.limit(0), ledger).collect() == []


def test_redaction_leaves_the_rest(session):
    docs = session.createDataFrame([(k, t, "x", None, 1) for k, t in SECRETS], "doc_id long, text string, _extra string, lang string, n_chars long")
    clean = {r["doc_id"]: r for r in secrets.redact(docs, secrets.open_ledger(session, scratch(session, "ledger"))).collect()}
    for key, text in SECRETS:
        spans, out, at = secrets.find_secrets((text or "").encode()), "", 0
        for _, s, e in spans:
            if s >= at:
                out += text[at:s] + "[secret]"
            at = max(at, e)
        assert clean[key]["text"] == (None if text is None else out + text[at:])
    assert list(clean[1].asDict()) == docs.columns


def test_language_held_out_accuracy(session):
    docs = table(session, "/root/testdata/sf0.01", "documents")
    rows = language.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(session):
    docs = session.createDataFrame(ODD, DOCS)
    rows = language.language_digest(docs).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 5)} == {"und"}
    nothing = language.language_digest(docs.filter("lang is null")).collect()
    assert [r["lang_pred"] for r in nothing] == ["und"] and language.language_digest(docs.limit(0)).collect() == []


URLS = [
    "http://a.net/x", "https://A.Example.NET/en/1?u=http://b.org/fr/", "http://example.com/de/1", "http://notexample.com/de/1", "x.org/fr/", None,
    "http://q.org/fr/1#x", "http://q.org/fr", "http://net", "http://net?x=/", "", "http://", "http://example.com/en/7",
]


def test_urls_match_brute_force(session):
    pages = session.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    for r in urls.judge_urls(pages).collect():
        url = (URLS + URLS[:3])[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fits = [(v, h + p) for v, h, p in urls.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == best[0] or (best[0] is None and r["verdict"] in ("allow", "block"))
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_a_very_long_text_is_scanned_whole(session):
    text = "word " * 400_000 + "password=hunter22"
    docs = session.createDataFrame([(1, text), (2, text), (3, "é" * 500_000 + " " + "0f" * 12)], "doc_id long, text string")
    ledger = secrets.open_ledger(session, scratch(session, "ledger"))
    rows = {r["doc_id"]: r for r in secrets.secret_digest(docs, ledger).collect()}
    assert rows[1]["spans"] == rows[2]["spans"] == "assign:2000000:2000017" and rows[3]["spans"] == "hex:500001:500025"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, ledger).collect()}
    assert clean[1] == clean[2] == "word " * 400_000 + "[secret]" and clean[3] == "é" * 500_000 + " [secret]"


def test_url_rules_of_any_length_match_brute_force(session):
    from itertools import combinations

    sets = [("block", "abcx", 30), ("allow", "aby", 25), ("allow", "acy", 25), ("allow", "bcx", 25), ("block", "de", 20), ("allow", "d", 20), ("block", "defg", 12), ("allow", "efg", 12)]
    labelled = [(sorted(f"p:{t}" for t in tokens), verdict) for verdict, tokens, n in sets for _ in range(n)]
    total, seen, support = len(labelled), {}, {}
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for part in combinations(tokens, n):
                seen[part] = seen.get(part, 0) + 1
                support[part, verdict] = support.get((part, verdict), 0) + 1
    every = {(p, v): c / seen[p] for (p, v), c in support.items() if c >= urls.SUPPORT * total and c / seen[p] >= urls.CONFIDENCE}
    rules = urls.mine_rules(session.createDataFrame(labelled, "tokens array<string>, verdict string"))
    found = {(tuple(r["rule_tokens"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    implied = {k for k, c in every.items() if len(k[0]) > 2 and any(v == k[1] and d >= c and set(p) < set(k[0]) for (p, v), d in every.items())}
    assert found == {k: c for k, c in every.items() if k not in implied} and any(len(p) > 2 for p, _ in found)
    asked = [("u1", ["p:a", "p:b", "p:c", "p:z"]), ("u2", ["p:a", "p:b", "p:y"]), ("u3", ["p:z"])]
    best = {r["url"]: (r["verdict"], r["confidence"]) for r in urls.match_rules(session.createDataFrame(asked, "url string, tokens array<string>"), rules).collect()}
    want = {u: max((c, v) for (p, v), c in every.items() if set(p) <= set(t)) for u, t in asked if any(set(p) <= set(t) for p, _ in every)}
    assert best == {u: (v, c) for u, (c, v) in want.items()} and best["u1"] == ("block", 1.0)
