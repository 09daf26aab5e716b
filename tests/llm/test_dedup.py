"""Exact dedup, n-gram join and repeated passages against brute force and on edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from placelore.llm import exact_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, kept string, row long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(45)]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 9, 12, 19, 30, 80, 120]))]
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def shingle_sets(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def classes(rows, k, percent):
    sets = shingle_sets(rows, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_components_equal_brute_force(spark, k, percent):
    rows = corpus(k)
    found = ngram_join.jaccard_components(frame(spark, rows), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == classes(rows, k, percent)
    assert len(found) == len(rows)


def crossing_lists(spark, monkeypatch, texts):
    """The lists in which pairs across components meet, while the components are found."""
    tables = []
    monkeypatch.setattr(ngram_join, "stored", lambda df, f=ngram_join.stored: tables.append(f(df)) or tables[-1])
    found = ngram_join.jaccard_components(frame(spark, list(enumerate(texts))), 3, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == classes(list(enumerate(texts)), 3, 80)
    return next(t for t in tables if {"root", "bitmap"} <= set(t.columns))


def texts_that_share(n, words=300, shared=0.7, seed=3):
    rng = random.Random(seed)
    passage = [f"s{i}" for i in range(int(words * shared))]
    return [" ".join(passage + [f"x{rng.random()}" for _ in range(words - len(passage))]) for _ in range(n)]


def test_representatives_do_not_meet_the_members_of_their_lists_again(spark, monkeypatch):
    assert crossing_lists(spark, monkeypatch, texts_that_share(2)).count() == 0


def test_pairs_with_many_common_keys_meet_in_few_lists(spark, monkeypatch):
    lists = crossing_lists(spark, monkeypatch, texts_that_share(6))
    members = [r.asDict() for r in lists.collect()]
    by_key = {}
    for m in members:
        by_key.setdefault(m["key"], []).append(m)
    met = [
        (a["node"], b["node"])
        for rows in by_key.values()
        for a in rows
        for b in rows
        if a["node"] < b["node"] and a["root"] != b["root"] and not set(a["before"]) & set(b["before"])
    ]
    every = {(a["node"], b["node"]) for rows in by_key.values() for a in rows for b in rows if a["node"] < b["node"]}
    assert every and set(met) == every and len(met) <= 2 * len(every)


def test_every_boundary_between_subsets_and_lists_gives_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus(7, 80)]
    want = classes(rows, 1, 60)
    for below in (0, 6, 11):
        monkeypatch.setattr(ngram_join, "boundary", lambda mean, percent, b=below: b)
        found = ngram_join.jaccard_components(frame(spark, rows), 1, 60).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_jaccard_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "one TWO"), (None, "one two"), (9, "a b c d"), (8, "a b c d")]
    found = ngram_join.jaccard_components(frame(spark, rows), 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in found) == [
        (0, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (8, 2, 8), (9, 2, 8)
    ]
    assert ngram_join.jaccard_components(frame(spark, []), 3, 90).count() == 0
    kept = ngram_join.drop_near_copies(frame(spark, rows), 3, 90)
    assert kept.columns == frame(spark, []).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 8]


def test_exact_groups(spark):
    rows = [(5, "a b"), (3, "a  b"), (2, "ab"), (7, "x"), (6, "x"), (8, None), (9, ""), (10, " \t"), (None, "x"), (6, "x"), (11, "A b")]
    for share in (exact_dedup.HEAVY_SHARE, 0.2):
        found = exact_dedup.exact_groups(frame(spark, rows), share).collect()
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found)
        assert got == [
            (-1, 6, 4, False), (2, 3, 3, False), (3, 3, 3, True), (5, 3, 3, False), (6, 6, 4, True), (6, 6, 4, True), (7, 6, 4, False),
            (8, 10, 3, False), (9, 10, 3, False), (10, 10, 3, True), (11, 11, 1, True),
        ]
    by_id = {r["doc_id"]: r["text_sha256"] for r in found}
    assert by_id[5] == hashlib.sha256(b"ab").hexdigest() and by_id[8] == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 10, 11]
    assert kept.columns == frame(spark, []).columns
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0


def removed(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window,bits", [(20, 27), (20, 10), (3, 10)])
def test_repeated_passages_equal_brute_force(spark, window, bits):
    """A full sketch (few bits) lets more through and changes nothing."""
    rows = corpus(window + bits, 70) + [(900, " ".join(["ja"] * 200)), (901, "ja " * 30), (902, None), (903, "")]
    found = substring_dedup.repeated_passages(frame(spark, rows), window, bits).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == removed(rows, window)
    assert all((r["kept_text"] is None) == (r["n_removed"] == 0) for r in found)


def test_repeated_passages_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    found = substring_dedup.repeated_passages(frame(spark, [(None, text), (1, text), (1, text), (2, "ü " + text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found) == [(0, 0), (1, 30), (1, 30), (2, 30)]
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = ngram_join.components(edges.unionByName(edges.filter("false"))).collect()
    assert {r["root"] for r in found} == {1} and len(found) == 60


def test_smallest_and_largest_ids(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (5, "c"), (-(2**63), "c")]
    got = {(r["doc_id"], r["text_sha256"][:4]): r["keep_id"] for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert sorted(got.values()) == [-(2**63)] * 4 and len(got) == 4
