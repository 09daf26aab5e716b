"""Runs compared with a search of every period at every place."""

import hashlib
import random

import numpy as np
import pytest

from placelore.llm import periodic_runs
from placelore.llm.queries import op11_periodic_runs, with_repetition
from test_texts import frame


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            length = stop - start + q
            if stop > start and length >= max(6, 4 * q) and smallest_period(words[start : start + length]) == q:
                out.add((start, length, q))
            start = max(stop, start) + 1
    return sorted(out)


def repetitive(rng, letters):
    out = []
    for _ in range(rng.randrange(6)):
        part = [rng.choice(letters) for _ in range(rng.randrange(1, 8))]
        out += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randrange(len(part) + 1)]
    return [w.encode() for w in out]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_runs_equal_brute_force(letters):
    rng = random.Random(len(letters))
    for _ in range(150):
        texts = [repetitive(rng, letters) for _ in range(rng.randrange(1, 9))]
        assert periodic_runs.runs(texts) == [brute(t) for t in texts]


def test_wavelet_tree_answers_order_statistics():
    rng = np.random.default_rng(4)
    values = rng.permutation(200)
    tree = periodic_runs.WaveletTree(values)
    lo = rng.integers(0, 150, 300)
    hi = lo + rng.integers(1, 50, 300)
    than = rng.integers(0, 200, 300)
    assert tree.smaller(lo, hi, than).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, than)]
    n = rng.integers(0, hi - lo)
    assert tree.nth(lo, hi, n).tolist() == [int(np.sort(values[a:b])[k]) for a, b, k in zip(lo, hi, n)]


def test_awkward_texts(spark):
    long = "a b c " * 30_000
    docs = frame(spark, [(None, None), (3, ""), (3, "x x x x x x"), (3, "x x x x x x"), (5, long), (6, " \t\n"), (7, "x x x x x")])
    docs = docs.withColumnRenamed("n_tokens", "runs").withColumnRenamed("ids", "collapsed")
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()))
    assert got == [
        (0, [], ""), (3, [], ""), (3, [(0, 6, 1)], "x"), (3, [(0, 6, 1)], "x"), (5, [(0, 90_000, 3)], "a b c"), (6, [], ""), (7, [], "x x x x x"),
    ]
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r.asDict() for r in op11_periodic_runs(spark, folder).collect()}
    docs = [d for d in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(d["text"] or "") < 6000]
    some = 0
    for d in docs:
        words = with_repetition(d["doc_id"], (d["text"] or "").encode().split())
        found = brute(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        some += bool(found)
        gone = {i for start, length, q in found for i in range(start + q, start + length)}
        assert rows[d["doc_id"]] == {
            "doc_id": d["doc_id"],
            "n_runs": len(found),
            "start": top and top[0],
            "length": top and top[1],
            "period": top and top[2],
            "exponent_milli": top and 1000 * top[1] // top[2],
            "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        }
    assert some > 10
