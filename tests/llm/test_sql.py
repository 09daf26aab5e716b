"""Queries with SQL return its rows; the pipeline's decisions equal those of its operators applied by brute force."""

import re

import pytest
from oracle_check import compare, duck

import corpus_pipeline
from placelore.llm import decontaminate, registry, toxicity
from placelore.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, name):
    problem = compare(registry.QUERIES[name](spark, FOLDER), duck(FOLDER), registry.ORACLE[name])
    assert problem is None, problem


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    model = toxicity.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    kept = {i: t for (i, t), s in zip(docs.items(), model.scores(list(docs.values()))) if s < corpus_pipeline.TOXIC}
    best = {}
    for i, t in sorted(kept.items()):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        if key not in best or len(t) > len(kept[best[key]]):
            best[key] = i
    kept = {i: kept[i] for i in best.values()}
    sets = {i: shingles(t) for i, t in sorted(kept.items())}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i}
    items = [decontaminate.words_of(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    kept = {
        i: t for i, t in kept.items()
        if all(decontaminate.coverage(x, decontaminate.words_of(t)) < decontaminate.COVERAGE for x in items if set(x) & set(decontaminate.words_of(t)))
    }
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in out} == set(kept) and len(out) == len(kept)
    assert all(r["round_trip"] and r["text"] == docs[r["doc_id"]] for r in out)


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, coverage int, score double, ids string"
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, "x y z"), (None, "x y z"), (5, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 1.0, "x") for i, t in rows], schema)
    want = {
        "toxicity": [-1, -1, -1, 1, 2, 3, 3, 5], "exact_dedup": [-1, 1, 3, 5], "ngram_jaccard": [-1, -1, -1, 1, 2, 3, 3, 5],
        "decontamination": [-1, -1, -1, 1, 2, 3, 3, 5], "sentencepiece": [-1, -1, -1, 1, 2, 3, 3, 5],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.select("doc_id").collect()) == want[name], name
        assert stage(spark, docs.filter("false"), FOLDER).count() == 0
