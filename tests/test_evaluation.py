import random
import re

import numpy as np
from pytest import approx, mark, raises

from pyspark.sql import functions as F

from placelore.operators import changes, evaluate, evidence, infer, stats, variants

C = [f"c{i}" for i in range(1, 12)]


def metrics_of(spark, predicted, truth):
    p = spark.createDataFrame([("v", 1, predicted)], "variant string, idhash bigint, predictions array<string>")
    t = spark.createDataFrame([(1, c) for c in truth], "idhash bigint, category string")
    return evaluate.all_metrics(p, t).first().asDict()


def test_perfect(spark):
    m = metrics_of(spark, ["c1", "c2", "c9", *C[3:10]], ["c1", "c2", "c9"])
    assert [m[k] for k in ("precision@1", "precision@3", "recall@5", "hr@10", "mrr")] == [1.0] * 5


def test_no_hits(spark):
    m = metrics_of(spark, [*C[2:], "c11"], ["c1", "c2"])
    assert [m[k] for k in ("precision@1", "precision@3", "recall@5", "mrr")] == [0.0] * 4


def test_partial(spark):
    m = metrics_of(spark, ["c1", "c3", "c9", "c4", "c2", "c5", "c6", "c7", "c8", "c10"], ["c1", "c2", "c9"])
    assert m["precision@1"] == 1.0 and m["precision@3"] == approx(2 / 3, abs=1e-6)
    assert m["recall@5"] == 1.0 and m["hr@10"] == 1.0 and m["mrr"] == 1.0


def test_keys_and_missing_truth(spark):
    m = metrics_of(spark, ["c1"], ["c1"])
    assert set(m) - {"variant", "idhash"} == set(evaluate.METRICS)
    p = spark.createDataFrame([("v", 7, ["c1"])], "variant string, idhash bigint, predictions array<string>")
    t = spark.createDataFrame([(1, "c1")], "idhash bigint, category string")
    row = evaluate.all_metrics(p, t).first()
    assert all(row[k] == 0.0 for k in evaluate.METRICS)


def test_k_zero_and_repeated_predictions(spark):
    p = spark.createDataFrame([("v", 1, ["c1", "c1"])], "variant string, idhash bigint, predictions array<string>")
    t = spark.createDataFrame([(1, "c1")], "idhash bigint, category string")
    row = evaluate.precision_recall(p, t, ks=(0, 3), recall_k=5).first()
    assert row["precision@0"] == 0.0
    assert row["precision@3"] == approx(2 / 3, abs=1e-6)  # repeats count twice
    assert row["recall@5"] == 2.0


@mark.parametrize(
    "raw, expected",
    [
        ('{"predictions": ["a", "b"]}', ["a", "b"]),
        ('text {"predictions": ["a"]} more', ["a"]),
        ('["a", 7]', ["a", "7"]),
        ('{"other": 1}', None),
        ("", None),
        ('{"predictions": ["a"]} and {"x": 1}', ["a"]),
    ],
)
def test_parse_predictions(spark, raw, expected):
    df = spark.createDataFrame([(1, raw)], "idhash bigint, raw string")
    assert evaluate.parse_predictions(df).first()["predictions"] == expected


def test_padding_keeps_the_given_order(spark):
    df = spark.createDataFrame([(1, ["미용", "x", "쇼핑", "미용"]), (2, None)], "idhash bigint, predictions array<string>")
    rows = {r.idhash: r.predictions for r in evaluate.validate_pad(df).collect()}
    assert rows[1] == ["미용", "쇼핑", *evaluate.POI_CATEGORIES[:8]]
    assert rows[2] == evaluate.POI_CATEGORIES[:10]


@mark.parametrize(
    "raw, expected",
    [
        ('[{"User_Info": "a"}, {"User_Info": "b"}]', "- a\n- b"),
        ('x [{"User_Info": "a"}] y', "- a"),
        ('[1, {"User_Info": "a"}]', "- a"),
        ('{"User_Info": "a"}', None),
        ('{"k": [{"User_Info": "a"}]}', None),
        ('[{"Other": "a"}]', None),
        ("free text", None),
    ],
)
def test_explicit_parse(spark, raw, expected):
    df = spark.createDataFrame([(1, raw, "2024-01-02")], "idhash bigint, raw string, day string")
    df = df.withColumn("datestr", F.to_date("day")).drop("day")
    text = evidence.explicit_parse(df).first()["text"]
    assert text == (raw if expected is None else f"{evidence.EXPLICIT_HEADER} (2024-01-02):\n{expected}")


def test_holm_stops_at_the_first_failure(spark):
    rows = [("a", "m", 0.01), ("b", "m", 0.04), ("c", "m", 0.03), ("d", "m", 0.005)]
    out = stats.holm(spark.createDataFrame(rows, "variant string, metric string, p_value double"))
    assert {r.variant: r.significant for r in out.collect()} == {"d": True, "a": True, "c": False, "b": False}


def pairs(spark, values):
    rows = [("v", "m", i, float(a), float(b)) for i, (a, b) in enumerate(values)]
    return spark.createDataFrame(rows, "variant string, metric string, idhash bigint, baseline double, value double")


def test_effect_size(spark):
    row = stats.cohens_d(pairs(spark, [(1, 0), (2, 1), (3, 2)])).first()
    assert row.cohens_d == approx(1.0)
    assert stats.cohens_d(pairs(spark, [(1, 1), (1, 1)])).first().cohens_d == 0.0
    assert stats.cohens_d(pairs(spark, [(1, 0)])).first().cohens_d == 0.0


def test_bootstrap_forms_agree(spark):
    data = pairs(spark, [((i * 7) % 5 / 4, (i * 3) % 4 / 3) for i in range(200)])
    a = stats.paired_bootstrap(data, 4000).first()
    b = stats.paired_bootstrap(data, 400, "indexed").first()
    assert a.mean_diff == b.mean_diff
    assert a.ci_lower == approx(b.ci_lower, abs=0.03) and a.ci_upper == approx(b.ci_upper, abs=0.03)
    assert a.ci_lower < a.mean_diff < a.ci_upper


def test_bootstrap_without_difference(spark):
    row = stats.paired_bootstrap(pairs(spark, [(1, 1), (0, 0)]), 100).first()
    assert (row.mean_diff, row.ci_lower, row.ci_upper, row.p_value) == stats.empty_bootstrap()
    with raises(ValueError):
        stats.paired_bootstrap(pairs(spark, [(1, 1)]), 10, "other")


def test_resume(spark):
    users = spark.createDataFrame([(i,) for i in range(15)], "user_id bigint")
    done = spark.createDataFrame([(i,) for i in range(10)], "user_id bigint")
    assert changes.resume_pending(users, done).count() == 5


def test_presets():
    assert variants.preset("ours").title == "Ours"
    with raises(ValueError):
        variants.preset("unknown")


def test_infer(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "idhash bigint, prompt string")
    out = infer.infer(prompts, lambda batch, request: batch.str.upper())
    assert sorted((r.idhash, r.response) for r in out.collect()) == [(1, "A"), (2, "B")]


def test_change_status_partitions_users(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idhash bigint, sha256 string")
    then = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "idhash bigint, sha256 string")
    status = changes.change_status(now, then)
    assert {r.idhash: r.status for r in status.collect()} == {1: "new", 2: "unchanged", 3: "changed", 4: "gone"}
    assert {r.idhash for r in changes.users_to_process(status).collect()} == {1, 3}


def test_user_hash_counts_repeats_and_ignores_order(spark):
    schema = "idhash bigint, etimestamp timestamp_ntz, sid bigint"
    from datetime import datetime

    a, b = (1, datetime(2024, 1, 1), 5), (1, datetime(2024, 1, 2), 6)
    one = changes.user_hash(spark.createDataFrame([a, b], schema)).first().sha256
    two = changes.user_hash(spark.createDataFrame([b, a], schema)).first().sha256
    three = changes.user_hash(spark.createDataFrame([a, a, b], schema)).first().sha256
    assert one == two != three


def test_item_recall_equals_a_scan_for_phrases(spark):
    rng = random.Random(12)
    words = ["Tea", "tea", "green", "bar,", "seoul", "the"]
    contexts = [(v, u, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for v in ("full", "notes") for u in range(12)]
    contexts += [("full", 20, None), ("notes", 20, ""), ("full", 21, "tea")]
    items = [(u, rng.choice(["implicit", "explicit"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for u in [*range(12), 20] for _ in range(8)]
    items += [(0, "user_info", "never there"), (0, "implicit", "  "), (21, "implicit", "Tea"), (21, "explicit", "tea"), (30, "implicit", "tea")]
    found = evaluate.item_recall(
        spark.createDataFrame(contexts, "variant string, idhash bigint, context string"),
        spark.createDataFrame(items, "idhash bigint, axis string, item string"),
    ).cache()

    def flat(text):
        return " " + " ".join(re.findall(r"\w+|[^\w\s]", (text or "").lower())) + " "

    for row in found.collect():
        mine = {flat(i) for u, axis, i in items if u == row.idhash and axis != "user_info" and i.strip()}
        text = next(flat(c) for v, u, c in contexts if (v, u) == (row.variant, row.idhash))
        assert (row.n_items, row.found) == (len(mine), sum(i in text for i in mine))
    assert found.count() == 27 and 10 < found.agg({"found": "sum"}).first()[0]
    gap = {r.idhash: r for r in evaluate.item_recall_gap(found, "full", "notes").collect()}
    assert (gap[21].full_recall, gap[21].structured_recall, gap[21].gap) == (1.0, 0.0, -1.0) and 30 not in gap


def test_draws_are_those_of_md5():
    from hashlib import md5

    from placelore.functions.draws import picks

    for first, last, n in ((0, 12, 7), (98, 103, 1203), (9999, 10001, 9000)):
        found = picks(first, last, n)
        for b in range(first, last):
            assert found[b - first].tolist() == [int(md5(f"{b}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]


def test_bootstrap_over_ranges_of_users(spark, monkeypatch):
    """Groups of two sizes, more users than a task holds: the same replicates, and no row per draw."""
    from hashlib import md5

    monkeypatch.setattr(stats, "PACK", 8)
    monkeypatch.setattr(stats, "CELLS", 32)
    rows = [(v, m, i, (i * 7) % 5 / 4, (i * k) % 4 / 4) for v, k, size in (("a", 3, 50), ("b", 2, 50), ("c", 1, 30)) for m in ("m", "o") for i in range(size)]
    data = spark.createDataFrame(rows, "variant string, metric string, idhash bigint, baseline double, value double")
    found = {(r.variant, r.metric): r for r in stats.paired_bootstrap(data, 60, "indexed").collect()}
    assert len(found) == 6
    for (variant, metric), row in found.items():
        diffs = [b - v for x, m, _, b, v in rows if (x, m) == (variant, metric)]
        n = len(diffs)
        means = [sum(diffs[int(md5(f"{b}|{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)) / n for b in range(60)]
        above, below = sum(x >= 0 for x in means) / 60, sum(x <= 0 for x in means) / 60
        assert row.p_value == approx(min(1.0, 2 * min(above, below)), abs=1e-6)
        assert row.ci_lower == approx(float(np.percentile(means, 2.5)), abs=1e-6)
        assert row.ci_upper == approx(float(np.percentile(means, 97.5)), abs=1e-6)


def test_means_on_a_tie_do_not_depend_on_the_order(spark):
    """The mean is 0.2258955 exactly; sums of doubles end above or below it."""
    values = [0.1, 0.2, 0.3, 0.2258955 * 4 - 0.6]
    values = [round(v, 6) for v in values] * 25
    values[-1] = round(22.58955 - sum(values[:-1]), 6)
    rows = [("v", "m", i, v, v) for i, v in enumerate(values)]
    schema = "variant string, metric string, idhash bigint, baseline double, value double"
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[4]), sorted(rows, key=lambda r: -r[4])):
        found = stats.cohens_d(spark.createDataFrame(order, schema).coalesce(1)).first()
        assert (found.baseline_mean, found.variant_mean) == (0.225896, 0.225896)


def test_the_gap_builds_only_the_two_presets_it_compares(spark, monkeypatch):
    from placelore.plans import queries_memory

    asked = []
    rows = [(variant, 1, *[value] * len(evaluate.METRICS)) for variant, value in (("full_context", 0.5), ("ablation_backward", 0.25))]
    results = spark.createDataFrame(rows, ["variant", "idhash", *evaluate.METRICS])
    monkeypatch.setattr(queries_memory, "variant_results", lambda spark, d, names, days: asked.append(sorted(names)) or results)
    rows = queries_memory.experiment_gap(spark, "").collect()
    assert asked == [["ablation_backward", "full_context"]] and {r["gap"] for r in rows} == {-0.25}
