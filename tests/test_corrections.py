"""Scoring of everybody, whole totals, repeated batches, missing paths, restart, writers and usage."""

from datetime import date, datetime

import pandas as pd
from pyspark.sql import functions as F

from placelore.operators import changes, infer, notes, routing, scoring, stats, variants
from placelore.sources import results

D = date(2024, 1, 10)
POI = "sid bigint, place_id bigint, title string, category_path string, road_addr string, place_review_count bigint"


def test_users_without_clicks_are_scored(spark):
    clicks = spark.createDataFrame([(1, 5, D), (1, 6, D)], "idhash bigint, sid bigint, datestr date")
    others = spark.createDataFrame([(2,), (2,), (3,)], "idhash bigint")
    poi = spark.createDataFrame([(5, 5, "a", "root > A", "r", 1), (5, 5, "a", "root > B", "r", 1), (6, 6, "b", "root", "r", 1)], POI)
    out = {r.idhash: r for r in scoring.engagement_score(clicks, others, others.filter("idhash = 3"), poi, D).collect()}
    assert set(out) == {1, 2, 3}
    assert out[2].reviews == 1.0 and out[2].clicks == out[2].recency == out[2].diversity == 0
    assert out[1].diversity == 1.0  # a repeated place row counts once


def test_rollup_totals_are_the_events(spark):
    rows = [(1, D, "click", s) for s in (5, 5, 6, 7, None)]
    clicks = spark.createDataFrame(rows, "idhash bigint, datestr date, action string, sid bigint")
    poi = spark.createDataFrame([(5, 5, "a", "root > A > x", "r", 1), (6, 6, "b", "root > A", "r", 1)], POI)
    got = {(r.l2, r.l3): r.n for r in scoring.daily_activity_rollup(clicks, poi).collect()}
    assert got == {("A", "x"): 2, ("A", None): 3, (None, None): 5}


def test_hash_keeps_missing_parts_apart_and_cannot_overflow(spark):
    schema = "idhash bigint, etimestamp timestamp, sid bigint"
    log = spark.createDataFrame([(1, None, 7), (2, datetime(2024, 1, 1), None), (3, None, None)], schema)
    assert len({r.sha256 for r in changes.user_hash(log).collect()}) == 3
    plan = changes.user_hash(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(20,0)" in plan


def test_same_batch_twice_changes_nothing(spark):
    schema = "idhash bigint, axis string, item string, path string, polarity bigint, datestr date, support bigint"
    batch = spark.createDataFrame(
        [(1, "implicit", "a", "root > A", 1, D, 2), (1, "explicit", "b", "root > A", -1, D, 1), (2, "implicit", "a", "root", 1, D, 1)], schema
    )
    once = notes.apply_batch(batch)
    twice = notes.apply_batch(batch, *once)
    for a, b in zip(once, twice):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    later = batch.withColumn("datestr", F.date_add("datestr", 1))
    assert notes.apply_batch(later, *once)[0].agg(F.sum("support")).first()[0] == 8


def test_items_without_path_go_to_the_root(spark):
    schema = "idhash bigint, axis string, item string, path string, polarity bigint, datestr date, support bigint"
    items = spark.createDataFrame([(1, "implicit", "a", None, 1, D, 1), (1, "implicit", "b", " > ", 1, D, 1)], schema)
    taxonomy = spark.createDataFrame([("root > A",)], "path string")
    out = routing.route_items(items, taxonomy, items.select("idhash", "path", "item").limit(0)).collect()
    assert {(r.item, r.path) for r in out} == {("a", "root"), ("b", "root")} and all(r.route for r in out)


def test_a_continued_run_returns_old_and_new_rows(spark):
    users = spark.createDataFrame([(i,) for i in range(15)], "user_id bigint")
    done = users.filter("user_id < 10").withColumn("mrr", F.lit(0.5))
    asked = []

    def evaluate(pending):
        asked.append(pending.count())
        return pending.withColumn("mrr", F.lit(1.0))

    out = changes.continue_run(done, users, evaluate)
    assert asked == [5] and out.count() == 15 and out.filter("mrr = 1.0").count() == 5


def test_writers(spark, tmp_path):
    users = spark.createDataFrame([(1,), (2,)], "idhash bigint")
    results.write_users(users, f"{tmp_path}/users")
    assert spark.read.parquet(f"{tmp_path}/users").count() == 2
    truth = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "idhash bigint, category string")
    results.write_ground_truth(truth, f"{tmp_path}/truth")
    assert spark.read.parquet(f"{tmp_path}/truth").first().categories == ["a", "b"]
    rows = spark.createDataFrame([("x", 1, 0.5), ("y", 1, 1.0)], "variant string, idhash bigint, mrr double")
    results.write_results(rows, f"{tmp_path}/results")
    results.write_results(rows.withColumn("idhash", F.lit(2).cast("bigint")), f"{tmp_path}/results", "append")
    back = results.read_results(spark, f"{tmp_path}/results", "idhash bigint, mrr double, variant string")
    assert sorted((r.variant, r.idhash) for r in back.collect()) == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]
    summary = stats.variant_summary(rows.withColumns({m: F.lit(0.0) for m in stats.METRICS if m != "mrr"}))
    results.write_summary(summary, f"{tmp_path}/summary")
    results.write_comparison(summary, f"{tmp_path}/comparison")
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").count() == summary.count()
    reviews = spark.createDataFrame([(1, D), (2, None)], "idhash bigint, write_date_time date")
    results.write_reviews_by_day(reviews, f"{tmp_path}/reviews")
    assert spark.read.parquet(f"{tmp_path}/reviews").count() == 2


def test_usage_is_reported_or_counted(spark):
    prompts = spark.createDataFrame([(1, "a b"), (2, "c")], "idhash bigint, prompt string")
    request = infer.Request("be brief", 0.2)

    def plain(batch, asked):
        return batch + f" {asked.system_prompt} {asked.temperature}"

    out = {r.idhash: r for r in infer.with_usage(infer.infer(prompts, plain, request)).collect()}
    assert out[2].response == "c be brief 0.2" and out[1].usage.prompt_tokens == 2
    assert out[1].usage.total_tokens == out[1].usage.prompt_tokens + out[1].usage.completion_tokens

    def reporting(batch, asked):
        return pd.DataFrame({"response": batch, "prompt_tokens": 7, "completion_tokens": 1, "total_tokens": 8})

    out = infer.with_usage(infer.infer(prompts, reporting)).collect()
    assert {tuple(r.usage) for r in out} == {(7, 1, 8)}
    known = infer.known_responses(prompts, spark.createDataFrame([(1, "x")], "idhash bigint, response string"), ["idhash"])
    assert {(r.idhash, r.response) for r in known.collect()} == {(1, "x"), (2, None)}


def test_a_caller_can_bring_a_constructor(spark):
    users = spark.createDataFrame([(1,), (2,)], "idhash bigint")
    texts = spark.createDataFrame([(1, D, "hello")], "idhash bigint, datestr date, text string")
    variants.register("own", variants.Variant("Own", "own_kind", budget=3), lambda items, texts, budget: texts.select("idhash", F.concat("text", F.lit(str(budget))).alias("context")))
    try:
        out = variants.variant_contexts(users, None, texts, None, D, D, names=["own", "no_memory"]).collect()
    finally:
        del variants.PRESETS["own"], variants.CONSTRUCTORS["own_kind"]
    assert {(r.variant, r.idhash, r.context) for r in out} == {("own", 1, "hello3"), ("own", 2, ""), ("no_memory", 1, ""), ("no_memory", 2, "")}
