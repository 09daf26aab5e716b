import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placelore.functions import skew, text
from placelore.operators import enrich, evidence, reviews, selection, sessions, windows
from placelore.sources import store, texts


def hot_log(spark, n=3000):
    """One user owns most rows."""
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [
        (i, 1 if rng.random() < 0.7 else rng.randrange(2, 30), start + timedelta(seconds=rng.randrange(0, 5 * 86400)), rng.randrange(4))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "event_id bigint, idhash bigint, etimestamp timestamp_ntz, sid bigint")


def hours():
    return [(F.date_trunc("hour", "etimestamp"), False)]


def test_row_number_in_buckets_equals_the_window(spark):
    order = [F.col("etimestamp"), F.col("event_id")]
    out = skew.row_number(hot_log(spark), ["idhash"], order, hours(), "rn")
    out = out.withColumn("expected", F.row_number().over(Window.partitionBy("idhash").orderBy(*order)))
    assert out.filter("rn <> expected").count() == 0 and out.count() == 3000


def test_descending_buckets(spark):
    order = [F.desc("etimestamp"), F.desc("event_id")]
    out = skew.row_number(hot_log(spark), ["idhash"], order, [(F.date_trunc("day", "etimestamp"), True)], "rn")
    out = out.withColumn("expected", F.row_number().over(Window.partitionBy("idhash").orderBy(*order)))
    assert out.filter("rn <> expected").count() == 0


def test_previous_row_in_buckets_equals_lag(spark):
    w = Window.partitionBy("idhash").orderBy("etimestamp", "event_id")
    out = skew.previous_row(hot_log(spark), ["idhash"], ["etimestamp", "event_id"], hours(), ["event_id"], "prev")
    out = out.withColumn("expected", F.lag("event_id").over(w))
    assert out.filter(~F.col("prev.event_id").eqNullSafe(F.col("expected"))).count() == 0


def test_top_per_key_limits_before_the_exchange(spark):
    top = skew.top_per_key(hot_log(spark), ["idhash"], [F.col("event_id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_sessions_rules(spark):
    t0 = datetime(2024, 1, 1, 10, 0)
    rows = [
        (1, 1, t0, 5, "pizza"),
        (2, 1, t0 + timedelta(minutes=60), 6, "pizza"),  # same query, exactly an hour
        (3, 1, t0 + timedelta(minutes=70), 6, None),  # same place
        (4, 1, t0 + timedelta(minutes=80), 7, None),  # neither; NULL queries do not match
        (5, 1, t0 + timedelta(minutes=90), 8, "  "),
        (6, 1, t0 + timedelta(minutes=95), 9, "  "),  # blank queries do not match
        (7, 1, t0 + timedelta(minutes=156), 9, "x"),  # same place, 61 minutes later
        (8, 2, t0, 5, "pizza"),
    ]
    clicks = spark.createDataFrame(rows, "event_id bigint, idhash bigint, etimestamp timestamp_ntz, sid bigint, query string")
    places = spark.createDataFrame(
        [(5, "five", "Dining", "r", "S")], "sid bigint, title string, top_category string, region string, review_top_display string"
    )
    out = sessions.sessions(clicks, places).orderBy("idhash", "session_id").collect()
    assert [(r.idhash, r.session_id, r.n_clicks) for r in out] == [(1, 1, 3), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 1, 1)]
    assert (out[0].title, out[0].query, out[0].day_name) == ("five", "pizza", "Mon")
    assert out[0].end_ts == t0 + timedelta(minutes=70)


def test_popularity_equals_percent_rank(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", None]), rng.choice(["x", "y"]), rng.choice([None, 1, 2, 3, 9]), rng.randrange(1, 6)) for i in range(60)]
    poi = spark.createDataFrame(rows, "sid bigint, region string, top_category string, place_review_count bigint, n bigint")
    out = enrich.popularity(poi, F.col("n")).select("sid", F.col("review_pct_rank").alias("pct"))
    log = poi.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    w = Window.partitionBy("region", "top_category").orderBy(F.col("place_review_count").desc_nulls_last())
    expected = log.select("sid", F.round(F.percent_rank().over(w) * 100, 1).alias("pct")).distinct()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, expected.collect()))


def test_category_of_short_paths(spark):
    df = spark.createDataFrame([("a > b > c",), ("a",), (None,), ("a> ",)], "p string")
    assert [r[0] for r in df.select(text.category_at("p")).collect()] == ["b", None, None, ""]
    assert [r[0] for r in df.select(text.normalize_path("p")).collect()] == ["a > b > c", "a", None, "a"]


def test_unreadable_timestamp(spark):
    clicks = spark.createDataFrame([(1, "2024-01-01 10:00:00", 3), (1, "soon", 3)], "idhash bigint, etimestamp string, sid bigint")
    assert {r[0] for r in clicks.select(enrich.day_name("etimestamp")).collect()} == {"Mon", None}


def test_windows():
    w = windows.windows_ending(date(2024, 1, 30))
    assert (w.train_start, w.train_end, w.test_start, w.test_end) == tuple(
        map(date.fromisoformat, ("2023-12-27", "2024-01-16", "2024-01-17", "2024-01-30"))
    )
    with pytest.raises(ValueError):
        windows.Windows(w.test_start, w.test_end, w.train_start, w.train_end)


def test_selection_needs_both_windows_and_two_categories(spark):
    w = windows.windows_ending(date(2024, 1, 4), 2, 2)  # train 1-2, test 3-4
    def user(u, train, test, sids):
        return [(u, date(2024, 1, 1), sids[0], "q")] * train + [(u, date(2024, 1, 3), s, None) for s in (sids * test)[:test]]
    rows = user(1, 2, 2, [1, 2]) + user(2, 2, 2, [1, 1]) + user(3, 1, 9, [1, 2]) + user(4, 3, 3, [1, 2])
    clicks = spark.createDataFrame(rows, "idhash bigint, datestr date, sid bigint, query string")
    poi = spark.createDataFrame([(1, "root > A"), (2, "root > B")], "sid bigint, category_path string")
    out = selection.select_users(clicks, poi, w, 10, 2).collect()
    assert [(r.idhash, r.total_clicks, r.has_both, r.n_categories) for r in out] == [(4, 6, 2, 2), (1, 4, 2, 2)]


def test_review_cleaning(spark):
    rows = [(1, " a\n\t b ", False), (2, "\n", False), (3, None, False), (4, "x", True)]
    df = spark.createDataFrame(rows, "review_id bigint, text_review string, is_deleted boolean")
    assert [(r.review_id, r.text_review) for r in reviews.clean_reviews(df).collect()] == [(1, "a  b")]


def test_daily_text_forms(spark):
    schema = "idhash bigint, datestr date, text string"
    d = date(2024, 1, 1)
    i = spark.createDataFrame([(1, d, "i"), (2, d, "i")], schema)
    e = spark.createDataFrame([(1, d, "e"), (3, d, "e")], schema)
    out = {r.idhash: r.text for r in evidence.daily_text(i, e).collect()}
    assert out == {1: "[implicit data]\ni\n\n[explicit data]\ne", 2: "i", 3: "e"}
    assert {r.idhash: r.text for r in evidence.daily_text(i, e, implicit_only=True).collect()} == {1: "i", 2: "i"}


def test_prompt_parts_keep_every_row(spark):
    log = hot_log(spark, 400).withColumn("datestr", F.to_date("etimestamp")).withColumn("query", F.lit("q"))
    names = ("day_name", "title", "top_category", "category", "region", "review_top_display")
    log = log.withColumns({n: F.lit(n) for n in names})
    demo = spark.createDataFrame([], "idhash bigint, demo_text string")
    out = evidence.implicit_prompt(log, log.limit(0), demo, rows_per_prompt=7)
    lines = out.select(F.sum(F.size(F.split("prompt", "\n")) - 3)).first()[0]
    assert lines == 400
    assert out.select(F.max(F.size(F.split("prompt", "\n")))).first()[0] <= 10


def test_explicit_prompt_sparse_and_chunks(spark):
    day = lambda i: date(2024, 1, 1 + i % 5)
    rows = [
        (u, i, day(i), day(i), "Mon", f"p{i % 3}", "street", "root > A", f"review {{x}} {i}", "[k]", "age: 3" if u == 1 else "")
        for u, n in ((1, 4), (2, 7)) for i in range(1, n + 1)
    ]
    df = spark.createDataFrame(
        rows,
        "idhash bigint, row bigint, write_date_time date, visit_date_time date, visit_day string, place_name string, "
        "address string, category_path string, text_review string, keyword_list string, demo_text string",
    )
    out = evidence.explicit_prompt(df, "{few_shot}|{demographic_prompt}|{user_prompt}", "RICH", "SPARSE", 5).collect()
    got = {(r.idhash, r.chunk): r.prompt for r in out}
    assert set(got) == {(1, 0), (2, 0), (2, 1)}
    assert got[1, 0].startswith("SPARSE|age: 3|") and got[2, 1].startswith("RICH||") and "{x}" in got[1, 0]


def test_tolerant_reader_and_last_record(spark, tmp_path):
    folder = tmp_path / "datestr=2024-01-01"
    folder.mkdir()
    (folder / "part-0.txt").write_text(
        '{"idhash": "a", "persona_text": "old"}\n\n{"idhash": "a", "persona_text": " new "}\n'
        '{"idhash": "b", "persona_text": "  "}\n{"idhash": "", "persona_text": "x"}\n'
        '{"idhash": "c", "persona_text": "x"\nnot json\n{"idhash": "d", "persona_text": "t"} rest\n',
        encoding="utf-8",
    )
    out = texts.read_daily_texts(spark, str(tmp_path), texts.EXPLICIT_FIELD).collect()
    assert [(r.idhash, r.text, r.datestr) for r in out] == [("a", "new", date(2024, 1, 1))]


def test_writer_round_trip(spark, tmp_path):
    rows = [("a", date(2024, 1, 1), "line\nbreak"), ("b", date(2024, 1, 2), " ")]
    df = spark.createDataFrame(rows, "idhash string, datestr date, text string")
    texts.write_explicit(df, str(tmp_path / "out"))
    out = texts.read_daily_texts(spark, str(tmp_path / "out"), texts.EXPLICIT_FIELD).collect()
    assert [(r.idhash, r.text) for r in out] == [("a", "line\nbreak")]


def test_implicit_writer_round_trip(spark, tmp_path):
    usage = "struct<prompt_tokens:bigint,completion_tokens:bigint>"
    rows = [
        ("a", date(2024, 1, 1), "first\n\"quoted\"", "p1", (3, 4)), ("a", date(2024, 1, 2), "next", None, None),
        ("b", date(2024, 1, 1), None, "p2", (1, 0)), ("c", date(2024, 1, 1), "  ", "p3", (1, 1)),
    ]
    df = spark.createDataFrame(rows, f"idhash string, datestr date, response string, prompt string, usage {usage}")
    folder = str(tmp_path / "out")
    texts.write_implicit(df, folder)
    lines = [json.loads(r.value) for r in spark.read.schema("value string, datestr date").text(folder).orderBy("datestr", "value").collect()]
    assert len(lines) == len(rows)
    assert lines[0] == {"idhash": "a", "llm_response": "first\n\"quoted\"", "prompts": "p1", "usage": {"prompt_tokens": 3, "completion_tokens": 4}}
    out = texts.read_daily_texts(spark, folder, texts.IMPLICIT_FIELD).collect()
    assert sorted((r.idhash, str(r.datestr), r.text) for r in out) == [
        ("a", "2024-01-01", "first\n\"quoted\""), ("a", "2024-01-02", "next"),
    ]


def test_store_versions(spark, tmp_path):
    folder = str(tmp_path / "notes")
    v1 = spark.createDataFrame([(1, "root", 1), (2, "root", 1)], "idhash bigint, path string, updated_count bigint")
    store.write_version(v1, folder, date(2024, 1, 1))
    old = store.read_version(spark, folder, date(2024, 1, 1))
    new = spark.createDataFrame([(2, "root", 2)], old.schema)
    store.write_version(store.carry_over(old, new, new), folder, date(2024, 1, 2))
    store.write_version(store.carry_over(old, new, new), folder, date(2024, 1, 2))  # a repeated run
    out = store.read_versions(spark, folder).collect()
    assert sorted((str(r.run_date), r.idhash, r.updated_count) for r in out) == [
        ("2024-01-01", 1, 1), ("2024-01-01", 2, 1), ("2024-01-02", 1, 1), ("2024-01-02", 2, 2),
    ]


def test_token_prefix(spark):
    df = spark.createDataFrame([("a, b  c",)], "t string")
    row = df.select(text.token_count("t"), text.token_prefix("t", 3), text.token_prefix("t", 4), text.token_prefix("t", 9)).first()
    assert tuple(row) == (4, "a, b", "a, b  c", "a, b  c")


def test_repeated_dimension_rows_do_not_multiply_the_log(spark):
    poi = spark.createDataFrame(
        [(1, "b", "root > B", "r1 x", 3), (1, "a", "root > A", "r2 y", 4)],
        "sid bigint, title string, category_path string, road_addr string, place_review_count bigint",
    )
    clicks = spark.createDataFrame([(1, 1), (1, 1), (1, 9)], "idhash bigint, sid bigint")
    out = clicks.join(enrich.graded_poi(clicks, poi), "sid", "left").collect()
    assert sorted((r.sid, r.title) for r in out if r.title) == [(1, "a"), (1, "a")] and len(out) == 3
    assert enrich.enrich_saves(clicks, poi).count() == 3
