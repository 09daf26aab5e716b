"""Queries over the logs: windows, selection, scoring, change detection, enrichment, reviews."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage
from placelore.operators import changes, enrich, reviews, scoring, selection, sessions, windows
from placelore.plans.settings import *  # noqa: F403
from placelore.sources import tables as t

W = WINDOWS
TRAIN = (W.train_start, W.train_end)
TEST = (W.test_start, W.test_end)


def train_users(spark: SparkSession, d: str) -> DataFrame:
    clicks = t.clicks(spark, d, str(W.train_start), str(W.train_end))
    return selection.active_users(clicks, *TRAIN, MIN_CLICKS).select("idhash")


def clicks_in_window(spark, d):
    return windows.clicks_in_window(t.clicks(spark, d, *map(str, TRAIN)), train_users(spark, d), *TRAIN)


def temporal_split(spark, d):
    return windows.temporal_split(t.clicks(spark, d, str(W.train_start), str(W.test_end)), W).select(
        "event_id", "idhash", "datestr", "split"
    )


def sliding_windows(spark, d):
    return windows.sliding_windows(t.clicks(spark, d), FIRST_DAY, LAST_DAY)


def active_users(spark, d):
    return selection.active_users(t.clicks(spark, d, *map(str, TEST)), *TEST, MIN_CLICKS)


def category_diversity(spark, d):
    return selection.category_diversity(t.clicks(spark, d, *map(str, TEST)), t.poi(spark, d), *TEST)


def stream_flags(spark, d):
    span = (W.train_start, W.test_end)
    return selection.stream_flags(t.clicks(spark, d, *map(str, span)), *span)


def select_users(spark, d):
    clicks = t.clicks(spark, d, str(W.train_start), str(W.test_end))
    return selection.select_users(clicks, t.poi(spark, d), W, 2000, MIN_CLICKS)


def ground_truth(spark, d):
    clicks = t.clicks(spark, d, *map(str, TEST))
    return selection.ground_truth(clicks, t.poi(spark, d), train_users(spark, d), *TEST)


def recency(spark, d):
    return scoring.recency(t.clicks(spark, d), LAST_DAY)


def engagement_score(spark, d):
    return scoring.engagement_score(
        t.clicks(spark, d), t.reviews(spark, d), t.saves(spark, d), t.poi(spark, d), LAST_DAY
    )


def daily_activity_rollup(spark, d):
    return scoring.daily_activity_rollup(t.clicks(spark, d), t.poi(spark, d))


def exploratory_vs_confirmed(spark, d):
    return scoring.exploratory_vs_confirmed(t.clicks(spark, d), t.poi(spark, d), CONFIRMED, EXPLORATORY)


def user_hash(spark, d):
    return changes.user_hash(t.clicks(spark, d))


def change_status(spark, d):
    """Hashes of the 21 days up to the last day against those of the 21 days up to the test start."""
    now = t.clicks(spark, d, str(LAST_DAY - timedelta(days=20)), str(LAST_DAY))
    then = t.clicks(spark, d, str(W.test_start - timedelta(days=20)), str(W.test_start))
    return changes.change_status(changes.user_hash(now), changes.user_hash(then))


def resume_pending(spark, d):
    users = t.clicks(spark, d).select(F.col("idhash").alias("user_id"))
    done = t.prediction_responses(spark, d).select(F.col("idhash").alias("user_id"))
    return changes.resume_pending(users, done)


def demo_dedup(spark, d):
    return enrich.demo_dedup(t.raw_demo(spark, d), [F.col("updated").desc(), F.col("record_id").desc()])


def enrich_clicks(spark, d):
    return enrich.enrich_clicks(t.clicks(spark, d), t.poi(spark, d), t.demo(spark, d))


def enrich_saves(spark, d):
    return enrich.enrich_saves(t.saves(spark, d), t.poi(spark, d))


def clean_reviews(spark, d):
    return reviews.review_dedup(reviews.clean_reviews(t.reviews(spark, d)))


def enrich_reviews(spark, d):
    return enrich.enrich_reviews(reviews.clean_reviews(t.reviews(spark, d)), t.poi(spark, d), t.demo(spark, d)).select(
        "review_id", "idhash", "place_id", "place_name", "address", "category_path", "segment", "nation"
    )


def review_rank_pct(spark, d):
    return enrich.review_rank_pct(t.clicks(spark, d), t.poi(spark, d))


def sessions_query(spark, d):
    clicks = t.clicks(spark, d)
    places = enrich.graded_poi(clicks, t.poi(spark, d))
    return sessions.sessions(clicks, places, SESSION_GAP_MINUTES, place="top_category")


def place_sessions(spark, d):
    return sessions.place_sessions(t.clicks(spark, d), SESSION_GAP_MINUTES)


def reviews_for_day(spark, d):
    return reviews.reviews_for_day(t.reviews(spark, d), train_users(spark, d), REVIEW_DAY).select(
        "idhash",
        "review_id",
        "review_group_id",
        "place_id",
        "created_date",
        "text_review",
        F.array_join("keyword_list", ",").alias("keywords"),
    )


REVIEW_COLUMNS = ["review_id", "idhash", "place_id", "review_group_id", "created_date", "text_review"]


def review_clean(spark, d):
    return reviews.clean_reviews(t.reviews(spark, d)).select(*REVIEW_COLUMNS)


def review_dedup(spark, d):
    return clean_reviews(spark, d).select(*REVIEW_COLUMNS)


def stored_reviews(spark, d):
    """Preprocessed reviews as a materialized table; numbering reads them twice."""
    return cut_lineage(clean_reviews(spark, d))


def demo_texts(spark, d):
    return enrich.demo_text(t.demo(spark, d), ["segment", "nation"])


def review_rows(spark, d):
    enriched = enrich.enrich_reviews(stored_reviews(spark, d), t.poi(spark, d), t.demo(spark, d))
    return reviews.review_rows(enriched, demo_texts(spark, d))


def review_chunks(spark, d):
    return reviews.review_chunks(stored_reviews(spark, d), CHUNK).select("idhash", "review_id", "rn", "chunk", "n_reviews")


def scored_reviews(spark, d):
    return reviews.review_quality(
        reviews.clean_reviews(t.reviews(spark, d)), LAST_DAY, SOURCE_WEIGHTS, OPINION_WORDS, MENU_WORDS
    )


SCORES = [*reviews.QUALITY_WEIGHTS, "score"]


def review_quality(spark, d):
    return scored_reviews(spark, d).select("review_id", "idhash", *SCORES)


def review_eligible(spark, d):
    return reviews.review_eligible(reviews.clean_reviews(t.reviews(spark, d)), t.poi(spark, d)).select("idhash", "review_id")


def review_sample(spark, d):
    return reviews.review_sample(scored_reviews(spark, d)).select("idhash", "review_id", "score", F.col("rank").cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (
        clicks_in_window, temporal_split, sliding_windows, active_users, category_diversity, stream_flags,
        select_users, ground_truth, recency, engagement_score, daily_activity_rollup, exploratory_vs_confirmed,
        user_hash, change_status, resume_pending, demo_dedup, enrich_clicks, enrich_saves, enrich_reviews,
        review_rank_pct, reviews_for_day, review_clean, review_dedup, review_rows, review_chunks, review_quality,
        review_eligible, review_sample, place_sessions,
    )
} | {"sessions": sessions_query}
