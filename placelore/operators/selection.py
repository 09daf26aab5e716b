"""Choice of experiment users and their ground truth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.functions.dimension import places_of
from placelore.functions.text import category_at, has_text
from placelore.operators.windows import Windows, day_between


def _poi_category(poi: DataFrame, level: int = 1) -> DataFrame:
    return places_of(poi).select(
        "sid", category_at("category_path", level).alias("category")
    )


def active_users(clicks: DataFrame, start: date, end: date, min_clicks: int = 15) -> DataFrame:
    return (
        clicks.filter(day_between(start, end))
        .groupBy("idhash")
        .agg(F.count("*").alias("n_clicks"))
        .filter(F.col("n_clicks") >= min_clicks)
    )


def category_diversity(clicks: DataFrame, poi: DataFrame, start: date, end: date, min_categories: int = 2) -> DataFrame:
    """Distinct top categories per user among clicks that match a POI.

    Clicks are reduced to distinct (user, POI) before the join.
    """
    visited = clicks.filter(day_between(start, end)).select("idhash", "sid").distinct()
    return (
        visited.join(_poi_category(poi), "sid")
        .filter(F.col("category").isNotNull())
        .groupBy("idhash")
        .agg(F.count_distinct("category").alias("n_categories"))
        .filter(F.col("n_categories") >= min_categories)
    )


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("bigint")


def stream_flags(clicks: DataFrame, start: date, end: date) -> DataFrame:
    """Whether a user has searched (query given) and browsed (no query)."""
    searched = has_text("query")
    return clicks.filter(day_between(start, end)).groupBy("idhash").agg(
        _flag(searched).alias("has_search"), _flag(~searched).alias("has_browse")
    )


def select_users(clicks: DataFrame, poi: DataFrame, windows: Windows, n_users: int = 2000, min_clicks: int = 15) -> DataFrame:
    """Users active in both windows with at least two test categories, best ``n_users``.

    Counts and flags come from one conditional aggregate over one scan; only the test
    clicks of users that pass it are joined with the POI dimension. Order: both kinds of
    clicks first, then total clicks, then id.
    """
    w = windows
    in_train = F.col("datestr") <= F.lit(w.train_end)
    searched = has_text("query")
    candidates = (
        clicks.filter(day_between(w.train_start, w.test_end))
        .groupBy("idhash")
        .agg(
            F.count_if(in_train).alias("train_clicks"),
            F.count_if(~in_train).alias("test_clicks"),
            (_flag(searched) + _flag(~searched)).alias("has_both"),
        )
        .filter((F.col("train_clicks") >= min_clicks) & (F.col("test_clicks") >= min_clicks))
    )
    return (
        candidates.join(category_diversity(clicks, poi, w.test_start, w.test_end), "idhash")
        .withColumn("total_clicks", F.col("train_clicks") + F.col("test_clicks"))
        .select("idhash", "train_clicks", "test_clicks", "n_categories", "has_both", "total_clicks")
        .orderBy(F.desc("has_both"), F.desc("total_clicks"), "idhash")
        .limit(n_users)
    )


def ground_truth(
    clicks: DataFrame, poi: DataFrame, targets: DataFrame, start: date, end: date, level: int = 1
) -> DataFrame:
    """Distinct (user, category) visited in the window; ``level`` is the path segment used as category."""
    visited = (
        clicks.filter(day_between(start, end))
        .join(targets.select("idhash"), "idhash", "left_semi")
        .select("idhash", "sid")
        .distinct()
    )
    return (
        visited.join(_poi_category(poi, level), "sid", "left")
        .filter(F.col("category").isNotNull())
        .select("idhash", "category")
        .distinct()
    )
