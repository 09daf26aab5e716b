"""Engagement scoring, recency and activity rollups."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.functions.dimension import places_of
from placelore.functions.skew import cut_lineage
from placelore.functions.text import category_at

# Weights of the engagement score (fixed values).
SCORE_WEIGHTS = {"clicks": 0.2, "reviews": 0.3, "saves": 0.15, "diversity": 0.2, "recency": 0.15}


def _recency(last: Column, as_of: date, window_days: int) -> Column:
    """1 on the day itself, linear to 0 at the end of the window."""
    age = F.date_diff(F.lit(as_of), last)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - age / F.lit(float(window_days))))


def recency(clicks: DataFrame, as_of: date, window_days: int = 30) -> DataFrame:
    return clicks.groupBy("idhash").agg(
        F.round(_recency(F.max("datestr"), as_of, window_days), 6).alias("recency")
    )


def engagement_score(
    clicks: DataFrame,
    reviews: DataFrame,
    saves: DataFrame,
    poi: DataFrame,
    as_of: date,
    n: int = 10000,
    window_days: int = 30,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Weighted sum of min-max normalized counts, category diversity and recency; best ``n`` users.

    Everybody in any of the three logs is scored; without clicks recency and diversity are 0.
    ``norm`` is min-max over the scored users (0 when constant), diversity is the share of
    all top categories the user has clicked. The logs are counted separately and the
    per-user counts are materialized, so that the extremes, which enter as one scalar
    subquery, do not scan the logs again.
    """
    categories = places_of(poi).select(
        "sid", category_at("category_path").alias("category")
    )
    variety = (
        clicks.select("idhash", "sid")
        .distinct()
        .join(categories.filter(F.col("category").isNotNull()), "sid")
        .groupBy("idhash")
        .agg(F.count_distinct("category").alias("n_categories"))
    )
    parts = [
        clicks.groupBy("idhash").agg(F.count("*").alias("n_clicks"), F.max("datestr").alias("last_day")),
        reviews.groupBy("idhash").agg(F.count("*").alias("n_reviews")),
        saves.groupBy("idhash").agg(F.count("*").alias("n_saves")),
        variety,
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part, allowMissingColumns=True)
    users = materialize(
        counted.filter(F.col("idhash").isNotNull())
        .groupBy("idhash")
        .agg(
            *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_clicks", "n_reviews", "n_saves", "n_categories")],
            F.coalesce(_recency(F.max("last_day"), as_of, window_days), F.lit(0.0)).alias("recency"),
        )
    )
    measures = ["n_clicks", "n_reviews", "n_saves"]
    extremes = users.agg(
        F.struct(*[F.struct(F.min(m).alias("lo"), F.max(m).alias("hi")).alias(m) for m in measures]).alias("e")
    ).scalar()
    n_all = categories.agg(F.count_distinct("category")).scalar()
    users = users.withColumn("_extremes", extremes)

    def norm(measure: str) -> Column:
        lo, hi = F.col(f"_extremes.{measure}.lo"), F.col(f"_extremes.{measure}.hi")
        return F.when(hi > lo, (F.col(measure) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    parts = users.select(
        "idhash",
        norm("n_clicks").alias("clicks"),
        norm("n_reviews").alias("reviews"),
        norm("n_saves").alias("saves"),
        F.coalesce(F.try_divide(F.col("n_categories"), n_all), F.lit(0.0)).alias("diversity"),
        "recency",
    )
    score = sum((F.col(name) * weight for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    rounded = parts.select(
        "idhash", *[F.round(name, 6).alias(name) for name in SCORE_WEIGHTS], F.round(score, 6).alias("score")
    )
    return rounded.orderBy(F.desc("score"), "idhash").limit(n)


def daily_activity_rollup(clicks: DataFrame, poi: DataFrame) -> DataFrame:
    """Events per user, day, action and category at each level of the tree (NULL = all below).

    A place counts at the levels its path has; places with short paths and places unknown to the POI base
    are part of the totals, which add up to the events. Counted per POI first, so the rollup expands counts and not events.
    """
    per_poi = clicks.groupBy("idhash", "datestr", "action", "sid").agg(F.count("*").alias("n"))
    levels = places_of(poi).select(
        "sid", category_at("category_path", 1).alias("l2"), category_at("category_path", 2).alias("l3")
    )
    none = F.lit(None).cast("string")
    ways = F.array(
        F.struct(F.col("l2").alias("l2"), F.col("l3").alias("l3"), (F.col("l3").isNotNull()).alias("known")),
        F.struct(F.col("l2").alias("l2"), none.alias("l3"), (F.col("l2").isNotNull()).alias("known")),
        F.struct(none.alias("l2"), none.alias("l3"), F.lit(True).alias("known")),
    )
    return (
        per_poi.join(levels, "sid", "left")
        .select("idhash", "datestr", "action", "n", F.inline(F.filter(ways, lambda w: w["known"])))
        .groupBy("idhash", "datestr", "l2", "l3", "action")
        .agg(F.sum("n").alias("n"))
    )


def exploratory_vs_confirmed(
    clicks: DataFrame, poi: DataFrame, confirmed_actions: tuple[str, ...], exploratory_actions: tuple[str, ...]
) -> DataFrame:
    """Clicks and searches apart from visits and reservations, per user and category."""
    per_poi = clicks.groupBy("idhash", "sid").agg(
        F.count_if(F.col("action").isin(*exploratory_actions)).alias("exploratory"),
        F.count_if(F.col("action").isin(*confirmed_actions)).alias("confirmed"),
    )
    return (
        per_poi.join(places_of(poi).select("sid", category_at("category_path").alias("category")), "sid")
        .filter(F.col("category").isNotNull())
        .groupBy("idhash", "category")
        .agg(F.sum("exploratory").alias("exploratory"), F.sum("confirmed").alias("confirmed"))
    )
