"""Joins of the logs with POI and demographics, popularity grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.functions.dimension import places_of
from placelore.functions.skew import top_per_key
from placelore.functions.text import category_at, leaf_category

# Upper bounds of the popularity grades in percent, and the label for the rest.
GRADE_BOUNDS = [(10, "S"), (30, "A"), (60, "B"), (85, "C"), (100, "D")]
NO_GRADE = "정보없음"
DAY_NAMES = {1: "Sun", 2: "Mon", 3: "Tue", 4: "Wed", 5: "Thu", 6: "Fri", 7: "Sat"}


def demo_dedup(demo: DataFrame, order: list[Column]) -> DataFrame:
    """One row per person, the first in ``order``; the id column may be called ``idno``."""
    if "idno" in demo.columns:
        demo = demo.withColumnRenamed("idno", "idhash")
    return top_per_key(demo, ["idhash"], order, 1)


def demo_text(demo: DataFrame, attributes: list[str]) -> DataFrame:
    """One header line per person from the known attributes."""
    parts = [F.concat(F.lit(f"{a}: "), F.col(a).cast("string")) for a in attributes]
    return demo.select("idhash", F.concat_ws(", ", *parts).alias("demo_text"))


def _grade(pct: Column) -> Column:
    expr = F
    for bound, label in GRADE_BOUNDS:
        expr = expr.when(pct <= bound, label)
    return expr.otherwise(NO_GRADE)


def _poi_attributes(poi: DataFrame) -> DataFrame:
    return places_of(poi).select(
        "sid",
        "title",
        "category_path",
        F.get(F.split("road_addr", " "), F.lit(0)).alias("region"),
        category_at("category_path").alias("top_category"),
        "place_review_count",
    )


def popularity(poi_rows: DataFrame, weight: Column) -> DataFrame:
    """Adds the percent rank and grade of the review count within (region, top category).

    ``weight`` is how many log rows a POI row stands for, so the result is that of
    ``percent_rank`` over the log without sorting the log: the rank only needs a histogram
    of distinct review counts. NULL counts rank last, NULL groups are groups.
    """
    group = ["region", "top_category"]
    rows = poi_rows.withColumn("_w", weight)
    histogram = rows.groupBy(*group, "place_review_count").agg(F.sum("_w").alias("_n"))
    by_count = Window.partitionBy(*group).orderBy(F.col("place_review_count").desc_nulls_last())
    ranked = histogram.select(
        *[F.col(c).alias(f"_{c}") for c in (*group, "place_review_count")],
        F.coalesce(F.sum("_n").over(by_count.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )
    same = [rows[c].eqNullSafe(ranked[f"_{c}"]) for c in (*group, "place_review_count")]
    share = F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    pct = F.round(share * 100, 1)
    return rows.join(ranked, same).select(
        *poi_rows.columns, pct.alias("review_pct_rank"), _grade(pct).alias("review_top_display")
    )


def graded_poi(clicks: DataFrame, poi: DataFrame, grain: str = "click") -> DataFrame:
    """POI attributes with popularity grade, one row per POI.

    ``grain='click'`` ranks log rows, so often clicked places weigh more (the rows of
    POIs unknown to the base form their own group); ``grain='poi'`` ranks places.
    """
    attributes = _poi_attributes(poi)
    if grain == "poi":
        return popularity(attributes, F.lit(1))
    clicked = clicks.groupBy("sid").agg(F.count("*").alias("n_rows")).join(attributes, "sid", "left")
    return popularity(clicked, F.col("n_rows")).drop("n_rows")


def day_name(timestamp: str) -> Column:
    """Label by map lookup; NULL for unreadable timestamps."""
    names = F.create_map(*[F.lit(x) for pair in DAY_NAMES.items() for x in pair])
    return names[F.dayofweek(F.try_to_timestamp(F.col(timestamp).cast("string")))]


def enrich_clicks(clicks: DataFrame, poi: DataFrame, demo: DataFrame, grain: str = "click") -> DataFrame:
    """Clicks with day name, POI attributes, popularity grade and demographics.

    ``etimestamp`` may be a string; unreadable ones give a NULL day name.
    """
    return (
        clicks.withColumn("day_name", day_name("etimestamp"))
        .join(graded_poi(clicks, poi, grain), "sid", "left")
        .join(demo, "idhash", "left")
    )


def enrich_saves(saves: DataFrame, poi: DataFrame) -> DataFrame:
    places = places_of(poi).select("sid", "title", "category_path")
    return saves.join(places, "sid", "left").withColumn(
        "category", leaf_category("category_path")
    )


def enrich_reviews(reviews: DataFrame, poi: DataFrame, demo: DataFrame) -> DataFrame:
    """Reviews of known places with demographics where known."""
    places = places_of(poi, "place_id").select(
        "place_id", F.col("title").alias("place_name"), F.col("road_addr").alias("address"), "category_path"
    )
    return reviews.join(places, "place_id").join(demo, "idhash", "left")


def review_rank_pct(clicks: DataFrame, poi: DataFrame) -> DataFrame:
    """Grades of every clicked POI at both grains."""
    by_click = graded_poi(clicks, poi, "click").select(
        "sid",
        "region",
        "top_category",
        F.col("review_pct_rank").alias("pct_click"),
        F.col("review_top_display").alias("grade_click"),
    )
    by_poi = graded_poi(clicks, poi, "poi").select(
        "sid", F.col("review_pct_rank").alias("pct_poi"), F.col("review_top_display").alias("grade_poi")
    )
    return by_click.join(by_poi, "sid", "left")
