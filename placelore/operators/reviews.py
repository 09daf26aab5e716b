"""Review cleaning, deduplication, quality scoring, sampling and chunking."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.functions import skew
from placelore.functions.dimension import places_of
from placelore.functions.text import category_at

# Weights of the review quality score (fixed values).
QUALITY_WEIGHTS = {
    "text_score": 0.3,
    "engagement_score": 0.2,
    "source_score": 0.15,
    "opinion_score": 0.15,
    "menu_score": 0.1,
    "decay_score": 0.1,
}


def reviews_for_day(reviews: DataFrame, targets: DataFrame, day: date) -> DataFrame:
    """Reviews of target users updated on ``day``.

    The day is a half-open range on the update time, which scans can prune by.
    """
    lo = F.lit(day).cast("timestamp_ntz")
    hi = F.lit(day + timedelta(days=1)).cast("timestamp_ntz")
    return (
        reviews.filter((F.col("updated_time") >= lo) & (F.col("updated_time") < hi))
        .join(targets.select("idhash"), "idhash", "left_semi")
        .withColumn("keyword_list", F.flatten("codes"))
    )


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Line breaks and tabs to one space, trimmed; deleted, missing and empty reviews dropped."""
    text = F.trim(F.regexp_replace("text_review", r"[\n\t\r]+", " "))
    return reviews.withColumn("text_review", text).filter(
        ~F.col("is_deleted") & F.col("text_review").isNotNull() & (F.col("text_review") != "")
    )


def review_dedup(reviews: DataFrame) -> DataFrame:
    """Latest review per group; ties go to the larger id."""
    return skew.top_per_key(
        reviews, ["review_group_id"], [F.col("created_date").desc(), F.col("review_id").desc()], 1
    )


def _newest_first() -> tuple[list[Column], list[skew.Bucket]]:
    """Total order newest first and the (day, place range) buckets that are a prefix of it."""
    order = [F.col("created_date").desc(), F.col("place_id").desc(), F.col("review_id").desc()]
    return order, [(F.col("created_date"), True), (F.floor(F.col("place_id") / 64), True)]


def number_reviews(reviews: DataFrame, out: str = "row") -> DataFrame:
    """Row number per user: newest first, then place descending."""
    order, buckets = _newest_first()
    return skew.row_number(reviews, ["idhash"], order, buckets, out)


def review_rows(enriched: DataFrame, demo_texts: DataFrame) -> DataFrame:
    """The eleven output columns of preprocessed reviews."""
    return (
        number_reviews(enriched)
        .join(demo_texts, "idhash", "left")
        .select(
            "idhash",
            "row",
            F.col("created_date").alias("write_date_time"),
            F.col("visit_date").alias("visit_date_time"),
            F.date_format("visit_date", "E").alias("visit_day"),
            "place_name",
            "address",
            "category_path",
            "text_review",
            F.concat(F.lit("["), F.array_join(F.flatten("codes"), ", "), F.lit("]")).alias("keyword_list"),
            F.coalesce("demo_text", F.lit("")).alias("demo_text"),
        )
    )


def review_chunks(reviews: DataFrame, chunk_size: int = 50) -> DataFrame:
    """Chunk number per review and the user's total, newest first."""
    totals = reviews.groupBy("idhash").agg(F.count("*").alias("n_reviews"))
    numbered = number_reviews(reviews, "rn")
    return numbered.withColumn("chunk", F.floor((F.col("rn") - 1) / chunk_size).cast("bigint")).join(totals, "idhash")


def _lexicon_share(words: tuple[str, ...], scale: float) -> Column:
    """Lexicon words per 100 characters, as a share of ``scale``, at most 1."""
    text = F.lower("text_review")
    hits = F.regexp_count(text, F.lit(r"\b(?:" + "|".join(words) + r")\b"))
    return F.least(F.lit(1.0), hits * 100.0 / F.greatest(F.length(text), F.lit(1)) / scale)


def review_quality(
    reviews: DataFrame,
    as_of: date,
    source_weights: dict[str, float],
    opinion_words: tuple[str, ...],
    menu_words: tuple[str, ...],
    window_days: int = 90,
) -> DataFrame:
    """Six components in [0, 1] and their weighted sum, in one projection."""
    source = F.lit(0.5)
    for name, weight in source_weights.items():
        source = F.when(F.col("source") == name, F.lit(weight)).otherwise(source)
    age = F.date_diff(F.lit(as_of), "created_date")
    parts = {
        "text_score": F.least(F.lit(1.0), F.length("text_review") / 200.0),
        "engagement_score": F.least(F.lit(1.0), F.size(F.flatten("codes")) / 5.0),
        "source_score": source,
        "opinion_score": _lexicon_share(opinion_words, 5.0),
        "menu_score": _lexicon_share(menu_words, 5.0),
        "decay_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - age / float(window_days))),
    }
    scored = reviews.withColumns(parts)
    total = sum((F.col(name) * weight for name, weight in QUALITY_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("score", F.round(total, 6)).withColumns(
        {name: F.round(name, 6) for name in QUALITY_WEIGHTS}
    )


def review_eligible(
    reviews: DataFrame, poi: DataFrame, min_chars: int = 30, min_reviews: int = 3, min_categories: int = 2
) -> DataFrame:
    """Deduplicated long enough reviews of users with enough reviews in enough categories."""
    long_enough = review_dedup(reviews).filter(F.length("text_review") >= min_chars)
    places = places_of(poi, "place_id").select("place_id", category_at("category_path").alias("_category"))
    users = (
        long_enough.select("idhash", "place_id")
        .join(places, "place_id", "left")
        .groupBy("idhash", "_category")
        .agg(F.count("*").alias("_n"))
        .groupBy("idhash")
        .agg(F.sum("_n").alias("_n"), F.count("_category").alias("_categories"))
        .filter((F.col("_n") >= min_reviews) & (F.col("_categories") >= min_categories))
    )
    return long_enough.join(users, "idhash", "left_semi")


def review_sample(scored: DataFrame, per_user: int = 10) -> DataFrame:
    """The best reviews of each user."""
    return skew.top_per_key(scored, ["idhash"], [F.col("score").desc(), F.col("review_id")], per_user, "rank")
