"""Canonical tables (click log, POI base, reviews, ...) derived from the given parquet files.

A production deployment replaces this module by reads of its own tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions.text import has_text


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clicks(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Click log. ``start``/``end`` (inclusive days) reach the scan as a range on the timestamp."""
    events = read(spark, folder, "events")
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    sid = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id",
        F.col("user_id").alias("idhash"),
        F.col("ts").alias("etimestamp"),
        F.to_date("ts").alias("datestr"),
        sid.alias("sid"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("q"), (sid % 7).cast("string")))
        .when(F.col("event_type") == "view", F.lit("  "))
        .alias("query"),
        F.col("event_type").alias("action"),
    )


def saves(spark: SparkSession, folder: str) -> DataFrame:
    return clicks(spark, folder).filter(F.col("action") == "purchase").select(
        "event_id", "idhash", "sid", "etimestamp", "datestr"
    )


def poi(spark: SparkSession, folder: str) -> DataFrame:
    """POI base with short paths, NULL review counts and ties."""
    key = F.col("p_partkey")
    return read(spark, folder, "part").select(
        key.alias("sid"),
        key.alias("place_id"),
        F.col("p_name").alias("title"),
        F.when(key % 17 == 0, F.lit("root"))
        .otherwise(F.concat_ws(" > ", F.lit("root"), F.col("p_type"), F.col("p_brand")))
        .alias("category_path"),
        F.concat(F.lit("region"), (key % 5).cast("string"), F.lit(" street")).alias("road_addr"),
        F.when(key % 11 != 0, F.col("p_size")).cast("bigint").alias("place_review_count"),
    )


def demo(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(
        F.col("c_custkey").alias("idhash"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("bigint").alias("nation"),
    )


def raw_demo(spark: SparkSession, folder: str) -> DataFrame:
    """Demographic records with several versions per person, id column named ``idno``."""
    return read(spark, folder, "orders").select(
        F.col("o_custkey").alias("idno"),
        F.col("o_orderstatus").alias("household"),
        F.col("o_orderpriority").alias("occupation"),
        F.to_date("o_orderdate").alias("updated"),
        F.col("o_orderkey").alias("record_id"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with update times, nested keyword codes, deletions and shared groups."""
    doc = F.col("doc_id")
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor((doc % 30) / 3) * 3).cast("int"))
    toxic = read(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return (
        read(spark, folder, "documents")
        .join(toxic, "doc_id", "left")
        .select(
            doc.alias("review_id"),
            F.floor(F.sqrt(doc)).cast("bigint").alias("idhash"),
            ((doc * 7) % 200).alias("place_id"),
            F.floor(doc / 2).cast("bigint").alias("review_group_id"),
            created.alias("created_date"),
            F.date_sub(created, (doc % 3).cast("int")).alias("visit_date"),
            (created.cast("timestamp_ntz") + F.make_dt_interval(hours=(doc % 24).cast("int"))).alias("updated_time"),
            F.col("text").alias("text_review"),
            F.array(F.array("lang"), F.array("source")).alias("codes"),
            "source",
            (doc % 13 == 0).alias("is_deleted"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("is_negative"),
        )
    )


def prediction_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One model response per conversation, made from its texts, covering every branch of the tolerant parser.

    The named labels follow from the length of the texts; the smallest first word stands for prose.
    """
    case = F.col("idhash") % 5
    first, second, word = F.col("_first"), F.col("_second"), F.col("_word")
    label = lambda n: F.concat(F.lit('"Brand#'), n.cast("string"), F.lit('"'))
    quoted = F.concat(F.lit('"'), word, F.lit('"'))
    return (
        read(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("idhash"))
        .agg(F.sum(F.length("text")).alias("_n"), F.min(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("_word"))
        .select(
            "idhash", (F.col("_n") % 25 + 1).alias("_first"), (F.floor(F.col("_n") / 25) % 25 + 1).cast("bigint").alias("_second"), "_word"
        )
        .select(
            "idhash",
            F.when(case == 0, F.concat(F.lit('{"predictions": ['), label(first), F.lit(","), label(second), F.lit(","), label(first), F.lit("]}")))
            .when(case == 1, F.concat(F.lit('Sure: {"predictions": ['), label(first), F.lit(", 7, "), quoted, F.lit("]} thanks")))
            .when(case == 2, F.concat(F.lit("["), label(second), F.lit(","), quoted, F.lit("]")))
            .when(case == 3, word)
            .otherwise(F.lit(""))
            .alias("raw"),
        )
    )


def extraction_responses(spark: SparkSession, folder: str) -> DataFrame:
    """One review-extraction response per conversation turn."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    case = (F.col("conv_id") + F.col("turn")) % 6
    return read(spark, folder, "conversations").select(
        F.col("conv_id").alias("idhash"),
        "turn",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("datestr"),
        F.when(case == 0, F.concat(F.lit('[{"User_Info": "likes '), word, F.lit('"}, {"User_Info": "second", "Rationale": "r"}]')))
        .when(case == 1, F.concat(F.lit('Result: [{"User_Info": "'), word, F.lit('"}] done')))
        .when(case == 2, F.concat(F.lit('{"User_Info": "'), word, F.lit('"}')))
        .when(case == 3, F.concat(F.lit('[{"Other": "'), word, F.lit('"}]')))
        .when(case == 4, F.col("text"))
        .otherwise(F.lit(""))
        .alias("raw"),
    )


def message_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and completion text of every call."""
    return read(spark, folder, "conversations").select(
        F.col("conv_id").alias("idhash"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("datestr"),
        F.col("turn").alias("call_id"),
        F.when(F.col("role") == "user", F.col("text")).alias("prompt"),
        F.when(F.col("role") != "user", F.col("text")).alias("completion"),
    ).filter(has_text("prompt") | has_text("completion"))


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Base hierarchy: root, every top category, and its listed subcategories ``Brand#1`` .. ``Brand#9``."""
    part = read(spark, folder, "part")
    level2 = F.concat_ws(" > ", F.lit("root"), F.col("p_type"))
    level3 = F.concat_ws(" > ", level2, F.col("p_brand"))
    paths = F.array(F.lit("root"), level2, F.when(F.col("p_brand").rlike("^Brand#[1-9]$"), level3))
    return part.select(F.explode(paths).alias("path")).filter(F.col("path").isNotNull()).distinct()
