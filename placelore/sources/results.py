"""Writers of experiment inputs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_users(users: DataFrame, folder: str) -> None:
    users.select("idhash").write.mode("overwrite").parquet(folder)


def write_ground_truth(truth: DataFrame, folder: str) -> None:
    """Sorted category list per user; a user's categories are bounded by the category list."""
    truth.groupBy("idhash").agg(F.sort_array(F.collect_set("category")).alias("categories")).write.mode(
        "overwrite"
    ).parquet(folder)


def write_results(results: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Metric rows as CSV, one folder per variant; ``mode='append'`` continues an interrupted run."""
    results.write.mode(mode).partitionBy("variant").option("header", True).csv(folder)


def _one_csv(table: DataFrame, folder: str) -> None:
    """Small tables (a row per variant and metric) as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    """Means and standard deviations per variant and metric."""
    _one_csv(summary.orderBy("metric", "variant"), folder)


def write_comparison(comparison: DataFrame, folder: str) -> None:
    """Tests of every variant against the baseline."""
    _one_csv(comparison.orderBy("metric", "variant"), folder)


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Metric rows written by ``write_results``; ``schema`` names all columns, ``variant`` included."""
    return spark.read.schema(schema).option("header", True).csv(folder)


def write_reviews_by_day(reviews: DataFrame, folder: str) -> None:
    """Preprocessed reviews split by write date in one job."""
    reviews.withColumn("datestr", F.to_date("write_date_time")).write.mode("overwrite").partitionBy("datestr").parquet(folder)
