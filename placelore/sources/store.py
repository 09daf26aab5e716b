"""Versioned notes store: read one run's version, write the next, never overwrite what is being read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(table: DataFrame, folder: str, run_date: date) -> None:
    """A repeated run replaces its own version only."""
    table.write.mode("overwrite").parquet(f"{folder}/run_date={run_date.isoformat()}")


def read_version(spark: SparkSession, folder: str, run_date: date) -> DataFrame:
    return spark.read.parquet(f"{folder}/run_date={run_date.isoformat()}")


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All versions with their ``run_date``."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/run_date=*").withColumn(
        "run_date", F.to_date("run_date")
    )


def carry_over(previous: DataFrame, updated: DataFrame, worked_users: DataFrame) -> DataFrame:
    """New version: updated rows of the users worked on, old rows of everybody else."""
    untouched = previous.join(worked_users.select("idhash"), "idhash", "left_anti")
    return untouched.unionByName(updated)


# -- versions that hold only what changed ---------------------------------------------------

#: Users are spread over so many partitions; fixed for the life of a store.
BUCKETS = 64


def _with_bucket(table: DataFrame, buckets: int) -> DataFrame:
    return table.withColumn("bucket", F.pmod(F.xxhash64("idhash"), F.lit(buckets)).cast("int"))


def _write_changed(rows: DataFrame, changed: DataFrame, folder: str, run_date: date) -> None:
    """The index comes last, so a version without it was never finished and is not read."""
    day = f"run_date={run_date.isoformat()}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/{day}")
    changed.select("bucket").distinct().coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/{day}")


def write_buckets(table: DataFrame, folder: str, run_date: date, buckets: int = BUCKETS) -> None:
    """First version of a store: all partitions."""
    every = table.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _write_changed(_with_bucket(table, buckets), every, folder, run_date)


def _current(spark: SparkSession, folder: str, schema: str, before: Column) -> DataFrame:
    """Rows with their bucket: of each partition the newest version that fulfils ``before``.

    The join side is the index, at most one row per bucket; it prunes the partitions that are read.
    """
    index = spark.read.schema("bucket int, run_date date").option("basePath", f"{folder}/index").parquet(f"{folder}/index")
    newest = index.filter(before).groupBy("bucket").agg(F.max("run_date").alias("run_date"))
    rows = spark.read.schema(f"{schema}, run_date date, bucket int").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return rows.join(F.broadcast(newest), ["run_date", "bucket"]).drop("run_date")


def read_as_of(spark: SparkSession, folder: str, schema: str, run_date: date) -> DataFrame:
    """The whole table as it was after the run of ``run_date`` (or the last one before)."""
    return _current(spark, folder, schema, F.col("run_date") <= F.lit(run_date)).drop("bucket")


def upsert(
    batch: DataFrame, folder: str, schema: str, run_date: date, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS
) -> None:
    """Writes the version of ``run_date``: the partitions with users of ``batch``, merged by ``merge(held rows, batch)``.

    Partitions without such users are neither read nor written, and earlier versions stay. A repeated run reads only versions
    before its own and replaces its own.
    """
    changed = _with_bucket(batch.select("idhash"), buckets).select("bucket").distinct()
    held = _current(batch.sparkSession, folder, schema, F.col("run_date") < F.lit(run_date))
    merged = merge(held.join(F.broadcast(changed), "bucket", "left_semi").drop("bucket"), batch)
    _write_changed(_with_bucket(merged, buckets), changed, folder, run_date)
