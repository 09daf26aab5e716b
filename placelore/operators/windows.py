"""Experiment time windows and date-restricted reads of the click log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Windows:
    """Inclusive, adjacent train and test day ranges."""

    train_start: date
    train_end: date
    test_start: date
    test_end: date

    def __post_init__(self) -> None:
        if not self.train_start <= self.train_end < self.test_start <= self.test_end:
            raise ValueError(f"train and test windows overlap or are empty: {self}")


def windows_ending(end: date, train_days: int = 21, test_days: int = 14) -> Windows:
    test_start = end - timedelta(days=test_days - 1)
    train_end = test_start - timedelta(days=1)
    return Windows(train_end - timedelta(days=train_days - 1), train_end, test_start, end)


def day_between(start: date, end: date, col: str = "datestr") -> Column:
    """Plain range on the partition column, so that partitions are pruned."""
    return F.col(col).between(F.lit(start), F.lit(end))


def clicks_in_window(clicks: DataFrame, targets: DataFrame, start: date, end: date) -> DataFrame:
    return (
        clicks.filter(day_between(start, end))
        .join(targets.select("idhash"), "idhash", "left_semi")
        .select("etimestamp", "idhash", "sid", "query")
    )


def temporal_split(clicks: DataFrame, windows: Windows) -> DataFrame:
    """Rows of both windows with ``split``; rows outside are not part of the experiment."""
    w = windows
    return clicks.filter(day_between(w.train_start, w.test_end)).withColumn(
        "split", F.when(F.col("datestr") <= F.lit(w.train_end), "train").otherwise("test")
    )


def sliding_windows(clicks: DataFrame, start: date, end: date, length: int = 21, step: int = 1) -> DataFrame:
    """Events per user and ``length``-day window; windows start every ``step`` days in [start, end].

    Days are counted first, so a row is replicated per (user, day), not per event.
    """
    days = clicks.groupBy("idhash", "datestr").agg(F.count("*").alias("n"))
    starts = F.sequence(F.lit(start), F.lit(end), F.make_interval(days=F.lit(step)))
    covering = F.filter(
        starts, lambda s: (s <= F.col("datestr")) & (F.col("datestr") <= F.date_add(s, length - 1))
    )
    return (
        days.select("idhash", F.explode(covering).alias("window_start"), "n")
        .groupBy("idhash", "window_start")
        .agg(F.sum("n").alias("n"))
    )
