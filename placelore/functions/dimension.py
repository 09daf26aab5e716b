"""One row per key of a dimension, resolved the same way everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.functions.skew import top_per_key


def one_row_per_key(dimension: DataFrame, key: str) -> DataFrame:
    """First row per key in the order of all other columns, so that joins do not multiply log rows."""
    others = [F.col(c).asc_nulls_last() for c in sorted(dimension.columns) if c != key]
    return top_per_key(dimension, [key], others, 1)


def places_of(poi: DataFrame, key: str = "sid") -> DataFrame:
    """The POI base with one row per place. Resolved over all its columns, so every reader sees the same row."""
    return one_row_per_key(poi, key)
