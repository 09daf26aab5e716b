"""Micro-sessions: consecutive interactions with the same query or the same place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage, previous_row, running_sum
from placelore.functions.text import has_text
from placelore.operators.enrich import day_name

GAP_MINUTES = 60

def sessions(
    clicks: DataFrame,
    places: DataFrame,
    gap_minutes: int = GAP_MINUTES,
    place: str = "sid",
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Sessions over the click log; ``places`` has the graded POI attributes, one row per POI.

    A row opens a session if it is the user's first, if more than ``gap_minutes`` passed
    since the user's previous row, or if neither its query nor its place equals the
    previous one (blank queries never match). Attributes are those of the first row.

    Users are cut into hours, so one user's log is spread over many tasks. Sessions are
    found on narrow rows, which are materialized once because numbering reads them twice;
    place attributes are joined to the finished sessions.
    """
    hour = [(F.date_trunc("hour", "etimestamp"), False)]
    order = ["etimestamp", "event_id"]
    rows = clicks.select("idhash", "event_id", "etimestamp", "query", "sid")
    if place == "sid":
        rows = rows.withColumn("_place", F.col("sid"))
    else:
        rows = rows.join(places.select("sid", F.col(place).alias("_place")), "sid", "left")
    linked = previous_row(rows, ["idhash"], order, hour, ["etimestamp", "query", "_place"], "_prev")
    gap = F.unix_micros(F.col("etimestamp").cast("timestamp")) - F.unix_micros(F.col("_prev.etimestamp").cast("timestamp"))
    same_query = has_text("query") & (F.col("query") == F.col("_prev.query"))
    same_place = F.col("_place") == F.col("_prev._place")
    continues = (
        F.col("_prev").isNotNull()
        & (gap <= gap_minutes * 60 * 1_000_000)
        & (F.coalesce(same_query, F.lit(False)) | F.coalesce(same_place, F.lit(False)))
    )
    flagged = materialize(
        linked.select("idhash", "event_id", "etimestamp", "query", "sid", F.when(continues, 0).otherwise(1).alias("opens"))
    )
    numbered = running_sum(flagged, ["idhash"], [F.col(c) for c in order], hour, F.col("opens"), "session_id")
    found = numbered.groupBy("idhash", "session_id").agg(
        F.min("etimestamp").alias("start_ts"),
        F.max("etimestamp").alias("end_ts"),
        F.count("*").alias("n_clicks"),
        F.min_by(F.struct("query", "sid"), F.struct(*order)).alias("_first"),
    )
    attributes = places.select("sid", "title", "top_category", "region", "review_top_display")
    return (
        found.select("*", "_first.query", "_first.sid")
        .join(attributes, "sid", "left")
        .select(
            "idhash", "session_id", "start_ts", "end_ts", "n_clicks", day_name("start_ts").alias("day_name"),
            "query", "title", "top_category", "region", "review_top_display",
        )
    )


def place_sessions(
    clicks: DataFrame, gap_minutes: int = GAP_MINUTES, materialize: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """(idhash, sid, start_ts, end_ts, n_clicks): visits of a user to one place, whatever lies between them.

    A click opens a visit when more than ``gap_minutes`` passed since the user's previous click on the place. Clicks without user,
    place, number or time belong to none. ``streaming.sessions.place_sessions`` gives the same rows from a stream. A hot
    (user, place) is cut into hours.
    """
    hour = [(F.date_trunc("hour", "etimestamp"), False)]
    keys, order = ["idhash", "sid"], ["etimestamp", "event_id"]
    rows = clicks.select(*keys, *order).na.drop()
    linked = previous_row(rows, keys, order, hour, ["etimestamp"], "_prev")
    gap = F.unix_micros(F.col("etimestamp").cast("timestamp")) - F.unix_micros(F.col("_prev.etimestamp").cast("timestamp"))
    opens = F.when(gap <= gap_minutes * 60 * 1_000_000, 0).otherwise(1)
    flagged = materialize(linked.select(*keys, *order, opens.alias("opens")))
    numbered = running_sum(flagged, keys, [F.col(c) for c in order], hour, F.col("opens"), "_visit")
    return (
        numbered.groupBy(*keys, "_visit")
        .agg(F.min("etimestamp").alias("start_ts"), F.max("etimestamp").alias("end_ts"), F.count("*").alias("n_clicks"))
        .drop("_visit")
    )
