"""Micro-sessions of one place in event time, from a click stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.operators.sessions import GAP_MINUTES


def place_sessions(clicks: DataFrame, gap_minutes: int = GAP_MINUTES, late_minutes: int = 60) -> DataFrame:
    """The rows of ``operators.sessions.place_sessions``, each emitted once its session is closed.

    The watermark follows the greatest event time seen in earlier micro-batches by ``late_minutes``. A click behind it is late and
    belongs to no session; every other click counts, in whatever order they come. A session is closed, and written in append
    mode, once the watermark has passed its last click by the gap. A click delivered again before its time falls behind the
    watermark counts once. Clicks without user, place, number or time belong to no session.

    State holds the open sessions of a (user, place) and the numbers of recent clicks; both are bounded by gap and lateness. With
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set, clicks of a hot key are merged before they are
    shuffled.
    """
    known = clicks.select("idhash", "sid", "event_id", F.col("etimestamp").cast("timestamp").alias("at")).na.drop()
    once = known.withWatermark("at", f"{late_minutes} minutes").dropDuplicatesWithinWatermark(["event_id"])
    window = F.session_window("at", f"{gap_minutes} minutes")  # a click exactly one gap later still belongs to it
    return once.groupBy("idhash", "sid", window).agg(
        F.min("at").cast("timestamp_ntz").alias("start_ts"),
        F.max("at").cast("timestamp_ntz").alias("end_ts"),
        F.count("*").alias("n_clicks"),
    ).drop("session_window")
