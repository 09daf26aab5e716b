"""Change detection by a per-user hash, and restart of interrupted runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = 4


def user_hash(clicks: DataFrame) -> DataFrame:
    """SHA-256 fingerprint of each user's multiset of (timestamp, POI) tuples.

    Every tuple is hashed on its own; 32-bit words of the digests are summed per user and
    the sums (decimals of 30 digits, which no log overflows) are hashed again. Sums combine on the map side and do not depend on the order,
    so no user's log is ever gathered or sorted. Repeated tuples count.
    """
    micros = F.unix_micros(F.col("etimestamp").cast("timestamp")).cast("string")
    missing = F.lit("~")  # no number, so a missing part is not a shorter tuple
    digest = F.sha2(F.concat(F.coalesce(micros, missing), F.lit("|"), F.coalesce(F.col("sid").cast("string"), missing)), 256)
    rows = clicks.select("idhash", digest.alias("_digest"))
    words = [
        F.sum(F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_w{i}") for i in range(_WORDS)
    ]
    sums = rows.groupBy("idhash").agg(F.count("*").cast("string").alias("_n"), *words)
    return sums.select(
        "idhash", F.sha2(F.concat_ws(",", "_n", *[f"_w{i}" for i in range(_WORDS)]), 256).alias("sha256")
    )


def change_status(today: DataFrame, before: DataFrame) -> DataFrame:
    """``new`` / ``gone`` / ``changed`` / ``unchanged`` per user from two hash tables with one row per user."""
    both = today.select("idhash", F.col("sha256").alias("_now")).join(
        before.select("idhash", F.col("sha256").alias("_then")), "idhash", "full_outer"
    )
    return both.select(
        "idhash",
        F.when(F.col("_then").isNull(), "new")
        .when(F.col("_now").isNull(), "gone")
        .when(F.col("_now") == F.col("_then"), "unchanged")
        .otherwise("changed")
        .alias("status"),
    )


def users_to_process(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin("new", "changed")).select("idhash")


def continue_run(done: DataFrame, users: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Finished rows and the new rows of the users that had none; only the latter are evaluated.

    ``done`` and what ``evaluate`` returns have a ``user_id`` column; the result has the columns of ``done``.
    """
    fresh = evaluate(resume_pending(users, done))
    return done.unionByName(fresh.select(*done.columns))


def resume_pending(users: DataFrame, done: DataFrame) -> DataFrame:
    """Users without a finished result."""
    return users.select("user_id").distinct().join(done.select("user_id"), "user_id", "left_anti")
