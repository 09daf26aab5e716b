"""State of the note tree and its forward update.

Two tables, both in long form and keyed by user and path:

* items: ``path, item, axis, polarity, last_seen, support`` - the content of the notes;
* notes: ``path, updated_count, recently_updated``.

The content of a note is its set of (axis, item, polarity).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.functions.text import ordered_concat

#: Columns of the items as they are stored.
ITEM_SCHEMA = "idhash bigint, path string, item string, axis string, polarity bigint, last_seen date, support bigint"
RANKS = {"implicit": 1, "explicit": 2, "user_info": 3}  # on equal dates the higher one wins


def axis_rank(axis: str = "axis") -> Column:
    expr = F.lit(0)
    for name, rank in RANKS.items():
        expr = F.when(F.col(axis) == name, F.lit(rank)).otherwise(expr)
    return expr


def axis_of(rank: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, value in RANKS.items():
        expr = F.when(rank == value, F.lit(name)).otherwise(expr)
    return expr


def collapse_items(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, path, item): later date, then stronger axis wins; support adds up."""
    newest = F.max(F.struct("last_seen", axis_rank().alias("rank"), "polarity")).alias("_newest")
    return (
        items.groupBy(*keys, "path", "item")
        .agg(newest, F.sum("support").alias("support"))
        .select(
            *keys,
            "path",
            "item",
            axis_of(F.col("_newest.rank")).alias("axis"),
            F.col("_newest.polarity").alias("polarity"),
            F.col("_newest.last_seen").alias("last_seen"),
            "support",
        )
    )


def _timeline(routed: DataFrame, items: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, path, item, day, rank, polarity, support, newest, changed): the newest value of every item of a note, and the days that changed it.

    The value of a day is that of its strongest axis. It counts if it is newer than the state's, or of the same day and stronger.
    Windows hold what the batch and the state say about one item of one note: days times axes and source paths at most. All of them
    share one exchange and one sort.
    """
    group = [*keys, "path", "item"]
    rank = axis_rank()
    daily = routed.select(*group, F.col("datestr").alias("day"), rank.alias("rank"), "polarity", "support", F.lit(False).alias("is_state"))
    rows = Window.partitionBy(*group).orderBy("day", "rank", "polarity", "is_state")
    every = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if items is not None:
        # days that have been applied already change no support, so a repeated job changes nothing
        applied = items.groupBy(*keys).agg(F.max("last_seen").alias("_applied"))
        fresh = F.col("_applied").isNull() | (F.col("day") > F.col("_applied"))
        daily = (
            daily.join(applied, keys, "left")
            .withColumn("support", F.when(fresh, F.col("support")).otherwise(F.lit(0)))
            .drop("_applied")
        )
        held = items.select(*group, F.col("last_seen").alias("day"), rank.alias("rank"), "polarity", "support", F.lit(True).alias("is_state"))
        daily = daily.unionByName(held)
    summed = daily.withColumn("support", F.sum("support").over(every))
    if items is not None:
        when = F.struct("day", "rank")
        summed = summed.withColumn("_held", F.max(F.when(F.col("is_state"), when)).over(every))
        summed = summed.filter(F.col("is_state") | F.col("_held").isNull() | (when > F.col("_held"))).drop("_held")
    next_day = F.lead("day").over(rows)
    days = summed.withColumn("_next", next_day).filter(F.col("is_state") | F.col("_next").isNull() | (F.col("_next") > F.col("day")))
    value, before = F.struct("rank", "polarity"), F.lag(F.struct("rank", "polarity")).over(rows)
    return (
        days.withColumn("newest", next_day.isNull())
        .withColumn("changed", ~F.col("is_state") & (before.isNull() | (before != value)))
        .filter(F.col("newest") | F.col("changed"))
        .drop("is_state", "_next")
    )


def apply_batch(
    routed: DataFrame,
    items: DataFrame | None = None,
    notes: DataFrame | None = None,
    keys: Sequence[str] = ("idhash",),
    materialize: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Forward update with all days of ``routed`` at once; returns the new (items, notes).

    Equal to updating day by day: newest information wins, and ``updated_count`` grows by
    one for every day on which the content of a note changed. Support grows only by days after the
    user's newest day in ``items``, so the same batch twice changes nothing. Both results are
    read off one timeline; pass ``materialize`` when both will be written.
    """
    keys = list(keys)
    timeline = materialize(_timeline(routed, items, keys))
    new_items = timeline.filter("newest").select(
        *keys, "path", "item", axis_of(F.col("rank")).alias("axis"), "polarity", F.col("day").alias("last_seen"), "support"
    )
    changes = (
        timeline.filter("changed")
        .select(*keys, "path", "day")
        .distinct()
        .groupBy(*keys, "path")
        .agg(F.count("day").alias("updated_count"), F.max("day").alias("recently_updated"))
    )
    if notes is None:
        return new_items, changes
    new_notes = (
        notes.select(changes.columns)
        .unionByName(changes)
        .groupBy(*keys, "path")
        .agg(F.sum("updated_count").alias("updated_count"), F.max("recently_updated").alias("recently_updated"))
    )
    return new_items, new_notes


def item_versions(routed: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """Validity intervals of the items of all notes, for the day-by-day update of ``routed`` from nothing.

    A row holds from ``valid_from`` until before ``valid_to`` (NULL: until now). The rows valid on a day are the items that
    ``apply_batch`` gives for the days up to it, so any version is read without folding again.
    """
    group = [*keys, "path", "item"]
    daily = routed.groupBy(*group, F.col("datestr").alias("valid_from")).agg(
        F.max(F.struct(axis_rank().alias("rank"), "polarity")).alias("_value"), F.sum("support").alias("support")
    )
    days = Window.partitionBy(*group).orderBy("valid_from")  # one row per day
    return daily.select(
        *group,
        axis_of(F.col("_value.rank")).alias("axis"),
        F.col("_value.polarity").alias("polarity"),
        F.col("valid_from").alias("last_seen"),
        F.sum("support").over(days.rowsBetween(Window.unboundedPreceding, 0)).alias("support"),
        (F.lag("_value").over(days).isNull() | (F.lag("_value").over(days) != F.col("_value"))).alias("changed"),
        "valid_from",
        F.lead("valid_from").over(days).alias("valid_to"),
    )


def note_versions(items: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """Validity intervals of the notes' counters, from the intervals of their items."""
    group = [*keys, "path"]
    days = Window.partitionBy(*group).orderBy("valid_from")  # one row per day on which the note changed
    return items.filter("changed").select(*group, "valid_from").distinct().select(
        *group,
        F.row_number().over(days).cast("bigint").alias("updated_count"),
        F.col("valid_from").alias("recently_updated"),
        "valid_from",
        F.lead("valid_from").over(days).alias("valid_to"),
    )


def versions_on(versions: DataFrame, run_dates: Sequence[date]) -> DataFrame:
    """The rows of ``versions`` valid on each of ``run_dates``, with ``run_date`` in place of the interval."""
    dates = F.array(*[F.lit(d) for d in run_dates])
    valid = F.filter(dates, lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))
    return versions.withColumn("run_date", F.explode(valid)).drop("valid_from", "valid_to", "changed")


def note_content(items: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """Content of each note as one sorted text; bounded by the distinct items of a note."""
    entry = F.concat_ws(":", "axis", "item", F.col("polarity").cast("string"))
    return items.withColumn("_entry", entry).groupBy(*keys, "path").agg(ordered_concat(["_entry"], "_entry", ", ").alias("content"))


def with_content(notes: DataFrame, items: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    return notes.join(note_content(items, keys), [*keys, "path"], "left").withColumn(
        "content", F.coalesce("content", F.lit(""))
    )


def _item_changes(items: DataFrame, routed: DataFrame) -> DataFrame:
    """(idhash, path, item, old, new, op): values held and values of the batch's newest day, and what that does."""
    batch = collapse_items(routed.withColumn("last_seen", F.col("datestr")), ["idhash"])
    columns = ["idhash", "path", "item", "axis", "polarity", "last_seen", "support"]
    sides = items.select(*columns, F.lit("old").alias("side")).unionByName(batch.select(*columns, F.lit("new").alias("side")))
    value = F.struct("axis", "polarity", "last_seen", axis_rank().alias("rank"), "support")
    both = sides.groupBy("idhash", "path", "item").agg(
        F.max(F.when(F.col("side") == "old", value)).alias("old"), F.max(F.when(F.col("side") == "new", value)).alias("new")
    )
    same = (F.col("old.axis") == F.col("new.axis")) & (F.col("old.polarity") == F.col("new.polarity"))
    op = (
        F.when(F.col("old").isNull(), "ADD")
        .when(F.col("new").isNull() | same, "NO_CHANGE")
        .when((F.col("old.polarity") > 0) & (F.col("new.polarity") < 0), "DELETE")
        .otherwise("UPDATE")
    )
    return both.withColumn("op", op)


def memory_ops(items: DataFrame, routed: DataFrame) -> DataFrame:
    """What a batch does to every known or new item of a user's notes.

    ADD: only new; DELETE: the batch contradicts a liked item; UPDATE: other axis or
    polarity; NO_CHANGE: the rest. The batch value is that of its newest day.
    """
    return _item_changes(items, routed).select("idhash", "path", "item", "op")


def apply_ops(items: DataFrame, routed: DataFrame) -> DataFrame:
    """The items after the operations of ``memory_ops``; equal to those of ``apply_batch``.

    ADD puts an item in, UPDATE and DELETE replace what is held (a DELETE leaves the dislike that contradicted), NO_CHANGE
    only renews its date and support. Evidence that is older than what is held, or of the same day and no stronger axis, replaces
    nothing. Support grows only by days after the user's newest day in ``items``, so a repeated batch changes nothing.
    """
    group = ["idhash", "path", "item"]
    applied = items.groupBy("idhash").agg(F.max("last_seen").alias("_applied"))
    late = F.col("_applied").isNotNull() & (F.col("datestr") <= F.col("_applied"))
    fresh = routed.join(applied, "idhash", "left").withColumn("support", F.when(late, 0).otherwise(F.col("support")))

    def when_of(side: str) -> Column:
        return F.struct(F.col(f"{side}.last_seen"), F.col(f"{side}.rank"))

    takes = F.col("new").isNotNull() & ((F.col("op") == "ADD") | (when_of("new") > when_of("old")))
    support = F.coalesce("old.support", F.lit(0)) + F.coalesce("new.support", F.lit(0))
    return _item_changes(items, fresh).select(
        *group, *[F.when(takes, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ("axis", "polarity", "last_seen")],
        support.alias("support"),
    )
