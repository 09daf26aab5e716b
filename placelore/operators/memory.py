"""Fold of daily preference items into the note tree."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage
from placelore.operators.fold import ITEM, LOG, NOTE, fold_days
from placelore.operators.notes import apply_batch, axis_of, axis_rank
from placelore.operators.profile import ROOT
from placelore.operators.routing import fixed_path, route_over_time, with_paths_apart


@dataclass(frozen=True)
class MemoryOptions:
    """Switches of the fold. A Column switches per row, which lets one job build many variants.

    Experiments consolidate after every day (``backward_every=1``); production runs consolidate weekly (7).
    """

    backward_every: int = 1
    dynamic: Column = field(default_factory=lambda: F.lit(True))
    backward: Column = field(default_factory=lambda: F.lit(True))
    lift: Column = field(default_factory=lambda: F.lit(True))
    tau: float = 0.5
    min_updates: int = 2
    max_age: int = 120


def memory_closed_form(
    items: DataFrame,
    taxonomy: DataFrame,
    keys: Sequence[str] = ("idhash",),
    base_only: bool = False,
    materialize: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Forward update of the whole history in one step, every day routed on the notes of the days before: (items, notes).

    Equal to the daily fold without backward passes, also where an unlisted path becomes known in the course of the
    history or its items go to a sibling for a while.
    """
    routed = route_over_time(items, taxonomy, _no_notes(items, keys), keys, with_route=False)
    if base_only:  # routing gives normalized paths
        routed = routed.join(taxonomy.select("path"), "path", "left_semi")
    return apply_batch(routed, keys=keys, materialize=materialize)


def memory_paths(items: DataFrame, taxonomy: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """(keys, path) of the notes of ``memory_closed_form``: a note is there as soon as an item was routed to it.

    The days on which items changed and their support are not needed for that.
    """
    seen = items.select(*keys, "axis", "item", "path", "datestr")
    return route_over_time(seen, taxonomy, _no_notes(items, keys), keys, with_route=False).select(*keys, "path").distinct()


def _no_notes(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.select(*keys, "path", "item").limit(0)


def build_memory(
    items: DataFrame,
    taxonomy: DataFrame,
    start: date,
    end: date,
    keys: Sequence[str] = ("idhash",),
    options: MemoryOptions | None = None,
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Folds the days of [start, end] into (items, notes, merge logs).

    Every day is routed on the notes of the days before and updates them; after every ``backward_every`` days (1 = after every day)
    users with new items are consolidated, and not in the period they first appear. The result is that of ``route_over_time``,
    ``base_path_filter``, ``apply_batch`` and ``backward_pass`` period by period, but the rows are shuffled and the state is written once,
    not once per period: a user's days stream past the user's notes (``fold_days``).
    """
    options = options or MemoryOptions()
    keys = list(keys)
    has_root = F.lit(not taxonomy.filter(F.col("path") == ROOT).isEmpty())
    at_root = F.col("axis") == "user_info"
    days = items.filter(F.col("datestr").between(F.lit(start), F.lit(end))).withColumns(
        {"dynamic": options.dynamic.cast("boolean"), "backward": options.backward.cast("boolean"), "lift": options.lift.cast("boolean")}
    )
    rows = with_paths_apart(days, taxonomy).withColumns(
        {
            "day": F.unix_date("datestr"), "rank": axis_rank(), "polarity": F.col("polarity").cast("bigint"), "support": F.col("support").cast("bigint"),
            "wanted": F.col("_wanted"), "fixed": F.when(at_root, F.lit(ROOT)).otherwise(fixed_path()), "asks": F.col("_asks"),
        }
    ).withColumn("in_base", F.when(F.col("fixed") == ROOT, has_root).otherwise(F.lit(True)))
    folded = cut_lineage(
        fold_days(
            rows, keys, _number(start), _number(end), options.backward_every, tau=options.tau, min_updates=options.min_updates, max_age=options.max_age
        )
    )
    day = F.date_from_unix_date("day")
    new_items = folded.filter(F.col("kind") == ITEM).select(
        *keys, "path", "item", axis_of(F.col("rank")).alias("axis"), "polarity", day.alias("last_seen"), F.col("number").alias("support")
    )
    new_notes = folded.filter(F.col("kind") == NOTE).select(*keys, "path", F.col("number").alias("updated_count"), day.alias("recently_updated"))
    moves = folded.filter(F.col("kind") == LOG).select(*keys, "path", "target", F.col("move").alias("kind"), day.alias("run_date"))
    ends = [min(first + options.backward_every - 1, _number(end)) for first in range(_number(start), _number(end) + 1, options.backward_every)]
    runs = [date(1970, 1, 1) + timedelta(days=n) for n in ends[1:]]
    return new_items, new_notes, [moves.filter(F.col("run_date") == F.lit(run)) for run in runs]


def _number(day: date) -> int:
    return (day - date(1970, 1, 1)).days
