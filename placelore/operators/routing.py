"""Mapping of preference items to tree paths, and structural checks of paths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from placelore.functions.skew import cut_lineage, top_per_key
from placelore.functions.text import normalize_path, path_level, path_parent, path_prefix
from placelore.operators.profile import AXES, ROOT

MAX_LEVEL = 3


def _with_wanted(items: DataFrame) -> DataFrame:
    """``path`` replaced by ``_wanted``: the source path cut to the depth of the tree, the root where there is none."""
    path = F.coalesce(path_prefix(normalize_path("path"), MAX_LEVEL), F.lit(ROOT))
    return items.withColumn("_wanted", F.when(F.col("axis") == "user_info", F.lit(ROOT)).otherwise(path)).drop("path")


def route_items(
    items: DataFrame,
    taxonomy: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("idhash",),
    overlap: float = 0.5,
    min_new: int = 2,
) -> DataFrame:
    """Replaces ``path`` by the note path of every item and adds the rule used as ``route``.

    Rules in order: demographics to the root; the user's existing path; the taxonomy path;
    an existing sibling whose items cover at least ``overlap`` of the group; a new third
    level under a known second level for at least ``min_new`` items; the second level; the root. Items
    without a path belong to the root.

    ``existing`` holds (keys, path, item) of the user's notes. All items of a user with
    one source path form a group with one decision, so decisions are taken on the distinct
    (user, path, item) rows, which the size of the tree bounds, and joined back.
    """
    keys = list(keys)
    group = [*keys, "_wanted"]
    at_root = F.col("axis") == "user_info"
    rows = _with_wanted(items)
    wanted = rows.filter(~at_root).select(*group, "item").distinct()
    known = existing.select(*keys, F.col("path").alias("_wanted")).distinct().withColumn("_known", F.lit(True))
    listed = taxonomy.select(F.col("path").alias("_wanted"), F.lit(True).alias("_listed"))
    domains = taxonomy.filter(path_level("path") == 2).select(
        F.col("path").alias("_domain"), F.lit(True).alias("_in_domain")
    )
    groups = (
        wanted.groupBy(*group)
        .agg(F.count("*").alias("_n"))
        .withColumn("_domain", path_prefix("_wanted", 2))
        .join(known, group, "left")
        .join(listed, "_wanted", "left")
        .join(domains, "_domain", "left")
        .withColumn(
            "_open",
            F.col("_known").isNull() & F.col("_listed").isNull() & F.col("_in_domain").isNotNull()
            & (path_level("_wanted") == MAX_LEVEL),
        )
    )
    siblings = existing.filter(path_level("path") == MAX_LEVEL).select(
        *keys, path_prefix("path", 2).alias("_domain"), F.col("path").alias("_sibling"), "item"
    ).distinct()
    covered = (
        wanted.join(groups.filter("_open").select(*group, "_domain", "_n"), group)
        .join(siblings, [*keys, "_domain", "item"])
        .groupBy(*group, "_sibling", "_n")
        .agg(F.count("*").alias("_shared"))
        .filter(F.col("_shared") >= overlap * F.col("_n"))
    )
    best = top_per_key(covered, group, [F.col("_shared").desc(), F.col("_sibling")], 1).select(*group, "_sibling")
    route = (
        F.when(F.col("_known").isNotNull(), "existing")
        .when(F.col("_listed").isNotNull(), "taxonomy")
        .when(F.col("_sibling").isNotNull(), "sibling")
        .when(F.col("_open") & (F.col("_n") >= min_new), "new")
        .when(F.col("_in_domain").isNotNull(), "domain")
        .otherwise("fallback")
    )
    path = (
        F.when(F.col("route") == "sibling", F.col("_sibling"))
        .when(F.col("route") == "domain", F.col("_domain"))
        .when(F.col("route") == "fallback", F.lit(ROOT))
        .otherwise(F.col("_wanted"))
    )
    decisions = groups.join(best, group, "left").withColumn("route", route).select(*group, path.alias("path"), "route")
    return (
        rows.join(decisions, group, "left")
        .withColumn("path", F.when(at_root, F.lit(ROOT)).otherwise(F.col("path")))
        .withColumn("route", F.when(at_root, F.lit("demographics")).otherwise(F.col("route")))
        .drop("_wanted")
    )


def with_paths_apart(items: DataFrame, taxonomy: DataFrame, materialize: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``path`` replaced by ``_wanted``, ``_domain``, ``_listed``, ``_in_domain``, ``_asks`` (its note depends on the day) and ``_holds``."""
    at_root = F.col("axis") == "user_info"
    listed = taxonomy.select(F.col("path").alias("_wanted"), F.lit(True).alias("_listed"))
    domains = taxonomy.filter(path_level("path") == 2).select(F.col("path").alias("_domain"), F.lit(True).alias("_in_domain"))
    # paths are taken apart once per distinct (axis, path), of which the catalogue has few, not once per row and reader
    source = items.select("axis", "path").distinct()
    is_open = _is_open()
    is_note = F.col("_listed").isNotNull() & (path_level("_wanted") == MAX_LEVEL)
    paths = materialize(
        _with_wanted(source.withColumn("_path", F.col("path")))
        .withColumn("_domain", path_prefix("_wanted", 2))
        .join(listed, "_wanted", "left")
        .join(domains, "_domain", "left")
        .withColumn("_asks", F.coalesce(~at_root & is_open, F.lit(False)))
        .withColumn("_holds", F.coalesce(~at_root & is_note, F.lit(False)))
        .withColumnRenamed("axis", "_axis")
    )
    same = F.col("_axis").eqNullSafe(F.col("axis")) & F.col("_path").eqNullSafe(F.col("path"))
    return items.join(paths, same).drop("_axis", "_path", "path")


def _is_open() -> Column:
    return F.col("_listed").isNull() & F.col("_in_domain").isNotNull() & (path_level("_wanted") == MAX_LEVEL)


def fixed_path() -> Column:
    """Path of a row of ``with_paths_apart`` that does not depend on the day."""
    return F.when(F.col("_listed").isNotNull(), F.col("_wanted")).when(F.col("_in_domain").isNotNull(), F.col("_domain")).otherwise(F.lit(ROOT))


def route_over_time(
    items: DataFrame,
    taxonomy: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = ("idhash",),
    overlap: float = 0.5,
    min_new: int = 2,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
    with_route: bool = True,
) -> DataFrame:
    """``route_items`` for the days (``datestr``) of ``items`` one after the other, each on the notes that the days before made.

    Only groups whose path is unlisted below a listed second level depend on the day. They are decided inside their subtree (user, second
    level), which one exchange brings together: by windows where its notes stand still, else by a fold over its days (``_judge_subtrees``,
    ``_fold_subtrees``). Everything else has a fixed path. ``with_route=False`` leaves out the name of the rule.
    """
    keys = list(keys)
    group = [*keys, "_domain", "_wanted", "datestr"]
    at_root = F.col("axis") == "user_info"
    marked = with_paths_apart(items, taxonomy, materialize)
    before = F.lit("0001-01-01").cast("date")  # held before the first day
    held = existing.filter(path_level("path") == MAX_LEVEL).select(
        *keys, path_prefix("path", 2).alias("_domain"), F.col("path").alias("_wanted"), "item", before.alias("datestr"),
        F.lit(False).alias("_asks"), F.lit(True).alias("_holds"), F.lit(True).alias("_state"),
    )
    rows = marked.withColumn("_state", F.lit(False)).unionByName(held, allowMissingColumns=True)
    judged = materialize(_judge_subtrees(rows, [*keys, "_domain"], overlap, min_new))

    fixed = fixed_path()
    events = judged.filter(F.col("_asks") | (F.col("_holds") & F.col("_shared"))).select(
        *keys, "_domain", F.col("_wanted").alias("path"), "item", "datestr", F.col("_asks").alias("asks"), "_moves"
    )
    answers = _fold_subtrees(events, [*keys, "_domain"], overlap, min_new)
    judged = judged.filter(~F.col("_state")).drop("_asks", "_holds", "_shared", "_state")
    moving = judged.filter("_moves").drop("_answer").join(answers, group, "left")
    placed = judged.filter(~F.col("_moves")).unionByName(moving)
    placed = placed.withColumn("path", F.when(at_root, F.lit(ROOT)).otherwise(F.coalesce("_answer", fixed))).drop("_answer", "_moves")
    if not with_route:
        return placed.drop("_wanted", "_domain", "_listed", "_in_domain")
    notes = placed.select(*keys, F.col("path").alias("_wanted"), F.col("datestr").alias("_since")).unionByName(
        existing.select(*keys, F.col("path").alias("_wanted"), F.lit("0001-01-01").cast("date").alias("_since"))
    )
    since = notes.groupBy(*keys, "_wanted").agg(F.min("_since").alias("_since"))
    is_open = _is_open()
    route = (
        F.when(at_root, "demographics")
        .when(F.col("_since") < F.col("datestr"), "existing")
        .when(F.col("_listed").isNotNull(), "taxonomy")
        .when(is_open & (F.col("path") == F.col("_wanted")), "new")
        .when(is_open & (F.col("path") != F.col("_domain")), "sibling")
        .when(F.col("_in_domain").isNotNull(), "domain")
        .otherwise("fallback")
    )
    return (
        placed.join(since, [*keys, "_wanted"], "left")
        .withColumn("route", route)
        .drop("_wanted", "_domain", "_listed", "_in_domain", "_since")
    )


def _judge_subtrees(rows: DataFrame, subtree: list[str], overlap: float, min_new: int) -> DataFrame:
    """``rows`` with ``_moves``, whether the notes of their subtree change with the days, ``_answer`` of those that ask where they do
    not, and ``_shared``, whether an open group has the item.

    A group of one item never makes a note (``min_new``), and an item that it adds to a sibling is there already. So the notes of
    a subtree stand still where no day has a group of two items and nobody asks for a note that is there; its answers are the smallest
    note that held the item on a day before, read off one window. The windows hold the daily items of one subtree and share one exchange.
    """
    by_path = Window.partitionBy(*subtree).orderBy("_wanted", "_day", "_asks", "item")
    by_item = Window.partitionBy(*subtree, "item").orderBy("_day")
    ends = Window.unboundedPreceding, Window.unboundedFollowing
    earlier = F.lag(F.struct("_wanted", "_day", "_asks", "item")).over(by_path)
    second = earlier["_asks"] & (earlier["_day"] == F.col("_day")) & ~earlier["item"].eqNullSafe(F.col("item"))
    moves = F.col("_asks") & (earlier["_wanted"] == F.col("_wanted")) & (~earlier["_asks"] | second)
    if not (min_new > 1 and overlap <= 1):
        moves = F.col("_asks")
    answer = F.min(F.when(F.col("_holds"), F.col("_wanted"))).over(by_item.rangeBetween(Window.unboundedPreceding, -1))
    return (
        rows.repartition(*subtree)
        .withColumn("_day", F.unix_date("datestr"))  # frames need whole numbers
        .withColumn("_moves", F.coalesce(moves, F.lit(False)))
        .withColumn("_moves", F.max("_moves").over(by_path.rowsBetween(*ends)))
        .withColumns({"_answer": answer, "_shared": F.max("_asks").over(by_item.rowsBetween(*ends))})
        .withColumn("_answer", F.when(F.col("_asks") & ~F.col("_moves"), F.col("_answer")))
        .drop("_day")
    )


def _fold_subtrees(
    events: DataFrame, subtree: list[str], overlap: float, min_new: int, materialize: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """(subtree, _wanted, datestr, _answer) of the groups of ``events`` that ask for a path and get another one than the second level.

    Only subtrees whose notes move are folded day by day. ``events`` with ``_moves`` were judged and those that stand still answered
    before; others are judged here (``_judge_subtrees``).

    A partition is read in the order of subtree and day. Only the notes of one subtree and the groups of one day are held, which the
    catalogue bounds; the rows of a subtree stream past, however many days it has.
    """
    keys = [f"_k{i}" for i in range(len(subtree))]
    rows, still = events.withColumnsRenamed(dict(zip(subtree, keys))), None
    if "_moves" not in events.columns:
        asked = rows.withColumn("_holds", ~F.col("asks")).withColumnsRenamed({"path": "_wanted", "asks": "_asks"})
        judged = materialize(_judge_subtrees(asked, keys, overlap, min_new))  # both branches read it
        still = judged.filter(F.col("_answer").isNotNull()).select(*keys, "_wanted", F.unix_date("datestr").alias("datestr"), "_answer")
        rows = judged.withColumnsRenamed({"_wanted": "path", "_asks": "asks"})
    day_number = F.unix_date("datestr").alias("datestr")  # whole numbers are read faster than dates
    rows = rows.filter("_moves").select(*keys, day_number, "path", "item", "asks").repartition(*keys)
    ordered = rows.sortWithinPartitions(*keys, "datestr", "path", "item")
    schema = ordered.select(*keys, F.col("path").alias("_wanted"), "datestr", F.col("path").alias("_answer")).schema
    domain = len(keys) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes: dict[str, set[str]] = {}  # content of the notes before the day
        holders: dict[str, set[str]] = {}  # notes by item
        groups: dict[str, set[str]] = {}  # of the day
        added: list[tuple[str, str]] = []  # to the notes by the day
        current: tuple | None = None
        out: list[tuple] = []

        def close() -> None:
            for wanted, items in groups.items():
                answer = wanted
                if wanted not in notes:
                    held = [holders[item] for item in items if item in holders]
                    shared = Counter(note for found in held for note in found) if held else {}
                    best = min(((-n, note) for note, n in shared.items() if n >= overlap * len(items)), default=None)
                    answer = best[1] if best else wanted if len(items) >= min_new else current[domain]
                if answer != current[domain]:
                    out.append((*current, wanted, day, answer))
                    added.extend((answer, item) for item in items)
            for note, item in added:
                notes.setdefault(note, set()).add(item)
                holders.setdefault(item, set()).add(note)
            groups.clear()
            added.clear()

        day = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, when, path, item, asks in zip(zip(*columns[: len(keys)]), *columns[len(keys) :]):
                if when != day or key != current:
                    if current is not None:
                        close()
                    if key != current:
                        notes.clear()
                        holders.clear()
                    current, day = key, when
                if asks:
                    groups.setdefault(path, set()).add(item)
                else:
                    added.append((path, item))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)
                out.clear()
        if current is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)

    types = to_arrow_schema(schema)
    found = ordered.mapInArrow(run, schema)
    if still is not None:
        found = found.unionByName(still)
    when = F.date_from_unix_date("datestr").alias("datestr")
    return found.select(*[F.col(k).alias(c) for c, k in zip(subtree, keys)], "_wanted", when, "_answer")


def assign_group(routed: DataFrame) -> DataFrame:
    """One assignment per (user, path) with the sorted distinct items of each axis.

    The lists hold distinct items of one note.
    """
    return routed.groupBy("idhash", "path").agg(
        *[
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("axis") == axis, F.col("item")))), ", ").alias(axis)
            for axis in AXES
        ]
    )


def axis_filter(items: DataFrame, configs: list[tuple[str, bool, bool]]) -> DataFrame:
    """Items per variant without the axis its flags switch off.

    ``configs``: (variant, implicit_only, explicit_only). Variants are literals, so rows
    are expanded in place and nothing is joined.
    """
    variants = F.array(
        *[F.struct(F.lit(v).alias("variant"), F.lit(i).alias("_imp"), F.lit(e).alias("_exp")) for v, i, e in configs]
    )
    dropped = (F.col("_imp") & (F.col("axis") == "explicit")) | (F.col("_exp") & (F.col("axis") == "implicit"))
    return items.select("*", F.inline(variants)).filter(~dropped).drop("_imp", "_exp")


def base_path_filter(assignments: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Assignments whose normalized path belongs to the base hierarchy."""
    return (
        assignments.filter(F.col("path").isNotNull())
        .withColumn("path", normalize_path("path"))
        .join(taxonomy.select("path"), "path", "left_semi")
    )


def demo_root_only(assignments: DataFrame) -> DataFrame:
    """Empties ``user_info`` below the root and says where there was something to empty."""
    is_root = path_level("path") == 1
    return assignments.withColumn("violation", ~is_root & (F.coalesce("user_info", F.lit("")) != "")).withColumn(
        "user_info", F.when(is_root, F.col("user_info")).otherwise("")
    )


def path_validate(paths: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Level and violation of every distinct path; an empty violation means valid."""
    domains = taxonomy.filter(path_level("path") == 2).select(
        F.col("path").alias("_domain"), F.lit(True).alias("_known")
    )
    level = path_level("path")
    violation = (
        F.when(path_prefix("path", 1) != ROOT, "unknown_root")
        .when(level > MAX_LEVEL, "too_deep")
        .when((level == MAX_LEVEL) & F.col("_known").isNull(), "unknown_domain")
        .otherwise("")
    )
    return (
        paths.select(normalize_path("path").alias("path"))
        .distinct()
        .withColumn("_domain", path_prefix("path", 2))
        .join(domains, "_domain", "left")
        .select("path", level.cast("bigint").alias("level"), violation.alias("violation"))
    )


def hierarchy_nodes(notes: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """All nodes of a user's tree, implied ancestors included, with parent and sorted child names."""
    keys = list(keys)
    levels = F.sequence(F.lit(1), path_level("path"))
    nodes = notes.select(*keys, F.explode(F.transform(levels, lambda i: path_prefix(F.col("path"), i))).alias("path")).distinct()
    named = nodes.select(
        *keys, path_parent("path").alias("path"), F.element_at(F.split("path", " > "), -1).alias("_child")
    ).filter(F.col("path").isNotNull())
    children = named.groupBy(*keys, "path").agg(F.array_join(F.sort_array(F.collect_list("_child")), ", ").alias("children"))
    return nodes.join(children, [*keys, "path"], "left").select(
        *keys,
        "path",
        path_level("path").cast("bigint").alias("level"),
        path_parent("path").alias("parent"),
        F.coalesce("children", F.lit("")).alias("children"),
    )
