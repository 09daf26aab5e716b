"""Backward consolidation: merge overlapping siblings, lift common traits, prune stale leaves.

Works on the (items, notes) tables of ``notes``. Groups are the children of one node of
one user's tree; their number is bounded by the categories below that node, not by the log. The tables grow
with the users, so their joins are hinted to merge: none is broadcast through the driver while it happens to be small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage
from placelore.functions.text import path_level, path_parent
from placelore.operators.notes import collapse_items

State = tuple[DataFrame, DataFrame]


def _leaf_elements(items: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parent, path, updated_count, element) of the non-root leaves' contents."""
    parents = notes.select(*keys, path_parent("path").alias("path")).filter(F.col("path").isNotNull()).distinct()
    leaves = notes.filter(path_level("path") > 1).join(parents.hint("merge"), [*keys, "path"], "left_anti")
    content = items.select(*keys, "path", F.concat_ws("|", "item", F.col("polarity").cast("string")).alias("element"))
    return (
        content.join(leaves.select(*keys, "path", "updated_count").hint("merge"), [*keys, "path"])
        .withColumn("parent", path_parent("path"))
    )


def _sibling_pairs(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Jaccard of sibling pairs that share an element; pairs start from the shared elements."""
    group = [*keys, "parent"]
    sized = elements.withColumn("n", F.count("*").over(Window.partitionBy(*group, "path")))
    left = sized.select(*group, "element", F.col("path").alias("path_a"), F.col("n").alias("n_a"))
    right = sized.select(*group, "element", F.col("path").alias("path_b"), F.col("n").alias("n_b"))
    return (
        left.join(right.hint("merge"), [*group, "element"])
        .filter(F.col("path_a") < F.col("path_b"))
        .groupBy(*group, "path_a", "path_b", "n_a", "n_b")
        .agg(F.count("*").alias("shared"))
        .select(*group, "path_a", "path_b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))
    )


def _connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Component label (smallest path) of every linked sibling.

    The links below one parent node are few (its children are categories), so they are
    folded into labels inside one row.
    """
    group = [*keys, "parent"]
    links = edges.groupBy(*group).agg(F.collect_set(F.struct("path_a", "path_b")).alias("links"))
    ends = F.array_distinct(
        F.concat(F.transform("links", lambda e: e["path_a"]), F.transform("links", lambda e: e["path_b"]))
    )
    alone = F.transform(ends, lambda p: F.struct(p.alias("path"), p.alias("component")))

    def join(nodes: Column, link: Column) -> Column:
        def label(end: str) -> Column:
            return F.get(F.filter(nodes, lambda n: n["path"] == link[end]), F.lit(0))["component"]

        a, b = label("path_a"), label("path_b")
        return F.transform(
            nodes,
            lambda n: F.struct(
                n["path"].alias("path"),
                F.when(n["component"].isin(a, b), F.least(a, b)).otherwise(n["component"]).alias("component"),
            ),
        )

    return links.select(*group, F.inline(F.aggregate("links", alone, join)))


def _one_per_content(elements: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Splits off siblings with identical content: (elements of one representative each, links to it).

    Copies are linked to their representative and need not be paired with each other.
    """
    group = [*keys, "parent"]
    contents = elements.groupBy(*group, "path").agg(F.sort_array(F.collect_set("element")).alias("content"))
    represented = contents.withColumn("first", F.min("path").over(Window.partitionBy(*group, "content"))).drop("content")
    copies = represented.filter(F.col("path") != F.col("first")).select(
        *group, F.col("first").alias("path_a"), F.col("path").alias("path_b")
    )
    firsts = represented.filter(F.col("path") == F.col("first")).select(*group, "path")
    return elements.join(firsts.hint("merge"), [*group, "path"], "left_semi"), copies


def merge_siblings(
    items: DataFrame,
    notes: DataFrame,
    keys: Sequence[str] = ("idhash",),
    tau: float = 0.5,
    partial: float = 0.25,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges overlapping leaf siblings; returns (items, notes, log).

    Leaves with Jaccard >= ``tau`` are linked; each connected set becomes its member with
    the highest ``updated_count`` (then smallest path), counts add up, the latest date
    stays. Afterwards, pairs with ``partial`` <= Jaccard < ``tau`` move only their shared
    items to the stronger leaf; the weaker one keeps the rest and its counters.

    ``materialize`` (a checkpoint by default) runs on the intermediate tables that are read
    several times.
    """
    keys = list(keys)
    group = [*keys, "parent"]
    elements = materialize(_leaf_elements(items, notes, keys))
    distinct_contents, copies = _one_per_content(elements, keys)
    links = _sibling_pairs(distinct_contents, keys).filter(F.col("jaccard") >= tau).select(*group, "path_a", "path_b")
    members = _connected(links.unionByName(copies), keys)
    strength = elements.select(*keys, "path", "updated_count").distinct()
    ranked = members.join(strength.hint("merge"), [*keys, "path"])
    best = F.min(F.struct((-F.col("updated_count")).alias("weakness"), F.col("path").alias("target")))
    moves = materialize(
        ranked.withColumn("_best", best.over(Window.partitionBy(*group, "component")))
        .select(*keys, "path", F.col("_best.target").alias("target"))
        .filter(F.col("path") != F.col("target"))
    )
    target = F.coalesce("target", "path")
    merged_items = materialize(
        collapse_items(items.join(moves.hint("merge"), [*keys, "path"], "left").withColumn("path", target).drop("target"), keys)
    )
    merged_notes = materialize(
        notes.join(moves.hint("merge"), [*keys, "path"], "left")
        .withColumn("path", target)
        .groupBy(*keys, "path")
        .agg(F.sum("updated_count").alias("updated_count"), F.max("recently_updated").alias("recently_updated"))
    )
    final_items, partial_moves = _merge_partially(merged_items, merged_notes, keys, tau, partial, materialize)
    log = moves.withColumn("kind", F.lit("full")).unionByName(
        partial_moves.select(*keys, "path", "target").distinct().withColumn("kind", F.lit("partial"))
    )
    return final_items, merged_notes, log


def _merge_partially(
    items: DataFrame, notes: DataFrame, keys: list[str], tau: float, partial: float, materialize
) -> tuple[DataFrame, DataFrame]:
    group = [*keys, "parent"]
    elements = materialize(_leaf_elements(items, notes, keys))
    pairs = _sibling_pairs(elements, keys).filter((F.col("jaccard") >= partial) & (F.col("jaccard") < tau))
    both_ways = pairs.select(*group, "path_a", "path_b").unionByName(
        pairs.select(*group, F.col("path_b").alias("path_a"), F.col("path_a").alias("path_b"))
    )
    weak = elements.select(*group, "element", F.col("path").alias("path_a"), F.col("updated_count").alias("count_a"))
    strong = elements.select(*group, "element", F.col("path").alias("path_b"), F.col("updated_count").alias("count_b"))
    stronger = (F.col("count_b") > F.col("count_a")) | (
        (F.col("count_b") == F.col("count_a")) & (F.col("path_b") < F.col("path_a"))
    )
    best = F.min(F.struct((-F.col("count_b")).alias("weakness"), F.col("path_b").alias("target")))
    moves = materialize(
        both_ways.join(weak.hint("merge"), [*group, "path_a"])
        .join(strong.hint("merge"), [*group, "path_b", "element"])
        .filter(stronger)
        .groupBy(*keys, F.col("path_a").alias("path"), "element")
        .agg(best.alias("_best"))
        .select(*keys, "path", "element", F.col("_best.target").alias("target"))
    )
    element = F.concat_ws("|", "item", F.col("polarity").cast("string"))
    moved = (
        items.withColumn("element", element)
        .join(moves.hint("merge"), [*keys, "path", "element"], "left")
        .withColumn("path", F.coalesce("target", "path"))
        .drop("element", "target")
    )
    return collapse_items(moved, keys), moves


def lift_common_traits(items: DataFrame, notes: DataFrame, keys: Sequence[str] = ("idhash",)) -> State:
    """Items held by two or more children of a node move to it and leave the children.

    Third to second level first, then second to first on the result. Counters and dates
    stay; emptied children stay until pruned; a parent that gets items but has no note is created.
    """
    keys = list(keys)
    for level in (3, 2):
        siblings = Window.partitionBy(*keys, path_parent("path"), "item", "polarity")
        shared = (path_level("path") == level) & (F.count("*").over(siblings) >= 2)
        # a shared item takes the path of its parent, where equal rows become one
        items = collapse_items(
            items.withColumn("_shared", shared)
            .withColumn("path", F.when(F.col("_shared"), path_parent("path")).otherwise(F.col("path")))
            .drop("_shared"),
            keys,
        )
    created = (
        items.groupBy(*keys, "path")
        .agg(F.lit(1).cast("bigint").alias("updated_count"), F.max("last_seen").alias("recently_updated"))
        .join(notes.select(*keys, "path").hint("merge"), [*keys, "path"], "left_anti")
    )
    return items, notes.select(created.columns).unionByName(created)


def compression_gain(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """Stored items and characters per user before and after consolidation."""
    size = [F.count("*"), F.sum(F.length("item")).cast("bigint")]
    b = before.groupBy(*keys).agg(size[0].alias("items_before"), size[1].alias("chars_before"))
    a = after.groupBy(*keys).agg(size[0].alias("items_after"), size[1].alias("chars_after"))
    return b.join(a, list(keys), "left").fillna(0, ["items_after", "chars_after"]).withColumn(
        "saved", F.col("items_before") - F.col("items_after")
    )


def prune_stale(
    items: DataFrame,
    notes: DataFrame,
    as_of: date | Column,
    keys: Sequence[str] = ("idhash",),
    min_updates: int = 2,
    max_age: int = 120,
) -> State:
    """Removes leaves with at most ``min_updates`` updates that are older than ``max_age`` days.

    Third level first; a second-level node that lost all children is a leaf in the same
    run. The root stays.
    """
    keys = list(keys)
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    stale = (F.col("updated_count") <= min_updates) & (F.date_diff(today, F.col("recently_updated")) > max_age)
    kept = notes.filter(~((path_level("path") == 3) & stale))
    parents = (
        kept.filter(path_level("path") == 3)
        .select(*keys, path_parent("path").alias("path"), F.lit(True).alias("_has_child"))
        .distinct()
    )
    kept = (
        kept.join(parents.hint("merge"), [*keys, "path"], "left")
        .filter(~((path_level("path") == 2) & F.col("_has_child").isNull() & stale))
        .drop("_has_child")
    )
    return items.join(kept.select(*keys, "path").hint("merge"), [*keys, "path"], "left_semi"), kept


def backward_pass(
    items: DataFrame,
    notes: DataFrame,
    as_of: date,
    keys: Sequence[str] = ("idhash",),
    lift_where: Column | None = None,
    tau: float = 0.5,
    min_updates: int = 2,
    max_age: int = 120,
    materialize: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge, lift, prune, in this order; returns (items, notes, merge log).

    ``lift_where`` restricts lifting to some rows (variants); ``materialize`` is applied
    between the steps, because every step reads its input several times.
    """
    items, notes, log = merge_siblings(items, notes, keys, tau, materialize=materialize)
    if lift_where is None:
        items, notes = lift_common_traits(items, notes, keys)
    else:
        lifted_items, lifted_notes = lift_common_traits(items.filter(lift_where), notes.filter(lift_where), keys)
        items = items.filter(~lift_where).unionByName(lifted_items)
        notes = notes.filter(~lift_where).unionByName(lifted_notes)
    items = materialize(items)
    _, notes = prune_stale(items, notes, as_of, keys, min_updates, max_age)
    notes = materialize(notes)
    return items.join(notes.select(*keys, "path").hint("merge"), [*keys, "path"], "left_semi"), notes, log
