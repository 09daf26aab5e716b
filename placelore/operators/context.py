"""Token-budgeted contexts read out of notes, flat facts or raw daily texts.

Windows here hold the notes, facts or days of one user, which the tree, the fact limit
and the time window bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.functions.skew import top_per_key
from placelore.functions.text import SEP, ordered_concat, path_level, token_count, token_prefix

# Line labels of a formatted note.
SUMMARY_LABEL, USER_INFO_LABEL, KEYWORDS_LABEL = "요약", "사용자 정보", "키워드"
DEFAULT_BUDGET = 8192
MAX_FACTS = 30


def dfs_order(notes: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """Depth-first position, children in alphabetical order: the order of the path arrays."""
    w = Window.partitionBy(*keys).orderBy(F.split("path", SEP))
    return notes.withColumn("dfs", F.row_number().over(w).cast("bigint"))


def format_notes(notes: DataFrame, items: DataFrame, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """``text`` of every note: path, summary of likes and dislikes, demographics, keywords."""
    keys = list(keys)

    def names(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(condition, F.col("item")))), ", ")

    preference = F.col("axis") != "user_info"
    content = items.groupBy(*keys, "path").agg(
        names(preference & (F.col("polarity") > 0)).alias("likes"),
        names(preference & (F.col("polarity") < 0)).alias("dislikes"),
        names(~preference).alias("user_info"),
        names(preference).alias("keywords"),
    )
    summary = F.concat_ws(
        "; ",
        F.when(F.col("likes") != "", F.concat(F.lit("likes "), "likes")),
        F.when(F.col("dislikes") != "", F.concat(F.lit("dislikes "), "dislikes")),
    )
    text = F.concat(
        F.lit("["), "path", F.lit(f"]\n{SUMMARY_LABEL}: "), summary,
        F.lit(f"\n{USER_INFO_LABEL}: "), "user_info",
        F.lit(f"\n{KEYWORDS_LABEL}: "), "keywords", F.lit("\n"),
    )
    return (
        notes.select(*keys, "path")
        .join(content, [*keys, "path"], "left")
        .fillna("", ["likes", "dislikes", "user_info", "keywords"])
        .select(*keys, "path", text.alias("text"))
    )


def budget_truncate(formatted: DataFrame, budget: int = DEFAULT_BUDGET, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """Drops notes deepest first, then last in depth-first order, until the rest fits.

    A note goes iff the notes left before its turn exceed the budget; the root level stays.
    """
    keys = list(keys)
    rows = dfs_order(formatted, keys).withColumns(
        {"depth": path_level("path").cast("bigint"), "tokens": token_count("text")}
    )
    user = Window.partitionBy(*keys)
    turn = user.orderBy(F.desc("depth"), F.desc("dfs")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("tokens").over(user) - F.coalesce(F.sum("tokens").over(turn), F.lit(0))
    return rows.withColumn("_left", left).filter((F.col("depth") == 1) | (F.col("_left") <= budget)).drop("_left")


def note_context(
    notes: DataFrame, items: DataFrame, budget: int = DEFAULT_BUDGET, keys: Sequence[str] = ("idhash",)
) -> DataFrame:
    kept = budget_truncate(format_notes(notes, items, keys), budget, keys)
    return kept.groupBy(*keys).agg(ordered_concat(["dfs"], "text", "\n").alias("context"))


def flat_top_facts(items: DataFrame, keys: Sequence[str] = ("idhash",), limit: int = MAX_FACTS) -> DataFrame:
    """At most ``limit`` facts (path as key, item as value) by support."""
    facts = items.groupBy(*keys, F.col("path").alias("fact"), F.col("item").alias("value")).agg(
        F.sum("support").alias("support")
    )
    return top_per_key(facts, list(keys), [F.desc("support"), F.col("fact"), F.col("value")], limit, "rank").withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def flat_memory(
    items: DataFrame, budget: int = DEFAULT_BUDGET, keys: Sequence[str] = ("idhash",), limit: int = MAX_FACTS
) -> DataFrame:
    """``- key: value`` lines cut to the first ``budget`` tokens."""
    line = F.concat(F.lit("- "), "fact", F.lit(": "), "value")
    return (
        flat_top_facts(items, keys, limit)
        .withColumn("line", line)
        .groupBy(*keys)
        .agg(ordered_concat(["rank"], "line", "\n").alias("text"))
        .select(*keys, token_prefix("text", budget).alias("context"))
    )


def full_context(texts: DataFrame, budget: int = DEFAULT_BUDGET, keys: Sequence[str] = ("idhash",)) -> DataFrame:
    """All daily texts in date order, cut to the first ``budget`` tokens.

    Days beyond the budget are dropped before anything is joined together, so a user's
    gathered text never exceeds the budget by more than the day it ends in.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("datestr").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        texts.withColumn("_tokens", token_count("text"))
        .withColumn("_left", budget - F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
        .filter(F.col("_left") > 0)
        .withColumn("_text", token_prefix("text", F.col("_left")))
    )
    return days.groupBy(*keys).agg(ordered_concat(["datestr"], "_text", "\n").alias("context"))
