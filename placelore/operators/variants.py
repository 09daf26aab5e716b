"""Memory variants (baselines and ablations) run as one job with a ``variant`` column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.operators import context as ctx
from placelore.operators.evaluate import all_metrics, category_baseline
from placelore.operators.memory import MemoryOptions, build_memory
from placelore.operators.routing import axis_filter


@dataclass(frozen=True)
class Variant:
    """``kind`` is how the context is made; flags switch parts of the note memory off."""

    title: str
    kind: str
    dynamic: bool = True
    lift: bool = True
    backward: bool = True
    implicit_only: bool = False
    explicit_only: bool = False
    merge_axes: bool = False
    budget: int = ctx.DEFAULT_BUDGET


# Keys and titles of the presets.
PRESETS = {
    "no_memory": Variant("No-Memory", "no_memory"),
    "full_context": Variant("Full-Context", "full_context"),
    "flat_memory": Variant("Flat-Memory", "flat_memory"),
    "fixed_hierarchy": Variant("Fixed-Hierarchy", "notes", dynamic=False, backward=False),
    "ours": Variant("Ours", "notes"),
    "ablation_dynamic": Variant("-dynamic", "notes", dynamic=False),
    "ablation_elevation": Variant("-elevation", "notes", lift=False),
    "ablation_backward": Variant("-backward", "notes", backward=False),
    "ablation_no_implicit": Variant("w/o implicit", "notes", explicit_only=True),
    "ablation_no_explicit": Variant("w/o explicit", "notes", implicit_only=True),
    "ablation_three_axes": Variant("-3axis", "notes", merge_axes=True),
}


#: How a context is made of (items, daily texts, budget): (idhash, context). Callers add their own kinds.
Constructor = Callable[[DataFrame, DataFrame, int], DataFrame]
CONSTRUCTORS: dict[str, Constructor] = {
    "full_context": lambda items, texts, budget: ctx.full_context(texts, budget),
    "flat_memory": lambda items, texts, budget: ctx.flat_memory(items, budget),
}


def register(name: str, variant: Variant, constructor: Constructor | None = None) -> None:
    """Adds a preset, and the constructor of its kind when that is new."""
    PRESETS[name] = variant
    if constructor is not None:
        CONSTRUCTORS[variant.kind] = constructor


def preset(name: str) -> Variant:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}, known: {sorted(PRESETS)}")
    return PRESETS[name]


def variant_contexts(
    users: DataFrame, items: DataFrame, texts: DataFrame, taxonomy: DataFrame, start: date, end: date,
    names: list[str] | None = None, budget: int | None = None, options: dict | None = None,
) -> DataFrame:
    """(variant, idhash, context) of every user and variant; users without memory get an empty context.

    ``budget`` replaces the presets' own budgets.

    All note variants share one fold: their rows differ in ``variant``, which is part of the key.
    """
    chosen = {name: preset(name) for name in (names or PRESETS)}
    keys = ["variant", "idhash"]
    parts: list[DataFrame] = []
    by_notes = {n: v for n, v in chosen.items() if v.kind == "notes"}
    if by_notes:
        rows = axis_filter(items, [(n, v.implicit_only, v.explicit_only) for n, v in by_notes.items()])
        # two axes: demographics become stated preferences
        two_axes = F.col("variant").isin([n for n, v in by_notes.items() if v.merge_axes]) & (F.col("axis") == "user_info")
        rows = rows.withColumn("axis", F.when(two_axes, "explicit").otherwise(F.col("axis")))

        def has(flag: str):
            return F.col("variant").isin([n for n, v in by_notes.items() if getattr(v, flag)])

        memory = MemoryOptions(dynamic=has("dynamic"), backward=has("backward"), lift=has("lift"), **(options or {}))
        note_items, notes, _ = build_memory(rows, taxonomy, start, end, keys, memory)
        by_budget: dict[int, list[str]] = {}
        for name, variant in by_notes.items():
            by_budget.setdefault(budget or variant.budget, []).append(name)
        for size, members in by_budget.items():
            mine = F.col("variant").isin(members)
            parts.append(ctx.note_context(notes.filter(mine), note_items.filter(mine), size, keys))
    for name, variant in chosen.items():
        made = CONSTRUCTORS.get(variant.kind)
        if made is not None:
            context = made(items, texts, budget or variant.budget)
            parts.append(context.select(F.lit(name).alias("variant"), "idhash", "context"))
        elif variant.kind not in ("notes", "no_memory"):
            raise ValueError(f"no constructor for {variant.kind!r}")
    everyone = users.select(F.explode(F.array(*[F.lit(n) for n in chosen])).alias("variant"), "idhash")
    if not parts:
        return everyone.withColumn("context", F.lit(""))
    made = parts[0].select(*keys, "context")
    for part in parts[1:]:
        made = made.unionByName(part)
    return everyone.join(made, keys, "left").fillna("", ["context"])


def run_variants(
    users: DataFrame, items: DataFrame, texts: DataFrame, taxonomy: DataFrame, truth: DataFrame,
    start: date, end: date, labels: list[str], label_pattern: str, **settings,
) -> DataFrame:
    """Metric rows of all variants with the deterministic predictor."""
    contexts = variant_contexts(users, items, texts, taxonomy, start, end, **settings)
    predictions = category_baseline(contexts, labels, label_pattern, ["variant", "idhash"])
    return all_metrics(predictions, truth)
