"""Comparison statistics between variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.functions import skew
from placelore.functions.draws import picks
from placelore.operators.evaluate import METRICS

PACK = 4096  # users of a pack
CELLS = 2**23  # differences that a task holds, 64 MB
DRAWS = 2**22  # of the replicates that a task counts at a time
REPLICATE_BLOCKS = 48  # tasks of a bootstrap


def exact_mean(value: Column) -> Column:
    """Mean rounded to 6 digits, from a decimal sum: the same for any order of the rows, ties away from zero."""
    exact = value.cast("decimal(38,15)")
    return F.round(F.sum(exact) / F.count(exact), 6).cast("double")


def unpivot_metrics(results: DataFrame, names: list[str] = METRICS) -> DataFrame:
    return results.unpivot(["variant", "idhash"], names, "metric", "value")


def variant_summary(results: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of every metric per variant."""
    return (
        unpivot_metrics(results)
        .groupBy("variant", "metric")
        .agg(
            F.count("*").alias("n_users"),
            exact_mean(F.col("value")).alias("mean"),
            F.round(F.stddev_samp("value"), 6).alias("std"),
        )
    )


def align_variants(results: DataFrame, baseline: str) -> DataFrame:
    """(variant, metric, user) with the baseline's and the variant's value, for users both have."""
    long = unpivot_metrics(results)
    base = long.filter(F.col("variant") == baseline).select("idhash", "metric", F.col("value").alias("baseline"))
    return long.filter(F.col("variant") != baseline).join(base, ["idhash", "metric"]).select(
        "variant", "metric", "idhash", "baseline", "value"
    )


def _percentile(q: float) -> Column:
    return F.percentile("_mean", F.lit(q))


def _bootstrap_row(confidence: float) -> list[Column]:
    alpha = 1.0 - confidence
    above = F.avg(F.when(F.col("_mean") >= 0, 1.0).otherwise(0.0))
    below = F.avg(F.when(F.col("_mean") <= 0, 1.0).otherwise(0.0))
    return [
        F.round(_percentile(alpha / 2), 6).alias("ci_lower"),
        F.round(_percentile(1 - alpha / 2), 6).alias("ci_upper"),
        F.round(F.least(F.lit(1.0), 2.0 * F.least(above, below)), 6).alias("p_value"),
    ]


def bootstrap_indexed(
    pairs: DataFrame,
    n_bootstrap: int,
    confidence: float = 0.95,
    user_span: int = 1024,
    materialize: Callable[[DataFrame], DataFrame] = skew.cut_lineage,
) -> DataFrame:
    """Paired bootstrap whose draws are a function of their numbers.

    Slot ``i`` of replicate ``b`` takes row ``md5(b|i) mod n``, so any engine gets the same
    result. The draws depend on n, b and i only, so groups of one size share them. Replicates of n users need B x n draws, which are
    never stored: a task counts how often each user is drawn by some replicates and multiplies the counts with the differences of up to
    ``CELLS / groups`` users at a time. Beyond that number of users the draws are made once for each such range.
    ``bootstrap_histogram`` is the form for very many users.
    Rows are numbered per (variant, metric) in id-range buckets, never in one task.
    Replicate means are rounded to 9 digits so that exact zeros count on both sides.
    """
    group = ["variant", "metric"]
    diffs = pairs.select(*group, "idhash", (F.col("baseline") - F.col("value")).alias("diff"))
    numbered = skew.row_number(
        diffs, group, [F.col("idhash")], [(F.floor(F.col("idhash") / user_span), False)], "slot"
    ).withColumn("slot", F.col("slot") - 1)
    sizes = materialize(diffs.groupBy(*group).agg(F.count("*").alias("n"), exact_mean(F.col("diff")).alias("mean_diff")))
    # groups of one size are the columns of a table with a row per slot, cut into packs
    named = F.sort_array(F.collect_list(F.struct(*group)))  # variants x metrics at most
    columns = (
        sizes.groupBy("n")
        .agg(named.alias("_all"))
        .select("n", F.size("_all").alias("width"), F.posexplode("_all").alias("column", "_group"))
        .select("n", "width", "column", "_group.*")
    )
    cells = F.sort_array(F.collect_list(F.struct("slot", "column", "diff")))
    packs = materialize(
        numbered.join(columns, group)
        .groupBy("n", "width", F.floor(F.col("slot") / PACK).alias("pack"))
        .agg(cells.alias("_cells"))
        .select("n", "width", "pack", F.col("_cells.diff").alias("diffs"))
    )
    sums = _replicate_sums(packs, n_bootstrap).groupBy("n", "b", "column").agg(F.sum("sum").alias("_sum"))
    means = sums.join(columns, ["n", "column"]).select(*group, F.round(F.col("_sum") / F.col("n"), 9).alias("_mean"))
    return means.groupBy(*group).agg(*_bootstrap_row(confidence)).join(sizes.drop("n"), group)


def _replicate_sums(packs: DataFrame, n_bootstrap: int) -> DataFrame:
    """(n, b, column, sum) of every replicate over each range of users; the ranges of one n add up."""
    blocks = max(1, min(REPLICATE_BLOCKS, n_bootstrap))
    span = F.greatest(F.lit(1), F.floor(F.lit(CELLS // PACK) / F.col("width")))  # packs of a range
    tiles = (
        packs.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "n", F.floor(F.col("pack") / span).alias("range"), "pack", "width", "diffs"
        )
        .repartitionById(blocks, F.col("block"))
        .sortWithinPartitions("block", "n", "range", "pack")
    )

    def draw(block: int, n: int, first: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        last = (block + 1) * n_bootstrap // blocks
        step = max(1, min(64, DRAWS // n))
        for start in range(block * n_bootstrap // blocks, last, step):
            end = min(start + step, last)
            times = np.empty((end - start, len(values)))
            for i, taken in enumerate(picks(start, end, n)):
                if len(values) < n:
                    taken = taken[(taken >= first) & (taken < first + len(values))] - np.uint32(first)
                times[i] = np.bincount(taken, minlength=len(values))
            sums = times @ values
            width = sums.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(sums.size, n)), pa.array(np.repeat(np.arange(start, end), width)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), end - start)), pa.array(sums.ravel()),
                ],
                ["n", "b", "column", "sum"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts = None, 0, []
        for batch in batches:
            block, n, part, pack, width = (batch.column(c).to_pylist() for c in ("block", "n", "range", "pack", "width"))
            for i in range(batch.num_rows):
                if key != (block[i], n[i], part[i]):
                    if parts:
                        yield from draw(*key[:2], first, np.concatenate(parts))
                    key, first, parts = (block[i], n[i], part[i]), pack[i] * PACK, []
                parts.append(batch.column("diffs")[i].values.to_numpy(zero_copy_only=False).reshape(-1, width[i]))
        if parts:
            yield from draw(*key[:2], first, np.concatenate(parts))

    return tiles.mapInArrow(run, "n bigint, b bigint, column int, sum double")


def bootstrap_histogram(
    pairs: DataFrame, n_bootstrap: int = 10000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """Paired bootstrap over the distinct paired differences.

    Resampling n pairs with replacement draws multinomial counts over the distinct
    differences. Spark reduces the pairs to that histogram; each (variant, metric) then
    draws its counts bin by bin as conditional binomials. A task holds the histogram of one
    (variant, metric), at most one bin per distinct difference, and the replicates.
    """
    group = ["variant", "metric"]
    histogram = (
        pairs.groupBy(*group, F.round(F.col("baseline") - F.col("value"), 9).alias("diff"))
        .agg(F.count("*").alias("n"))
    )

    def draw(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("diff")
        key = table.iloc[0]
        rng = np.random.default_rng([seed, *f"{key['variant']}|{key['metric']}".encode()])
        total = int(table["n"].sum())
        open_draws = np.full(n_bootstrap, total, dtype=np.int64)
        sums = np.zeros(n_bootstrap)
        left = total
        for value, count in zip(table["diff"].to_numpy(), table["n"].to_numpy()):
            taken = open_draws if count == left else rng.binomial(open_draws, count / left)
            sums += taken * value
            open_draws = open_draws - taken
            left -= count
        means = np.round(sums / total, 9)
        mean = float((table["diff"] * table["n"]).sum() / total)
        return pd.DataFrame({"variant": key["variant"], "metric": key["metric"], "_mean": means, "mean_diff": round(mean, 6)})

    drawn = histogram.groupBy(*group).applyInPandas(draw, "variant string, metric string, _mean double, mean_diff double")
    return drawn.groupBy(*group).agg(*_bootstrap_row(confidence), F.max("mean_diff").alias("mean_diff"))


def paired_bootstrap(pairs: DataFrame, n_bootstrap: int = 10000, mode: str = "histogram", **options) -> DataFrame:
    if mode == "indexed":
        return bootstrap_indexed(pairs, n_bootstrap, **options)
    if mode == "histogram":
        return bootstrap_histogram(pairs, n_bootstrap, **options)
    raise ValueError(f"unknown bootstrap mode {mode!r}")


def empty_bootstrap() -> tuple[float, float, float, float]:
    """(mean difference, lower, upper, p) for a comparison without users."""
    return 0.0, 0.0, 0.0, 1.0


def cohens_d(pairs: DataFrame) -> DataFrame:
    """Mean difference over the pooled standard deviation; 0 when that is 0 or undefined."""
    n = F.count("*")
    spread = (n - 1) * F.coalesce(F.var_samp("baseline"), F.lit(0.0)) + (n - 1) * F.coalesce(F.var_samp("value"), F.lit(0.0))
    pooled = F.sqrt(F.when(n > 1, spread / (2 * n - 2)))
    d = F.when(F.round(pooled, 12) > 0, (F.avg("baseline") - F.avg("value")) / pooled).otherwise(0.0)
    return pairs.groupBy("variant", "metric").agg(
        exact_mean(F.col("baseline")).alias("baseline_mean"),
        exact_mean(F.col("value")).alias("variant_mean"),
        F.round(d, 6).alias("cohens_d"),
    )


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Step-down correction per metric over the variants present.

    Windows hold one row per variant.
    """
    by_p = Window.partitionBy("metric").orderBy("p_value", "variant")
    rank = F.row_number().over(by_p)
    m = F.count("*").over(Window.partitionBy("metric"))
    passes = F.col("p_value") <= alpha / (m - rank + 1)
    return tests.withColumn("_passes", passes).withColumn("significant", F.min("_passes").over(by_p)).drop("_passes")


def compare_variants(results: DataFrame, baseline: str, n_bootstrap: int = 10000, mode: str = "histogram") -> DataFrame:
    """Every variant against the baseline: means, difference, interval, p, effect size, significance."""
    pairs = skew.cut_lineage(align_variants(results, baseline))
    tests = paired_bootstrap(pairs, n_bootstrap, mode).join(cohens_d(pairs), ["variant", "metric"])
    return holm(tests).select(
        "variant", "metric", "baseline_mean", "variant_mean", "mean_diff", "ci_lower", "ci_upper", "p_value",
        "cohens_d", "significant",
    )


def full_context_gap(results: DataFrame, full: str, structured: str) -> DataFrame:
    """Per user and metric: what the structured memory loses or gains against the full context."""
    pairs = align_variants(results.filter(F.col("variant").isin(full, structured)), full)
    return pairs.select(
        "idhash",
        "metric",
        F.col("baseline").alias("full_value"),
        F.col("value").alias("structured_value"),
        F.round(F.col("value") - F.col("baseline"), 6).alias("gap"),
    )
