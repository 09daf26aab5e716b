"""Per-group ranking, running sums and lookups that never put a whole group into one task.

A window over a user sends all rows of that user to one task. When one user may own
a third of the log this does not finish, so order-dependent work is done in two levels:

1. inside (group, bucket), where a bucket is a coarse prefix of the sort order such as
   the hour of the timestamp; a hot group falls apart into as many tasks as it has buckets;
2. over one row per (group, bucket), produced by a map-side combined aggregate, to get
   what the earlier buckets contribute.

The results are exactly those of the one-level window.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Bucket = tuple[Column, bool]  # expression, descending?


def _with_buckets(df: DataFrame, buckets: Sequence[Bucket]) -> tuple[DataFrame, list[str], list[Column]]:
    names = [f"_b{i}" for i in range(len(buckets))]
    out = df.select("*", *[expr.alias(n) for n, (expr, _) in zip(names, buckets)])
    order = [F.col(n).desc() if desc else F.col(n).asc() for n, (_, desc) in zip(names, buckets)]
    return out, names, order


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[Bucket],
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` per group. Buckets must be a prefix of the order and not NULL."""
    rows, names, bucket_order = _with_buckets(df.withColumn("_v", value.cast("bigint")), buckets)
    local = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(*bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*keys, *names)
        .agg(F.sum("_v").alias("_sum"))
        .select(*keys, *names, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        rows.withColumn("_local", F.sum("_v").over(local))
        .join(before, [*keys, *names], "left")
        .withColumn(out, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_v", "_local", "_before", *names)
    )


def row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[Bucket], out: str
) -> DataFrame:
    """``row_number()`` per group; the order must be total."""
    return running_sum(df, keys, order, buckets, F.lit(1), out)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: Sequence[Bucket], cols: Sequence[str], out: str
) -> DataFrame:
    """Struct of ``cols`` of the preceding row of the group in ascending ``order``; NULL for the first."""
    rows, names, bucket_order = _with_buckets(df, buckets)
    local = Window.partitionBy(*keys, *names).orderBy(*order)
    lasts = rows.groupBy(*keys, *names).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    )
    carried = lasts.select(
        *keys, *names, F.lag("_last").over(Window.partitionBy(*keys).orderBy(*bucket_order)).alias("_carried")
    )
    return (
        rows.withColumn(out, F.lag(F.struct(*cols)).over(local))
        .join(carried, [*keys, *names], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
        .drop("_carried", *names)
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` is planned with a group limit below the exchange: each input
    task keeps ``k`` rows per key, so a hot key ships k rows per task, not all of them.
    """
    rank = out or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
    return ranked if out else ranked.drop(rank)


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the session, shared by all executors.

    ``spark.checkpoint.dir`` is read from the session. Only a local session without it gets
    a scratch folder; on a cluster a missing setting is an error, because a folder of one
    machine is lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="placelore-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table to the shared folder and reads it back (an action).

    Survives the loss of executors. Unlike a checkpointed plan, the table is columnar, is
    pruned by its readers, and starts with known size and without inherited plan
    constraints, which otherwise pile up in a loop. The folder's owner cleans it up.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
