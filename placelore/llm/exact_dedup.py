"""Exact duplicates: frequent digests by Misra-Gries and broadcast, all others by an ordinary shuffle.

Texts are equal when they are identical without ASCII white space. Each document is reduced once to
a narrow row (id, code points, digest), so texts are read once and never shuffled.

* The Misra-Gries counters of ``DataFrame.stat.freqItems`` hold every digest of more than ``HEAVY_SHARE`` of
  the rows and at most 1 / ``HEAVY_SHARE`` digests in all, whatever the input.
* One aggregate over the rows of these candidates, combined on the map side, verifies the counts and finds the
  winners. They are joined by broadcast: rows of the large groups never meet in one task.
* The rest, groups of at most that share of the rows each, is grouped by a window on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.llm.common import broadcast_if_at_most, stored

HEAVY_SHARE = 1 / 2000
MAX_DROPPED = 1_000_000  # ids of 8 bytes; beyond that the join is shuffled
WHITESPACE = " \t\n\x0b\x0c\r"


def digest_of(text: Column) -> tuple[Column, Column]:
    """Code points of the original text, and SHA-256 of the text without white space; NULL as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.length(whole).cast("bigint"), F.sha2(F.translate(whole, WHITESPACE, ""), 256)


def exact_groups(docs: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    In each group the row with most code points, then the smallest doc_id stays. NULL texts are
    empty texts. A NULL doc_id loses every tie and is kept when it has no rival; rows that repeat a doc_id
    and its text count in group_size and carry the same decision, as they are one document. An empty
    table gives an empty table; columns other than doc_id and text are not read.
    """
    length, digest = digest_of(F.col("text"))
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), length.alias("_n"), digest.alias("text_sha256")))
    order = F.struct(F.col("_n"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("first"))
    rows = rows.withColumn("_order", order)

    candidates = F.broadcast(  # at most 1 / heavy_share digests
        rows.stat.freqItems(["text_sha256"], heavy_share).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    )
    winners = stored(
        rows.join(candidates, "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("_order").alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") > 1)
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "*", F.max("_order").over(group).alias("_best"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    keep = F.when(F.col("_best.known"), F.bitwise_not(F.col("_best.first")))
    return heavy.unionByName(rest).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("_order") == F.col("_best")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, all columns: one row per distinct text.

    Rows that repeat a doc_id are reduced to one as well when they repeat its text; rows without doc_id
    are dropped when an identified row has the same text, and otherwise one of them stays.
    """
    groups = stored(exact_groups(docs))
    lost = groups.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_lost")).distinct()
    lost = broadcast_if_at_most(stored(lost), MAX_DROPPED)
    kept = docs.join(lost, docs["doc_id"] == F.col("_lost"), "left_anti")
    # a doc_id is named by several kept rows, or kept and lost at once, only where the input repeats it
    repeated = stored(
        groups.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(0)))
        .withColumn("_known", F.col("doc_id").isNotNull())
        .groupBy("_known", "_id")
        .agg(F.count(F.lit(1)).alias("_times"))
        .filter("_times > 1 or not _known")
        .select("_known", "_id")
    )
    if repeated.isEmpty():
        return kept
    at = (docs["doc_id"].isNotNull() == F.col("_known")) & (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0)) == F.col("_id"))
    _, digest = digest_of(F.col("text"))
    once = docs.join(repeated, at, "left_semi").withColumn("_sha", digest)
    winners = groups.filter("kept").select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep")).distinct()
    once = once.join(winners, "_sha").filter(F.col("doc_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
    return docs.join(repeated, at, "left_anti").join(lost, docs["doc_id"] == F.col("_lost"), "left_anti").unionByName(
        once.select(*docs.columns)
    )
