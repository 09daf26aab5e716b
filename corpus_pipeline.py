"""A training corpus from ``documents``: toxic texts, copies, near copies and benchmark passages go; texts are tokenized.

Each stage takes (spark, docs, folder), works on all rows its predecessor kept, and its result is written as Parquet and
read again as the next stage's ``docs``. Rows without doc_id pass the two deduplicating stages unless an identified
row has the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm import decontaminate, exact_dedup, ngram_join, sentencepiece, toxicity
from placelore.llm.common import stored, table
from placelore.llm.queries import PIECE_MODEL

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose toxicity stays below ``TOXIC``; the model learns from the labelled rows of ``docs``."""
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, "_toxicity").filter(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more; the smallest doc_id of each group stays."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that cover less than the threshold of every benchmark item."""
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"), names=("_coverage", "_item"))
    return found.filter(F.col("_coverage") < decontaminate.COVERAGE).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows with the ids of the best segmentation, its score and the check of the round trip (columns so named are replaced)."""
    found = sentencepiece.encode(docs, PIECE_MODEL)
    return found.select(
        *[c for c in docs.columns if c not in ("ids", "best", "decoded", "score", "round_trip")],
        "ids",
        F.col("best")[0]["score"].alias("score"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: A trained classifier, string tiling and the piece lattice have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
