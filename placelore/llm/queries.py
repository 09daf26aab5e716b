"""Queries over the given tables: each operator applied to its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    license_scan,
    ngram_join,
    periodic_runs,
    pii,
    quality,
    secret_scan,
    sentencepiece,
    substring_dedup,
    token_counts,
    toxicity,
)
from placelore.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and places of personal data, and the places of terms that disclose it."""
    found = pii.find(table(spark, folder, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[
            pii.count_of(spans, k).alias(f"n_{k}")
            for k in ("email", "ip", "card", "phone", "term")
        ],
        F.sha2(pii.written(pii.base_only(spans)), 256).alias("base_sha256"),
        pii.written(spans).alias("spans"),
    )


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Best segmentation of every text, the scores and digests of the N best, and the exact round trip."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    best = F.col("best")
    return sentencepiece.encode(docs, PIECE_MODEL).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        best[0]["ids_sha256"].alias("ids_sha256"),
        best[0]["score"].alias("score"),
        F.transform(best, lambda b: b["score"]).alias("best_scores"),
        F.transform(best, lambda b: b["ids_sha256"]).alias("best_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"), words=3, percent=90)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "item_id", "coverage", (F.col("coverage") >= decontaminate.COVERAGE).alias("contaminated")
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_license(spark: SparkSession, folder: str) -> DataFrame:
    """Each document is a file of the tree /source/lang/number of a hundred documents/; those without an id are one file 'none' of a directory."""
    docs = table(spark, folder, "documents")
    parts = ["source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")]
    path = F.concat_ws("/", F.lit(""), *[F.coalesce(p, F.lit("none")) for p in parts])
    files = docs.select(path.alias("path"), "text")
    found = license_scan.scan(files, license_scan.templates(spark))
    return found.withColumns(
        {"doc_id": F.substring_index("path", "/", -1).try_cast("bigint"), "cosine": F.round("cosine", 6)}
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, WORD_TOKENIZER).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, folder, "documents")).drop("kept_text")


def with_repetition(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by the id's hash, repeats a part of itself to the end (a NULL id counts as the empty text)."""
    group, digit = divmod(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), 10)
    n = len(words)
    if digit or not n:
        return words
    a = group % n
    p = 1 + (n - a) // (3 + group % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text."""
    found = periodic_runs.periodic_runs(table(spark, folder, "documents"), with_repetition)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.transform(lines, lambda line: F.concat(line, F.lit("\n")))
    return found.withColumn("top", periodic_runs.longest_run("runs")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("top.l") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and places of secrets by fixed patterns, and the places of other runs that have a credential's format."""
    found = secret_scan.secrets(table(spark, folder, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tokens with common ends in both tokenizers, and how usual their links are."""
    found = alignment.align(table(spark, folder, "documents"), BYTE_TOKENIZER, PIECE_MODEL, written=False)
    return found.withColumnRenamed("groups", "groups_sha256").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii, op2_sentencepiece, op3_exact_dedup, op4_quality, op5_ngram_jaccard, op6_decontamination, op7_toxicity, op8_license,
        op9_token_counts, op10_substring_dedup, op11_periodic_runs, op12_secrets, op13_alignment, pipeline,
    )
}
