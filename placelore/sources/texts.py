"""Daily extraction texts as JSON lines: tolerant reader and partitioned writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions.text import has_text, is_json, strip

IMPLICIT_FIELD, EXPLICIT_FIELD = "llm_response", "persona_text"  # fixed values of the file format


def write_lines(lines: DataFrame, folder: str, order: list[str], files_per_day: int = 16) -> None:
    """Writes ``value`` per ``datestr`` folder. Lines of one user stay in one file, in ``order``."""
    slot = F.pmod(F.xxhash64("idhash"), F.lit(files_per_day))
    (
        lines.withColumn("_slot", slot)
        .repartition("datestr", "_slot")
        .sortWithinPartitions("datestr", "_slot", *order)
        .select("datestr", "value")
        .write.mode("overwrite")
        .partitionBy("datestr")
        .text(folder)
    )


def write_implicit(results: DataFrame, folder: str) -> None:
    """One line per user and day: response, prompt and token usage."""
    line = F.to_json(F.struct("idhash", F.col("response").alias(IMPLICIT_FIELD), F.col("prompt").alias("prompts"), "usage"))
    write_lines(results.withColumn("value", line), folder, ["idhash"])


def write_explicit(texts: DataFrame, folder: str) -> None:
    line = F.to_json(F.struct("idhash", F.col("text").alias(EXPLICIT_FIELD)))
    write_lines(texts.filter(has_text("text")).withColumn("value", line), folder, ["idhash"])


def read_daily_texts(spark: SparkSession, folder: str, text_field: str) -> DataFrame:
    """Last usable record per user and day; blank or malformed lines, ids and texts are skipped.

    File order is (path, block start, position in the block).
    """
    lines = (
        spark.read.schema("value string, datestr date")
        .text(folder)
        .select(
            "value",
            "datestr",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("position"),
        )
    )
    return (
        lines.filter(is_json("value"))
        .select(
            "datestr",
            "position",
            strip(F.get_json_object("value", "$.idhash")).alias("idhash"),
            strip(F.get_json_object("value", f"$.{text_field}")).alias("text"),
        )
        .filter(has_text("idhash") & has_text("text"))
        .groupBy("idhash", "datestr")
        .agg(F.max_by("text", "position").alias("text"))
    )
