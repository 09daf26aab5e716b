"""Queries over evidence texts, prompts, responses, predictions and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage, shared_folder
from placelore.functions.text import category_at
from placelore.operators import evaluate, evidence, selection, stats
from placelore.plans import queries_base as base
from placelore.plans.settings import *  # noqa: F403
from placelore.sources import tables as t
from placelore.sources import texts

# -- evidence -----------------------------------------------------------------------------


def behavior_texts(spark, d):
    return evidence.daily_behavior_text(t.clicks(spark, d), t.poi(spark, d))


def review_texts(spark, d):
    return evidence.daily_review_text(base.clean_reviews(spark, d))


def daily_text(spark, d):
    return evidence.daily_text(behavior_texts(spark, d), review_texts(spark, d))


def full_text(spark, d):
    return evidence.full_text(daily_text(spark, d))


def implicit_prompt(spark, d):
    return evidence.implicit_prompt(base.enrich_clicks(spark, d), base.enrich_saves(spark, d), base.demo_texts(spark, d), PROMPT_ROWS)


def explicit_prompt(spark, d):
    rows = cut_lineage(base.review_rows(spark, d))
    return evidence.explicit_prompt(rows, EXPLICIT_TEMPLATE, FEW_SHOT_RICH, FEW_SHOT_SPARSE, CHUNK)


def distill_pairs(spark, d):
    """A turn of a user and the turn that follows it."""
    turns = t.read(spark, d, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.filter(F.col("role") != "user").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return evidence.distill_pairs(asked, answered, ["conv_id", "turn"])


def explicit_parse(spark, d):
    return evidence.explicit_parse(t.extraction_responses(spark, d))


def token_usage(spark, d):
    return evidence.token_usage(t.message_usage(spark, d), *PRICES)


def behavior_clusters(spark, d):
    return evidence.behavior_clusters(t.clicks(spark, d), t.poi(spark, d))


def implicit_persona(spark, d):
    return evidence.implicit_persona(t.clicks(spark, d), t.poi(spark, d), FIRST_DAY, LAST_DAY)


def item_dedup(spark, d):
    """Titles as items; search clicks write them in capitals with extra blanks."""
    named = t.clicks(spark, d).join(t.poi(spark, d).select("sid", "title"), "sid")
    item = F.when(F.col("action") == "click", F.upper(F.regexp_replace("title", " ", "  "))).otherwise(F.col("title"))
    items = named.select("idhash", "event_id", "etimestamp", item.alias("item"))
    return evidence.item_dedup(items, [F.col("etimestamp"), F.col("event_id")])


def read_daily_texts(spark, d):
    """Writes the conversation turns as daily JSON lines, some of them broken, and reads them back."""
    case = (F.col("conv_id") + F.col("turn")) % 7
    user = F.concat(F.lit(" u"), F.col("conv_id").cast("string"))
    lines = t.read(spark, d, "conversations").select(
        user.alias("idhash"),
        "turn",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("datestr"),
        F.when(case == 3, F.lit('broken {"idhash": '))
        .when(case == 5, F.lit("   "))
        .otherwise(F.to_json(F.struct(user.alias("idhash"), F.col("text").alias(texts.IMPLICIT_FIELD))))
        .alias("value"),
    )
    folder = f"{shared_folder(spark)}/daily-texts-{uuid.uuid4().hex}"
    texts.write_lines(lines, folder, ["idhash", "turn"])
    return texts.read_daily_texts(spark, folder, texts.IMPLICIT_FIELD)


# -- predictions --------------------------------------------------------------------------


def truth(spark: SparkSession, d: str) -> DataFrame:
    clicks = t.clicks(spark, d, *map(str, base.TEST))
    return selection.ground_truth(clicks, t.poi(spark, d), base.train_users(spark, d), *base.TEST, level=EVAL_LEVEL)


def train_support(spark, d) -> DataFrame:
    """Clicks and last click per (user, category) in the train window."""
    clicks = t.clicks(spark, d, *map(str, base.TRAIN)).join(base.train_users(spark, d), "idhash", "left_semi")
    per_poi = clicks.groupBy("idhash", "sid").agg(F.count("*").alias("n"), F.max("etimestamp").alias("last"))
    return (
        per_poi.join(t.poi(spark, d).select("sid", category_at("category_path", EVAL_LEVEL).alias("category")), "sid")
        .filter(F.col("category").isNotNull())
        .groupBy("idhash", "category")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    )


def predictions(spark, d) -> DataFrame:
    """Variants ``default`` (no evidence), ``support`` (by clicks) and ``recent`` (by last click)."""
    users = cut_lineage(base.train_users(spark, d))
    known = cut_lineage(train_support(spark, d))

    def variant(name: str, support) -> DataFrame:
        ranked = evaluate.ranked_predictions(
            known.select("idhash", "category", support.alias("support")), ["idhash"], LABELS
        )
        padded = evaluate.validate_pad(users.join(ranked, "idhash", "left"), LABELS)
        return padded.select(F.lit(name).alias("variant"), "idhash", "predictions")

    default = evaluate.validate_pad(users.withColumn("predictions", F.lit(None).cast("array<string>")), LABELS)
    last = F.unix_micros(F.col("last").cast("timestamp"))
    return (
        default.select(F.lit("default").alias("variant"), "idhash", "predictions")
        .unionByName(variant("support", F.col("n")))
        .unionByName(variant("recent", last))
    )


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("predictions", F.array_join("predictions", "|"))


def parse_predictions(spark, d):
    return _joined(evaluate.parse_predictions(t.prediction_responses(spark, d)))


def validate_pad(spark, d):
    return _joined(evaluate.validate_pad(evaluate.parse_predictions(t.prediction_responses(spark, d)), LABELS))


def category_baseline(spark, d):
    contexts = full_text(spark, d).select("idhash", F.col("text").alias("context"))
    return _joined(evaluate.category_baseline(contexts, LABELS, LABEL_PATTERN, ["idhash"]))


def prediction_prompt(spark, d):
    contexts = full_text(spark, d).select("idhash", F.col("text").alias("context"))
    return evaluate.prediction_prompt(contexts, LABELS, PREDICTION_TEMPLATE)


def precision_recall(spark, d):
    return evaluate.precision_recall(predictions(spark, d), truth(spark, d))


def ndcg(spark, d):
    return evaluate.ndcg(predictions(spark, d), truth(spark, d))


def hit_rate(spark, d):
    return evaluate.hit_rate(predictions(spark, d), truth(spark, d))


def mrr(spark, d):
    return evaluate.mrr(predictions(spark, d), truth(spark, d))


def results(spark, d) -> DataFrame:
    """Metric rows as the materialized result table that comparisons read."""
    return cut_lineage(all_metrics(spark, d))


def all_metrics(spark, d):
    return evaluate.all_metrics(predictions(spark, d), truth(spark, d))


def pairwise_eval(spark, d):
    scores = train_support(spark, d).select("idhash", "category", F.col("n").alias("score"))
    return evaluate.pairwise_eval(scores, truth(spark, d), LABELS)


# -- statistics ---------------------------------------------------------------------------


def variant_summary(spark, d):
    return stats.variant_summary(results(spark, d))


def align_variants(spark, d):
    return stats.align_variants(results(spark, d), "support")


def paired_bootstrap(spark, d):
    return stats.paired_bootstrap(align_variants(spark, d), BOOTSTRAP_DRAWS, "indexed")


def cohens_d(spark, d):
    return stats.cohens_d(align_variants(spark, d))


def holm(spark, d):
    return stats.holm(paired_bootstrap(spark, d).select("variant", "metric", "p_value"))


def compare_variants(spark, d):
    return stats.compare_variants(results(spark, d), "support", BOOTSTRAP_DRAWS, "indexed")


def full_context_gap(spark, d):
    return stats.full_context_gap(results(spark, d), "support", "recent")


QUERIES = {
    f.__name__: f
    for f in (
        daily_text, full_text, implicit_prompt, explicit_prompt, distill_pairs, explicit_parse, token_usage, behavior_clusters,
        implicit_persona, item_dedup, read_daily_texts, parse_predictions, validate_pad, category_baseline,
        prediction_prompt, precision_recall, ndcg, hit_rate, mrr, all_metrics, pairwise_eval, variant_summary,
        align_variants, paired_bootstrap, cohens_d, holm, compare_variants,
        full_context_gap,
    )
}
