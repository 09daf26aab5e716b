"""Queries over preference items, notes, contexts, personas, retrieval and variants."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage, shared_folder, top_per_key
from placelore.operators import backward, context, evaluate, memory, notes, persona, profile, retrieval, routing, stats, variants
from placelore.operators.windows import day_between
from placelore.plans import queries_base as base
from placelore.plans import queries_eval as ev
from placelore.plans.settings import *  # noqa: F403
from placelore.sources import store
from placelore.sources import tables as t



def extract_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.extract_profile(
        t.clicks(spark, d), t.reviews(spark, d), t.poi(spark, d), t.demo(spark, d), ATTRIBUTES
    )


def profile_items(spark, d) -> DataFrame:
    """The daily items as a materialized table; routing and updates read it several times."""
    return cut_lineage(extract_profile(spark, d))


def axis_filter(spark, d):
    configs = [("all", False, False), ("implicit_only", True, False), ("explicit_only", False, True)]
    return routing.axis_filter(profile_items(spark, d), configs).select("variant", "idhash", "axis", "item", "path", "datestr")


def base_path_filter(spark, d):
    """Items with carelessly written paths."""
    loose = profile_items(spark, d).withColumn("path", F.concat(F.lit(" "), F.regexp_replace("path", " > ", ">  ")))
    return routing.base_path_filter(loose, t.taxonomy(spark, d)).select("idhash", "axis", "item", "path", "datestr")


@dataclass(frozen=True)
class Inputs:
    """Tables that several steps of one query read; each is made once."""

    items: DataFrame  # all daily items
    taxonomy: DataFrame
    held: DataFrame  # items of the notes of the train window
    notes: DataFrame

    def routed(self, first, last) -> DataFrame:
        """Items of the days routed against the notes of the train window."""
        batch = self.items.filter(day_between(first, last))
        return cut_lineage(routing.route_items(batch, self.taxonomy, self.held))


def inputs(spark, d) -> Inputs:
    items, taxonomy = profile_items(spark, d), cut_lineage(t.taxonomy(spark, d))
    train = items.filter(F.col("datestr") <= F.lit(base.W.train_end))
    routed = routing.route_items(train, taxonomy, train.select("idhash", "path", "item").limit(0))
    held, state = notes.apply_batch(routed, materialize=cut_lineage)
    return Inputs(items, taxonomy, cut_lineage(held), cut_lineage(state))


def routed_test(spark, d) -> DataFrame:
    return inputs(spark, d).routed(*base.TEST)


def route_items(spark, d):
    return routed_test(spark, d).select("idhash", "axis", "item", "path", "route").distinct()


def assign_group(spark, d):
    return routing.assign_group(routed_test(spark, d))


def demo_root_only(spark, d):
    """Assignments that repeat the user's demographics at every node."""
    made = inputs(spark, d)
    groups = routing.assign_group(made.routed(*base.TEST)).select("idhash", "path")
    info = (
        made.items
        .filter(F.col("axis") == "user_info")
        .groupBy("idhash")
        .agg(F.array_join(F.sort_array(F.collect_set("item")), ", ").alias("user_info"))
    )
    return routing.demo_root_only(groups.join(info, "idhash", "left"))


def path_validate(spark, d):
    """Category paths, paths one level deeper, and a foreign root."""
    poi = t.poi(spark, d)
    deeper = F.concat_ws(" > ", "category_path", "title")
    foreign = F.concat(F.lit("other > "), F.col("title"))
    raw = poi.select(F.explode(F.array(F.col("category_path"), deeper, foreign)).alias("path"))
    return routing.path_validate(raw, t.taxonomy(spark, d))


def update_notes(spark, d):
    """The first test day on top of the notes of the train window."""
    made = inputs(spark, d)
    routed = made.routed(base.W.test_start, base.W.test_start)
    new_items, new_notes = notes.apply_batch(routed, made.held, made.notes)
    return notes.with_content(new_notes, new_items)


def memory_upsert(spark, d):
    """Items read from a store to which the operations of the test window were applied after those of the train window."""
    made = inputs(spark, d)
    folder = f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    store.write_buckets(made.held, folder, base.W.train_end)
    store.upsert(made.routed(*base.TEST), folder, notes.ITEM_SCHEMA, base.W.test_end, notes.apply_ops)
    return store.read_as_of(spark, folder, notes.ITEM_SCHEMA, base.W.test_end)


def closed_form(spark, d) -> tuple[DataFrame, DataFrame]:
    return memory.memory_closed_form(profile_items(spark, d), t.taxonomy(spark, d), materialize=cut_lineage)


def note_paths(spark, d) -> DataFrame:
    return memory.memory_paths(profile_items(spark, d), t.taxonomy(spark, d))


def stored_notes(spark, d) -> tuple[DataFrame, DataFrame]:
    """The notes as a materialized version, which is what later steps read."""
    items, state = closed_form(spark, d)
    return cut_lineage(items), cut_lineage(state)


def memory_closed_form(spark, d):
    items, state = closed_form(spark, d)
    return notes.with_content(state, items)


def memory_ops(spark, d):
    made = inputs(spark, d)
    return notes.memory_ops(made.held, made.routed(*base.TEST))


def merge_siblings(spark, d):
    items, state, _ = backward.merge_siblings(*stored_notes(spark, d))
    return notes.with_content(state, items)


def lift_common_traits(spark, d):
    items, state = backward.lift_common_traits(*stored_notes(spark, d))
    return notes.with_content(state, items)


def compression_gain(spark, d):
    items, state = stored_notes(spark, d)
    return backward.compression_gain(items, backward.lift_common_traits(items, state)[0])


def prune_stale(spark, d):
    items, state = stored_notes(spark, d)
    items, state = backward.prune_stale(items, state, LAST_DAY, max_age=MAX_AGE)
    return notes.with_content(state, items)


def backward_pass(spark, d):
    items, state, _ = backward.backward_pass(*stored_notes(spark, d), LAST_DAY, max_age=MAX_AGE)
    return notes.with_content(state, items)


def build_memory(spark, d):
    options = memory.MemoryOptions(backward_every=BACKWARD_EVERY, max_age=MAX_AGE)
    items, state, _ = memory.build_memory(
        profile_items(spark, d), cut_lineage(t.taxonomy(spark, d)), FIRST_DAY, LAST_DAY, options=options
    )
    return notes.with_content(state, items)


def hierarchy_nodes(spark, d):
    return routing.hierarchy_nodes(note_paths(spark, d))


def dfs_order(spark, d):
    return context.dfs_order(note_paths(spark, d))


def budget_truncate(spark, d):
    items, state = stored_notes(spark, d)
    return context.budget_truncate(context.format_notes(state, items), BUDGET)


def note_context(spark, d):
    items, state = stored_notes(spark, d)
    return context.note_context(state, items, BUDGET)


def flat_top_facts(spark, d):
    return context.flat_top_facts(profile_items(spark, d))


def flat_memory(spark, d):
    return context.flat_memory(profile_items(spark, d), BUDGET)


def full_context(spark, d):
    return context.full_context(ev.daily_text(spark, d), BUDGET)


def item_recall_gap(spark, d):
    """Items of the whole history, looked up in the budgeted full context and in the budgeted notes."""
    items, state = stored_notes(spark, d)
    contexts = {"full_context": full_context(spark, d), "notes": context.note_context(state, items, BUDGET)}
    both = [c.select(F.lit(name).alias("variant"), "idhash", "context") for name, c in contexts.items()]
    recalls = evaluate.item_recall(cut_lineage(both[0].unionByName(both[1])), profile_items(spark, d))
    return evaluate.item_recall_gap(recalls, *contexts)


def fixed_hierarchy(spark, d):
    items, state = memory.memory_closed_form(profile_items(spark, d), t.taxonomy(spark, d), base_only=True, materialize=cut_lineage)
    return context.note_context(state, items, BUDGET)


def purposes(spark, d) -> DataFrame:
    """What the user looked at last, as the purpose of the recommendation."""
    latest = top_per_key(t.clicks(spark, d), ["idhash"], [F.desc("etimestamp"), F.desc("event_id")], 1)
    return latest.join(t.poi(spark, d), "sid").select("idhash", F.concat_ws(" ", "title", "category_path").alias("purpose"))


def persona_paths(spark, d):
    items, state = stored_notes(spark, d)
    return persona.persona_paths(state, items, purposes(spark, d))


def persona_query(spark, d):
    items, state = stored_notes(spark, d)
    return persona.persona(persona.persona_paths(state, items, purposes(spark, d)), items)


def cross_links(spark, d):
    return persona.cross_links(closed_form(spark, d)[0], LINK_THRESHOLD)


def surprise_priority(spark, d):
    made = inputs(spark, d)
    return persona.surprise_priority(made.held, made.routed(*base.TEST), made.taxonomy, base.W.test_end, HALF_LIFE)


def rerank(spark, d):
    candidates = t.clicks(spark, d, *map(str, base.TEST)).select("idhash", "sid")
    return persona.rerank(inputs(spark, d).held, candidates, t.poi(spark, d))


def stored_versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Validity intervals of the items and notes over the whole history, made by one fold and stored."""
    items, taxonomy = profile_items(spark, d), cut_lineage(t.taxonomy(spark, d))
    routed = routing.route_over_time(items, taxonomy, items.select("idhash", "path", "item").limit(0), with_route=False)
    versions = cut_lineage(notes.item_versions(routed))
    return versions, cut_lineage(notes.note_versions(versions))


def persona_consistency(spark, d):
    return persona.persona_consistency(notes.versions_on(stored_versions(spark, d)[0], HEALTH_DATES))


def structural_health(spark, d):
    """Versions at several run dates, each with the merges its backward pass would do."""
    version_items, version_notes = (cut_lineage(notes.versions_on(v, HEALTH_DATES)) for v in stored_versions(spark, d))
    log = backward.merge_siblings(version_items, version_notes, ("run_date", "idhash"))[2].filter(F.col("kind") == "full")
    return persona.structural_health(version_notes, log, max_age=MAX_AGE)


def bm25(spark, d):
    items, state = stored_notes(spark, d)
    queries = purposes(spark, d).select(F.col("idhash").alias("scope"), F.col("idhash").alias("query"), F.col("purpose").alias("text"))
    return retrieval.bm25(persona.note_documents(state, items), queries)


def vectors(spark, d) -> DataFrame:
    return t.read(spark, d, "embeddings").select(F.lit(0).alias("scope"), F.col("vec_id").alias("doc"), "embedding")


def vector_queries(spark, d) -> DataFrame:
    """Every fiftieth vector asks for its neighbors among all."""
    return vectors(spark, d).filter(F.col("doc") % 50 == 0).withColumnRenamed("doc", "query")


def dense_topk(spark, d):
    return retrieval.dense_topk(vectors(spark, d), vector_queries(spark, d))


def rrf(spark, d):
    """Documents and vectors of the same number as two views of a note."""
    docs = t.read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").join(
        vectors(spark, d).select("scope", "doc").hint("merge"), "doc"
    )
    asked = vector_queries(spark, d)
    texts = asked.select("scope", "query").hint("merge").join(docs.select(F.col("doc").alias("query"), "text"), "query")
    return retrieval.fused_topk(docs.select("scope", "doc", "text"), texts, vectors(spark, d), asked)


def variant_results(spark, d, names: list[str] | None = None, backward_every: int = 1) -> DataFrame:
    """Metrics of the presets, consolidated after every day as in the experiment."""
    users = base.train_users(spark, d)
    items = profile_items(spark, d).join(users, "idhash", "left_semi").filter(F.col("datestr") <= F.lit(base.W.train_end))
    texts = ev.daily_text(spark, d).join(users, "idhash", "left_semi").filter(F.col("datestr") <= F.lit(base.W.train_end))
    return variants.run_variants(
        users, cut_lineage(items), texts, cut_lineage(t.taxonomy(spark, d)), ev.truth(spark, d),
        FIRST_DAY, base.W.train_end, LABELS, LABEL_PATTERN, names=names, budget=BUDGET,
        options={"backward_every": backward_every, "max_age": MAX_AGE},
    )


def unconsolidated_results(spark, d, names: list[str]) -> DataFrame:
    """Metrics of presets that never consolidate; their notes are the daily fold, made in one period."""
    days = (base.W.train_end - FIRST_DAY).days + 1
    return cut_lineage(variant_results(spark, d, names, days))


def experiment_results(spark, d):
    return unconsolidated_results(spark, d, UNCONSOLIDATED)


def experiment_summary(spark, d):
    return stats.variant_summary(experiment_results(spark, d))


def experiment_comparison(spark, d):
    """Every preset against the notes: bootstrap, effect size, Holm correction."""
    return stats.compare_variants(experiment_results(spark, d), "ablation_backward", BOOTSTRAP_DRAWS, "indexed")


def experiment_gap(spark, d):
    """Metrics of the budgeted full context against those of the notes, user by user; other presets are not built for it."""
    compared = ["full_context", "ablation_backward"]
    return stats.full_context_gap(unconsolidated_results(spark, d, compared), *compared)


def run_variants(spark, d):
    return variant_results(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        extract_profile, axis_filter, base_path_filter, route_items, assign_group, demo_root_only, path_validate,
        update_notes, memory_closed_form, memory_ops, memory_upsert, merge_siblings, lift_common_traits, compression_gain,
        prune_stale, backward_pass, build_memory, hierarchy_nodes, dfs_order, budget_truncate, note_context,
        flat_top_facts, flat_memory, full_context, item_recall_gap, fixed_hierarchy, persona_paths, cross_links, surprise_priority,
        rerank, persona_consistency, structural_health, bm25, dense_topk, rrf, run_variants,
        experiment_results, experiment_summary, experiment_comparison, experiment_gap,
    )
} | {"persona": persona_query}
