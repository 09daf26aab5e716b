"""Purpose-driven reading of the notes, links between branches, novelty, candidate ranking."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.functions.dimension import places_of
from placelore.functions.skew import row_number, top_per_key
from placelore.functions.text import SEP, ordered_concat, path_level, path_parent, path_prefix
from placelore.operators.notes import axis_rank
from placelore.operators.retrieval import bm25_scores

HALF_LIFE = 7.0  # days


def note_documents(notes: DataFrame, items: DataFrame) -> DataFrame:
    """Path and items of each note as a retrieval document of the user's scope."""
    words = items.groupBy("idhash", "path").agg(ordered_concat(["item"], "item", " ").alias("_items"))
    return notes.join(words, ["idhash", "path"], "left").select(
        F.col("idhash").alias("scope"), F.col("path").alias("doc"), F.concat_ws(" ", "path", "_items").alias("text")
    )


def persona_paths(
    notes: DataFrame, items: DataFrame, purposes: DataFrame, most: int = 8, least: int = 3
) -> DataFrame:
    """The root and the notes most relevant to the user's purpose: 3 to 8 paths.

    Notes without a matching word only fill up to ``least``.
    """
    queries = purposes.select(F.col("idhash").alias("scope"), F.col("idhash").alias("query"), F.col("purpose").alias("text"))
    scores = bm25_scores(note_documents(notes, items), queries).select(
        F.col("scope").alias("idhash"), F.col("doc").alias("path"), "score"
    )
    scored = (
        notes.select("idhash", "path")
        .join(purposes.select("idhash"), "idhash", "left_semi")
        .join(scores, ["idhash", "path"], "left")
        .fillna(0.0, ["score"])
    )
    is_root = path_level("path") == 1
    ranked = top_per_key(scored, ["idhash"], [is_root.desc(), F.desc("score"), F.col("path")], most, "rank")
    return ranked.filter((F.col("score") > 0) | (F.col("rank") <= least)).withColumn("rank", F.col("rank").cast("bigint"))


def persona(paths: DataFrame, items: DataFrame, n_traits: int = 5, n_patterns: int = 3) -> DataFrame:
    """One-line overview, the best supported traits and the best supported behavior patterns."""
    read = (
        items.join(paths.select("idhash", "path"), ["idhash", "path"], "left_semi")
        .filter((F.col("axis") != "user_info") & (F.col("polarity") > 0))
        .groupBy("idhash", "item")
        .agg(F.sum("support").alias("support"), F.bool_or(F.col("axis") == "implicit").alias("observed"))
    )
    order = [F.desc("support"), F.col("item")]
    traits = top_per_key(read, ["idhash"], order, n_traits, "rank")
    patterns = top_per_key(read.filter("observed"), ["idhash"], order, n_patterns, "rank")

    def joined(top: DataFrame, name: str) -> DataFrame:
        return top.groupBy("idhash").agg(ordered_concat(["rank"], "item", ", ").alias(name))

    sizes = paths.groupBy("idhash").agg(
        F.count("*").alias("n_paths"), F.min_by("path", F.when(path_level("path") > 1, F.col("rank"))).alias("main_path")
    )
    overview = F.concat(
        F.lit("user with "), F.col("n_paths").cast("string"), F.lit(" areas, mainly "), F.coalesce("main_path", F.lit("-"))
    )
    return (
        sizes.join(joined(traits, "traits"), "idhash", "left")
        .join(joined(patterns, "patterns"), "idhash", "left")
        .fillna("", ["traits", "patterns"])
        .select("idhash", overview.alias("overview"), "traits", "patterns")
    )


def cross_links(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Links between a user's notes of different domains whose items overlap (Jaccard).

    Notes with Jaccard >= t must share one of their first n - ceil(t n) + 1 items when the
    items are ordered by rarity within the user, so only those meet; nothing is left out.
    Frequent items come last and rarely join. A link is stored once per direction.
    """
    terms = (
        items.filter((F.col("axis") != "user_info") & (path_level("path") > 1))
        .select("idhash", "path", "item")
        .withColumn("_df", F.count("*").over(Window.partitionBy("idhash", "item")))
    )
    sets = terms.groupBy("idhash", "path").agg(F.array_sort(F.collect_list(F.struct("_df", "item"))).alias("_set"))
    n = F.size("_set")
    prefix = F.slice("_set", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))
    rows = sets.select(
        "idhash",
        "path",
        path_prefix("path", 2).alias("domain"),
        F.transform("_set", lambda s: s["item"]).alias("items"),
        F.explode(F.transform(prefix, lambda s: s["item"])).alias("term"),
    )
    a = rows.select("idhash", "term", *[F.col(c).alias(f"{c}_a") for c in ("path", "domain", "items")])
    b = rows.select("idhash", "term", *[F.col(c).alias(f"{c}_b") for c in ("path", "domain", "items")])
    pairs = (
        a.join(b, ["idhash", "term"])
        .filter((F.col("path_a") < F.col("path_b")) & (F.col("domain_a") != F.col("domain_b")))
        .dropDuplicates(["idhash", "path_a", "path_b"])
    )
    shared = F.size(F.array_intersect("items_a", "items_b"))
    jaccard = shared / (F.size("items_a") + F.size("items_b") - shared)
    linked = pairs.withColumn("_j", jaccard).filter(F.col("_j") >= threshold)
    ways = F.array(
        F.struct(F.col("path_a").alias("path"), F.col("path_b").alias("linked_path")),
        F.struct(F.col("path_b").alias("path"), F.col("path_a").alias("linked_path")),
    )
    return linked.select("idhash", F.inline(ways), F.round("_j", 6).alias("score"))


def conflict(items: DataFrame, new_items: DataFrame, as_of: date, half_life: float = HALF_LIFE) -> DataFrame:
    """(idhash, path, item, contradiction) of every new item: how far the memory holds the opposite.

    What is held about an item, wherever it stands in the user's tree, is weighed by its support, halved with every ``half_life``
    days since it was last seen. The score is the weight of the polarity opposite to the new item's newest one over one plus
    all weight, so it lies in [0, 1) and is 0 for items not held. Held items become one row per (user, item) before they
    are joined.
    """
    age = F.greatest(F.datediff(F.lit(as_of), "last_seen"), F.lit(0))
    weight = F.col("support") * F.pow(F.lit(0.5), age / F.lit(float(half_life)))

    def weight_of(sign: Column) -> Column:
        return F.sum(F.when(sign, weight).otherwise(0.0))

    held = items.filter(F.col("axis") != "user_info").groupBy("idhash", "item").agg(
        weight_of(F.col("polarity") > 0).alias("_likes"), weight_of(F.col("polarity") < 0).alias("_dislikes")
    )
    newest = F.max(F.struct("datestr", axis_rank().alias("rank"), "polarity")).alias("_newest")
    new = new_items.filter(F.col("axis") != "user_info").groupBy("idhash", "path", "item").agg(newest)
    sign = F.col("_newest.polarity")
    opposite = F.when(sign > 0, F.col("_dislikes")).when(sign < 0, F.col("_likes")).otherwise(0.0)
    return (
        new.join(held, ["idhash", "item"], "left")
        .fillna(0.0, ["_likes", "_dislikes"])
        .select("idhash", "path", "item", (opposite / (1 + F.col("_likes") + F.col("_dislikes"))).alias("contradiction"))
    )


def novelty(items: DataFrame, new_items: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(idhash, path, item, novelty): ``-ln`` of the smoothed share of the new item's domain in the user's memory."""
    held = items.filter(F.col("axis") != "user_info").groupBy("idhash", path_prefix("path", 2).alias("domain")).agg(
        F.sum("support").alias("in_domain")
    )
    totals = held.groupBy("idhash").agg(F.sum("in_domain").alias("in_memory"))
    n_domains = taxonomy.filter(path_level("path") == 2).agg(F.count("*")).scalar()
    share = (F.col("in_domain") + 1) / (F.col("in_memory") + n_domains)
    return (
        new_items.filter(F.col("axis") != "user_info")
        .select("idhash", "path", "item", path_prefix("path", 2).alias("domain"))
        .distinct()
        .join(held, ["idhash", "domain"], "left")
        .join(totals, "idhash", "left")
        .fillna(0, ["in_domain", "in_memory"])
        .select("idhash", "path", "item", (-F.log(share)).alias("novelty"))
    )


def surprise_priority(
    items: DataFrame, new_items: DataFrame, taxonomy: DataFrame, as_of: date, half_life: float = HALF_LIFE
) -> DataFrame:
    """Storage priority of new items: expected ones score low, novel ones and those that contradict the memory high.

    ``score`` is the sum of ``novelty`` and ``contradiction``.
    """
    both = novelty(items, new_items, taxonomy).join(
        conflict(items, new_items, as_of, half_life), ["idhash", "path", "item"]
    )
    return both.select(
        "idhash", "path", "item",
        F.round("novelty", 6).alias("novelty"),
        F.round("contradiction", 6).alias("contradiction"),
        F.round(F.col("novelty") + F.col("contradiction"), 6).alias("score"),
    )


def rerank(items: DataFrame, candidates: DataFrame, poi: DataFrame) -> DataFrame:
    """All candidate places, ordered by how well their title words match the user's items.

    An item counts a quarter anywhere, half in the same domain, fully in the same category.
    Item weights are summed per tree level first, so a candidate meets three rows per word.
    """
    levels = F.sequence(F.lit(1), F.lit(3))
    weights = (
        items.filter(F.col("axis") != "user_info")
        .select(
            "idhash",
            F.col("item").alias("word"),
            F.explode(F.array_distinct(F.transform(levels, lambda i: path_prefix(F.col("path"), i)))).alias("place"),
            (F.col("support") * F.col("polarity")).alias("w"),
        )
        .groupBy("idhash", "word", "place")
        .agg(F.sum("w").alias("w"))
    )
    path = F.col("category_path")
    words = (
        candidates.select("idhash", "sid")
        .distinct()
        .join(places_of(poi).select("sid", "title", "category_path"), "sid")
        .select("idhash", "sid", "category_path", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
        .select(
            "idhash", "sid", "word",
            F.explode(F.array_distinct(F.transform(levels, lambda i: path_prefix(path, i)))).alias("place"),
        )
    )
    share = F.when(F.size(F.split("place", SEP)) == 3, 0.5).otherwise(0.25)
    scores = (
        words.join(weights, ["idhash", "word", "place"], "left")
        .groupBy("idhash", "sid")
        .agg(F.round(F.sum(F.coalesce("w", F.lit(0)) * share), 6).alias("score"))
    )
    return row_number(scores, ["idhash"], [F.desc("score"), F.col("sid")], [(F.floor("score"), True)], "rank")


def persona_consistency(versions: DataFrame) -> DataFrame:
    """Jaccard of a user's preferences between consecutive versions of the memory.

    ``versions``: idhash, run_date and the items of the notes at that date. A preference is an item with its polarity, wherever it is
    filed; demographics do not count. A user's first version has no row.
    """
    sets = versions.filter(F.col("axis") != "user_info").select("idhash", "run_date", "item", "polarity").distinct()
    sizes = sets.groupBy("idhash", "run_date").agg(F.count("*").alias("n"))
    runs = Window.partitionBy("idhash").orderBy("run_date")  # one row per version
    steps = sizes.select(
        "idhash", "run_date", "n", F.lag("run_date").over(runs).alias("previous"), F.lag("n").over(runs).alias("n_previous")
    ).filter(F.col("previous").isNotNull())
    earlier = sets.select("idhash", F.col("run_date").alias("previous"), "item", "polarity")
    shared = (
        sets.join(steps.select("idhash", "run_date", "previous"), ["idhash", "run_date"])
        .join(earlier, ["idhash", "previous", "item", "polarity"], "left_semi")
        .groupBy("idhash", "run_date")
        .agg(F.count("*").alias("shared"))
    )
    union = F.col("n") + F.col("n_previous") - F.col("shared")
    return (
        steps.join(shared, ["idhash", "run_date"], "left")
        .fillna(0, ["shared"])
        .select("idhash", "run_date", F.round(F.col("shared") / union, 6).alias("consistency"))
    )


def structural_health(
    notes: DataFrame, merge_log: DataFrame, min_updates: int = 2, max_age: int = 120
) -> DataFrame:
    """Mean depth, nodes per user, share of leaves that are stale, and merge rate per ``run_date``.

    ``notes``: all versions; ``merge_log``: one row per merged-away note.
    """
    stale = (F.col("updated_count") <= min_updates) & (F.date_diff("run_date", "recently_updated") > max_age)
    inner = notes.select("run_date", "idhash", path_parent("path").alias("path")).filter("path is not null").distinct()
    leaves = notes.join(inner.withColumn("_inner", F.lit(True)), ["run_date", "idhash", "path"], "left")
    leaf = F.col("_inner").isNull()
    sizes = leaves.groupBy("run_date", "idhash").agg(
        F.count("*").alias("nodes"), F.sum(path_level("path")).alias("depths"), F.count_if(leaf).alias("leaves"),
        F.count_if(stale & leaf).alias("stale"),
    )
    per_run = sizes.groupBy("run_date").agg(
        F.sum("nodes").alias("nodes"),
        F.sum("depths").alias("depths"),
        F.sum("leaves").alias("leaves"),
        F.sum("stale").alias("stale"),
        F.count("*").alias("users"),
    )
    merges = merge_log.groupBy("run_date").agg(F.count("*").alias("merges"))
    return (
        per_run.join(merges, "run_date", "left")
        .fillna(0, ["merges"])
        .select(
            "run_date",
            F.round(F.col("depths") / F.col("nodes"), 6).alias("mean_depth"),
            F.round(F.col("nodes") / F.col("users"), 6).alias("nodes_per_user"),
            F.round(F.col("stale") / F.col("leaves"), 6).alias("stale_ratio"),
            F.round(F.col("merges") / F.col("nodes"), 6).alias("merge_rate"),
        )
    )
