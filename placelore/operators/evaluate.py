"""Category prediction and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.functions.skew import top_per_key
from placelore.functions.text import TOKEN, is_json
from placelore.operators.evidence import fill_template

METRICS = ["precision@1", "precision@3", "precision@5", "recall@5", "ndcg@10", "hr@10", "mrr"]

# The prediction categories in padding order.
POI_CATEGORIES = [
    "음식점", "카페/디저트", "교통/모빌리티", "여행/숙박", "레저/스포츠", "문화/예술",
    "자기계발", "반려동물", "쇼핑", "의료", "미용",
]


def parse_predictions(responses: DataFrame) -> DataFrame:
    """Label list out of a response: whole text, then a ``{...}`` in it, then a ``[...]``; else NULL."""
    raw = F.trim("raw")

    def labels(text: Column) -> Column:
        return F.from_json(F.when(is_json(text), text), "predictions array<string>")["predictions"]

    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    array = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    found = F.coalesce(labels(raw), labels(inner), F.from_json(F.when(is_json(array), array), "array<string>"))
    return responses.select("idhash", found.alias("predictions"))


def validate_pad(predictions: DataFrame, labels: list[str] = POI_CATEGORIES, size: int = 10) -> DataFrame:
    """Known labels in order of first mention, padded from ``labels`` in their order, cut to ``size``."""
    universe = F.array(*[F.lit(label) for label in labels])
    given = F.coalesce("predictions", F.array().cast("array<string>"))
    known = F.array_distinct(F.filter(given, lambda p: F.array_contains(universe, p)))
    padded = F.slice(F.concat(known, F.array_except(universe, known)), 1, size)
    return predictions.withColumn("predictions", padded)


def prediction_prompt(contexts: DataFrame, labels: list[str], template: str) -> DataFrame:
    """Template fields ``{memory_context}`` and ``{category_list}``."""
    fields = {"memory_context": F.coalesce("context", F.lit("")), "category_list": F.lit(", ".join(labels))}
    return contexts.select("idhash", fill_template(template, fields).alias("prompt"))


def ranked_predictions(support: DataFrame, keys: list[str], labels: list[str], size: int = 10) -> DataFrame:
    """Labels by ``support`` descending (ties in label order), padded. At most ``size`` labels per key are gathered."""
    universe = F.array(*[F.lit(label) for label in labels])
    placed = support.withColumn("_place", F.array_position(universe, F.col("category"))).filter(F.col("_place") > 0)
    best = top_per_key(placed, keys, [F.col("support").desc(), F.col("_place")], size, "_rank")
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "category")))
    lists = best.groupBy(*keys).agg(F.transform(ordered, lambda r: r["category"]).alias("predictions"))
    return validate_pad(lists, labels, size)


def category_baseline(contexts: DataFrame, labels: list[str], pattern: str, keys: list[str], size: int = 10) -> DataFrame:
    """Deterministic stand-in for the model: labels ranked by how often the context mentions them."""
    mentions = contexts.select(*keys, F.explode(F.regexp_extract_all("context", F.lit(f"({pattern})"), F.lit(1))).alias("category"))
    support = mentions.groupBy(*keys, "category").agg(F.count("*").alias("support"))
    ranked = ranked_predictions(support, keys, labels, size)
    return validate_pad(contexts.select(*keys).join(ranked, keys, "left"), labels, size)


def _scored(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Hit positions per (variant, user) with the size of the truth; users without truth stay."""
    sizes = truth.groupBy("idhash").agg(F.count("*").alias("n_truth"))
    flat = predictions.select("variant", "idhash", F.posexplode_outer("predictions").alias("pos", "category"))
    hits = truth.select("idhash", "category", F.lit(True).alias("hit"))
    return (
        flat.join(hits, ["idhash", "category"], "left")
        .join(sizes, "idhash", "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )


def _hits(k: int) -> Column:
    return F.count_if(F.col("hit") & (F.col("pos") < k))


def _precision(k: int) -> Column:
    return _hits(k) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def _n_truth() -> Column:
    return F.coalesce(F.max("n_truth"), F.lit(0))


def _recall(k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    return F.when(_n_truth() > 0, _hits(k) / _n_truth()).otherwise(F.lit(0.0))


def _ndcg(k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    gain = F.sum(F.when(F.col("hit") & (F.col("pos") < k), 1.0 / F.log2(F.col("pos") + 2.0)).otherwise(0.0))
    ranks = F.sequence(F.lit(1), F.least(F.lit(k), _n_truth().cast("int")))
    ideal = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))
    return F.when(_n_truth() > 0, gain / ideal).otherwise(F.lit(0.0))


def _hit_rate(k: int) -> Column:
    return F.when(_hits(k) > 0, 1.0).otherwise(0.0) if k > 0 else F.lit(0.0)


def _mrr() -> Column:
    return F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("pos") + 1.0)), F.lit(0.0))


def metrics(predictions: DataFrame, truth: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One aggregate over the exploded predictions; ``truth`` holds distinct (user, category)."""
    return (
        _scored(predictions, truth)
        .groupBy("variant", "idhash")
        .agg(*[F.round(c, 6).alias(name) for name, c in columns.items()])
    )


def precision_recall(predictions: DataFrame, truth: DataFrame, ks=(1, 3, 5), recall_k: int = 5) -> DataFrame:
    columns = {f"precision@{k}": _precision(k) for k in ks} | {f"recall@{recall_k}": _recall(recall_k)}
    return metrics(predictions, truth, columns)


def ndcg(predictions: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return metrics(predictions, truth, {f"ndcg@{k}": _ndcg(k)})


def hit_rate(predictions: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return metrics(predictions, truth, {f"hr@{k}": _hit_rate(k)})


def mrr(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Over the whole list, not cut."""
    return metrics(predictions, truth, {"mrr": _mrr()})


def all_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    columns = {
        "precision@1": _precision(1),
        "precision@3": _precision(3),
        "precision@5": _precision(5),
        "recall@5": _recall(5),
        "ndcg@10": _ndcg(10),
        "hr@10": _hit_rate(10),
        "mrr": _mrr(),
    }
    return metrics(predictions, truth, columns)


def pairwise_eval(scores: DataFrame, truth: DataFrame, labels: list[str]) -> DataFrame:
    """How often a visited category scores above a not visited one, ties counting half.

    ``scores`` has a row per (user, category) with positive ``score``; other labels score 0.
    The share over all pairs is the rank-sum statistic, so no pairs are built: with the
    labels of a user sorted by score, it follows from the average ranks of the visited ones.
    """
    from pyspark.sql import Window

    users = scores.select("idhash").distinct().join(truth.select("idhash").distinct(), "idhash", "left_semi")
    universe = F.array(*[F.lit(label) for label in labels])
    rows = (
        users.select("idhash", F.explode(universe).alias("category"))
        .join(scores.select("idhash", "category", "score"), ["idhash", "category"], "left")
        .join(truth.select("idhash", "category", F.lit(1).alias("visited")), ["idhash", "category"], "left")
        .fillna(0, ["score", "visited"])
    )
    w = Window.partitionBy("idhash")  # one row per label
    average_rank = F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("idhash", "score")) - 1) / 2.0
    sums = (
        rows.withColumn("_rank", average_rank)
        .groupBy("idhash")
        .agg(
            F.sum("visited").alias("n1"),
            F.sum(1 - F.col("visited")).alias("n0"),
            F.sum(F.when(F.col("visited") == 1, F.col("_rank")).otherwise(0.0)).alias("ranks"),
        )
        .filter((F.col("n1") > 0) & (F.col("n0") > 0))
    )
    wins = F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return sums.select(
        "idhash", (F.col("n1") * F.col("n0")).alias("n_pairs"), F.round(wins / (F.col("n1") * F.col("n0")), 6).alias("accuracy")
    )


def item_recall(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """(variant, idhash, n_items, found, recall): distinct items of a user that stand in the context of a variant.

    An item is found where its tokens stand next to each other in its order, in any case; demographics and items without tokens do
    not count. Users without items have no row; an empty or NULL context finds nothing. The tokens of the contexts are an inverted
    index met by the items' tokens; a start at which all tokens of an item meet is a place of it. Both sides of a (user,
    token) are bounded by the budget of a context and the items of a user.
    """

    def tokens(text: str) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    wanted = (
        items.filter(F.col("axis") != "user_info")
        .select("idhash", tokens("item").alias("phrase"))
        .filter(F.size("phrase") > 0)
        .distinct()
    )
    words = wanted.select("idhash", "phrase", F.posexplode("phrase").alias("offset", "word"))
    index = contexts.select("variant", "idhash", F.posexplode(tokens("context")).alias("at", "word"))
    starts = (
        index.join(words, ["idhash", "word"])
        .groupBy("variant", "idhash", "phrase", (F.col("at") - F.col("offset")).alias("start"))
        .agg(F.count("*").alias("met"))
        .filter(F.col("met") == F.size("phrase"))
    )
    found = starts.select("variant", "idhash", "phrase").distinct().groupBy("variant", "idhash").agg(F.count("*").alias("found"))
    totals = wanted.groupBy("idhash").agg(F.count("*").alias("n_items"))
    return (
        contexts.select("variant", "idhash")
        .distinct()
        .join(totals, "idhash")
        .join(found, ["variant", "idhash"], "left")
        .fillna(0, ["found"])
        .select("variant", "idhash", "n_items", "found", F.round(F.col("found") / F.col("n_items"), 6).alias("recall"))
    )


def item_recall_gap(recalls: DataFrame, full: str, structured: str) -> DataFrame:
    """Per user: what the structured memory recalls more or less than the full context; a missing context recalls nothing."""

    def of(variant: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("variant") == variant, F.col("found"))), F.lit(0)) / F.max("n_items")

    sides = recalls.filter(F.col("variant").isin(full, structured)).groupBy("idhash").agg(
        F.max("n_items").alias("n_items"), of(full).alias("_full"), of(structured).alias("_structured")
    )
    return sides.select(
        "idhash", "n_items", F.round("_full", 6).alias("full_recall"), F.round("_structured", 6).alias("structured_recall"),
        F.round(F.col("_structured") - F.col("_full"), 6).alias("gap"),
    )
