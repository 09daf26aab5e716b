"""Evidence texts and prompts per user, and parsing of what a model returned for them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore.functions import skew
from placelore.functions.dimension import places_of
from placelore.functions.text import category_at, has_text, is_json, ordered_concat, token_count

# Block tags of merged daily texts and the header of review-based items.
IMPLICIT_TAG, EXPLICIT_TAG = "[implicit data]", "[explicit data]"
EXPLICIT_HEADER = "사용자의 리뷰 기반 페르소나 분석 결과"
SPARSE_UP_TO = 4


# -- daily texts --------------------------------------------------------------------------


def daily_behavior_text(clicks: DataFrame, poi: DataFrame) -> DataFrame:
    """One line per visited category with its count, per user and day; bounded by the category list."""
    per_poi = clicks.groupBy("idhash", "datestr", "sid").agg(F.count("*").alias("n"))
    counts = (
        per_poi.join(places_of(poi).select("sid", "category_path"), "sid")
        .groupBy("idhash", "datestr", "category_path")
        .agg(F.sum("n").alias("n"))
    )
    line = F.concat(F.lit("- "), "category_path", F.lit(": "), F.col("n").cast("string"))
    return (
        counts.withColumn("line", line)
        .groupBy("idhash", "datestr")
        .agg(ordered_concat(["category_path"], "line", "\n").alias("text"))
    )


def daily_review_text(reviews: DataFrame) -> DataFrame:
    """Dated header and the distinct review keywords of a user's day; bounded by the keyword list."""
    words = reviews.select("idhash", F.col("created_date").alias("datestr"), F.explode(F.flatten("codes")).alias("word"))
    return (
        words.distinct()
        .withColumn("line", F.concat(F.lit("- "), "word"))
        .groupBy("idhash", "datestr")
        .agg(ordered_concat(["word"], "line", "\n").alias("_lines"))
        .select("idhash", "datestr", F.concat(explicit_header("datestr"), F.lit("\n"), "_lines").alias("text"))
    )


def explicit_header(day: str) -> Column:
    return F.concat(F.lit(f"{EXPLICIT_HEADER} ("), F.date_format(day, "yyyy-MM-dd"), F.lit("):"))


def daily_text(
    implicit: DataFrame, explicit: DataFrame, implicit_only: bool = False, explicit_only: bool = False
) -> DataFrame:
    """Both streams of a (user, day): tagged blocks when both exist, the bare text otherwise."""
    if explicit_only:
        implicit = implicit.limit(0)
    if implicit_only:
        explicit = explicit.limit(0)
    i, e = F.col("_implicit"), F.col("_explicit")
    both = implicit.select("idhash", "datestr", F.col("text").alias("_implicit")).join(
        explicit.select("idhash", "datestr", F.col("text").alias("_explicit")), ["idhash", "datestr"], "full_outer"
    )
    merged = F.concat(F.lit(f"{IMPLICIT_TAG}\n"), i, F.lit(f"\n\n{EXPLICIT_TAG}\n"), e)
    return both.select("idhash", "datestr", F.coalesce(merged, i, e).alias("text"))


def full_text(texts: DataFrame) -> DataFrame:
    """A user's daily texts in date order; one text per day, so bounded by the days of the window."""
    return texts.groupBy("idhash").agg(ordered_concat(["datestr"], "text", "\n").alias("text"))


# -- prompts ------------------------------------------------------------------------------


def implicit_prompt(clicks: DataFrame, saves: DataFrame, demo_texts: DataFrame, rows_per_prompt: int = 1000) -> DataFrame:
    """Demographic header and time-sorted clicks and saves per user and day.

    ``clicks`` and ``saves`` are the enriched logs (``enrich_clicks``, ``enrich_saves``). A day of more than
    ``rows_per_prompt`` rows is continued in further parts, cut by one numbering over both kinds, so parts follow
    each other in time, no prompt grows with the log and every row is in exactly one part. Users
    without clicks on a day get no prompt for it.
    """
    time = F.date_format("etimestamp", "HH:mm:ss")

    def lines(log: DataFrame, kind: str, *parts: str | Column) -> DataFrame:
        return log.select(
            "idhash", "datestr", "etimestamp", "event_id", F.lit(kind).alias("kind"), F.concat_ws(" ", time, *parts).alias("line")
        )

    def bracketed(name: str) -> Column:
        return F.concat(F.lit("<"), name, F.lit(">"))

    click_days = clicks.select("idhash", "datestr").distinct()
    saved = saves.join(click_days, ["idhash", "datestr"], "left_semi")
    query = F.when(has_text("query"), F.col("query"))
    rows = lines(
        clicks, "click", "day_name", "title", bracketed("top_category"), "region", "review_top_display", query
    ).unionByName(lines(saved, "save", "title", bracketed("category")))
    numbered = skew.row_number(
        rows,
        ["idhash", "datestr"],
        [F.col("etimestamp"), F.col("event_id"), F.col("kind")],
        [(F.date_trunc("hour", "etimestamp"), False)],
        "rn",
    )
    part = F.floor((F.col("rn") - 1) / rows_per_prompt).cast("bigint")

    def block(kind: str) -> Column:
        member = F.when(F.col("kind") == kind, F.struct("rn", "line"))
        ordered = F.array_sort(F.collect_list(member))
        return F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")

    text = F.concat(F.lit("[clicks]\n"), block("click"), F.lit("\n[saves]\n"), block("save"))
    header = F.coalesce(F.concat("demo_text", F.lit("\n")), F.lit(""))
    return (
        numbered.withColumn("part", part)
        .groupBy("idhash", "datestr", "part")
        .agg(text.alias("_text"))
        .join(demo_texts, "idhash", "left")
        .select("idhash", "datestr", "part", F.concat(header, "_text").alias("prompt"))
    )


# Columns of a preprocessed review that a prompt shows, in this order (fixed values).
PROMPT_COLUMNS = [
    "row", "write_date_time", "visit_date_time", "visit_day", "place_name", "address", "category_path", "text_review", "keyword_list",
]


def explicit_prompt(
    rows: DataFrame, template: str, few_shot_rich: str, few_shot_sparse: str, chunk_size: int = 50
) -> DataFrame:
    """One prompt per user and chunk of preprocessed reviews (``review_rows``), newest first, then by place name; whole texts.

    The template has the fields ``{few_shot}``, ``{demographic_prompt}`` and
    ``{user_prompt}``. Sparse examples are chosen by the user's total number of reviews.
    """
    order = [F.col("write_date_time").desc(), F.col("place_name").desc(), F.col("row")]
    numbered = skew.row_number(rows, ["idhash"], order, [(F.col("write_date_time"), True)], "rn")
    totals = rows.groupBy("idhash").agg(F.count("*").alias("n_reviews"))
    line = F.concat_ws(" | ", *[F.col(c).cast("string") for c in PROMPT_COLUMNS])
    grouped = (
        numbered.withColumn("chunk", F.floor((F.col("rn") - 1) / chunk_size).cast("bigint"))
        .withColumn("line", line)
        .groupBy("idhash", "chunk")
        .agg(F.max("demo_text").alias("demo_text"), ordered_concat(["rn"], "line", "\n").alias("_rows"))
        .join(totals, "idhash")
    )
    few_shot = F.when(F.col("n_reviews") <= SPARSE_UP_TO, few_shot_sparse).otherwise(few_shot_rich)
    fields = {
        "few_shot": few_shot,
        "demographic_prompt": F.coalesce("demo_text", F.lit("")),
        "user_prompt": F.col("_rows"),
    }
    return grouped.select("idhash", "chunk", fill_template(template, fields).alias("prompt"))


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """Literal pieces and fields concatenated, so that braces inside a field are left alone."""
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{%s}" % name), name) for name in fields]
        at, name = min(((i, n) for i, n in found if i >= 0), default=(-1, ""))
        if at < 0:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[:at]), fields[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


# -- responses ----------------------------------------------------------------------------


def explicit_parse(responses: DataFrame) -> DataFrame:
    """``- item`` lines under a dated header from extraction responses.

    JSON list first, then a list inside other text, else the raw text; valid JSON that is
    not a list with ``User_Info`` members also falls back to the raw text. Empty responses drop.
    """
    raw = F.col("raw")
    bracketed = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    source = F.when(is_json("raw"), raw).when(is_json(bracketed), bracketed)
    members = F.from_json(F.when(F.ltrim(source).startswith("["), source), "array<string>")
    infos = F.filter(F.transform(members, lambda m: F.get_json_object(m, "$.User_Info")), lambda s: s.isNotNull())
    lines = F.array_join(F.transform(infos, lambda s: F.concat(F.lit("- "), s)), "\n")
    text = F.when(F.size(infos) > 0, F.concat(explicit_header("datestr"), F.lit("\n"), lines)).otherwise(raw)
    return responses.filter(F.length("raw") > 0).withColumn("text", text).drop("raw")


def token_usage(messages: DataFrame, price_prompt: float, price_completion: float) -> DataFrame:
    """Calls, tokens and cost per user and day; prices are per million tokens."""
    sums = messages.groupBy("idhash", "datestr").agg(
        F.count("prompt").alias("calls"),
        F.coalesce(F.sum(token_count("prompt")), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(token_count("completion")), F.lit(0)).alias("completion_tokens"),
    )
    cost = (F.col("prompt_tokens") * price_prompt + F.col("completion_tokens") * price_completion) / 1e6
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn(
        "cost", F.round(cost, 6)
    )


# -- condensed evidence -------------------------------------------------------------------


def behavior_clusters(clicks: DataFrame, poi: DataFrame, n_examples: int = 3) -> DataFrame:
    """Events grouped by category with the most visited places as representatives.

    ``reduction`` is how many events one representative stands for.
    """
    per_poi = (
        clicks.groupBy("idhash", "sid")
        .agg(F.count("*").alias("n"))
        .join(places_of(poi).select("sid", "title", category_at("category_path").alias("category")), "sid")
        .filter(F.col("category").isNotNull())
    )
    totals = per_poi.groupBy("idhash", "category").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_places"))
    best = skew.top_per_key(per_poi, ["idhash", "category"], [F.col("n").desc(), F.col("sid")], n_examples, "rank")
    examples = (
        best.withColumn("line", F.concat("title", F.lit(" x"), F.col("n").cast("string")))
        .groupBy("idhash", "category")
        .agg(ordered_concat(["rank"], "line", ", ").alias("examples"), F.count("*").alias("_n"))
    )
    return totals.join(examples, ["idhash", "category"]).select(
        "idhash",
        "category",
        "n_events",
        "n_places",
        "examples",
        F.round(F.col("n_events") / F.col("_n"), 6).alias("reduction"),
    )


def implicit_persona(
    clicks: DataFrame, poi: DataFrame, start: date, end: date, length: int = 21, step: int = 7
) -> DataFrame:
    """Domain-partitioned evidence text per user.

    Each sliding window gives a statement per domain; a domain keeps the statement of its
    newest window, newest first. One line per domain, so bounded by the category list.
    """
    domains = (
        clicks.groupBy("idhash", "datestr", "sid")
        .agg(F.count("*").alias("n"))
        .join(places_of(poi).select("sid", category_at("category_path").alias("domain")), "sid")
        .filter(F.col("domain").isNotNull())
        .groupBy("idhash", "datestr", "domain")
        .agg(F.sum("n").alias("n"))
    )
    starts = F.sequence(F.lit(start), F.lit(end), F.make_interval(days=F.lit(step)))
    covering = F.filter(starts, lambda s: (s <= F.col("datestr")) & (F.col("datestr") <= F.date_add(s, length - 1)))
    windows = (
        domains.select("idhash", "domain", "datestr", "n", F.explode(covering).alias("window_start"))
        .groupBy("idhash", "domain", "window_start")
        .agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.max("datestr").alias("last_day"))
    )
    newest = skew.top_per_key(windows, ["idhash", "domain"], [F.col("window_start").desc()], 1)
    line = F.concat(
        F.lit("["), "domain", F.lit("] "), F.col("n").cast("string"), F.lit(" events on "), F.col("days").cast("string"),
        F.lit(" days, last "), F.col("last_day").cast("string"),
    )
    ordered = newest.select("idhash", "domain", line.alias("line"), F.datediff(F.lit(end), "window_start").alias("age"))
    return ordered.groupBy("idhash").agg(ordered_concat(["age", "domain"], "line", "\n").alias("text"))


def normalize_item(item: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(item), r"\s+", " "))


def item_dedup(items: DataFrame, order: list[Column]) -> DataFrame:
    """First seen row per user and hash of the normalized item."""
    hashed = items.withColumn("item_hash", F.sha2(normalize_item("item"), 256))
    return skew.top_per_key(hashed, ["idhash", "item_hash"], order, 1)


def distill_pairs(prompts: DataFrame, responses: DataFrame, keys: list[str], eval_percent: int = 10) -> DataFrame:
    """Training pairs: prompts with their non-empty response, equal pairs once, split by hash.

    ``prompts`` has the keys and ``prompt``, ``responses`` the keys and ``response``. Of equal pairs the one with the
    smallest keys stays. The split depends on the pair alone, so it is the same in every run.
    """
    pairs = prompts.join(responses, keys).filter(has_text("prompt") & has_text("response"))
    hashed = pairs.select(*keys, "prompt", "response", F.sha2(F.concat(F.sha2("prompt", 256), F.sha2("response", 256)), 256).alias("pair_hash"))
    first = hashed.groupBy("pair_hash").agg(F.min(F.struct(*keys, "prompt", "response")).alias("p")).select("pair_hash", "p.*")
    slot = F.conv(F.substring("pair_hash", 1, 8), 16, 10).cast("bigint") % 100
    return first.withColumn("split", F.when(slot < eval_percent, "eval").otherwise("train"))
