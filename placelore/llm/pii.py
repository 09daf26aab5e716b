"""Personal data and the terms that give it away, with DataFrame functions only.

Base: patterns of four kinds find the protected entities in every whole text.

Information-theoretic part: the corpus shows how strongly a term reveals an entity. With documents as events,
IC(e) = ln(N / n_e) is the information of entity e and PMI(e, t) = ln(N n_et / (n_e n_t)) what term t discloses
of it, where n_et counts documents that hold both anywhere in the text. The disclosed share PMI / IC is 1 when t occurs
only with e. An entity of fewer than ``SUPPORT`` documents is judged by its class (an e-mail's domain, the first three
parts of an address, the first six digits of a card or phone number), counted over all members of the class. A term whose share reaches
``DISCLOSURE`` for an entity or class, seen with it in ``SUPPORT`` documents or more, is generalised to its first letters
when that wider class of terms stays below the threshold, and else removed, wherever it stands in a document that mentions
the entity.

A term is a run of two letters or digits or more, whatever stands around it; its occurrences outside base spans count, in n_et
and in n_t alike. A document's distinct terms meet its distinct entities, so the work grows with the documents that hold personal
data; counts are aggregated on the map side before they are shuffled. Only pairs that reach the support and, with n_t taken from
the documents that may hold personal data, still the threshold, are counted over the whole corpus, inside its scan. Places
are made only for disclosing terms, in the documents that name their entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelore.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE, SUPPORT, PREFIX = 0.7, 3, 3

_LOCAL = "[A-Za-z0-9._%+-]"
#: The kinds' patterns, written so that every run of characters is tried once (possessive, and only from its start).
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
_TERM = r"[\p{L}\p{M}\p{N}]{2,}+"
#: A text without any of these holds no base span.
_HOLDS = r"@[A-Za-z0-9-]+[.][A-Za-z0-9-]|[0-9][.][0-9]+[.][0-9]+[.][0-9]|[0-9](?:[\x20-]?[0-9]){15}|\+[0-9][\x20().0-9-]+[0-9]"
#: Candidate terms are looked up in a broadcast table up to these sizes, and joined by a shuffle beyond.
BROADCAST_TERMS, BROADCAST_LETTERS = 200_000, 4_000_000


#: Cheap conditions without which a pattern cannot match.
GUARDS = {"email": "@", "ip": "[0-9][.]", "card": "[0-9]", "phone": "[+]"}


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
        .when(kind == "card", card)
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; written once, since numbers of rows may differ from one evaluation to the next.

    The text is kept only where it may hold a base span (else NULL).
    """
    return stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.when(F.regexp("text", F.lit(_HOLDS)), F.col("text")).alias("text"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _matches(numbered: DataFrame) -> DataFrame:
    """row, kind, and the matches of that kind in order: number, value, code points before it since the last.

    Each text is looked at once per kind by one small expression whose pattern is a column; one large expression of
    all kinds makes the compiler of the JVM take more memory than the data.
    """
    kinds = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.lit(GUARDS[k]).alias("guard")) for k, p in PATTERNS.items()])
    )
    whole = numbered.filter("text is not null").select("row", "text", kinds.alias("k")).select("row", "text", "k.*")
    # the text is cut at the matches; only where that gives more than one piece the matches are taken out too
    cut = whole.filter(F.regexp("text", F.col("guard"))).withColumn("pieces", F.split("text", F.col("pattern"), -1))
    took = cut.filter(F.size("pieces") > 1).withColumn("values", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))

    def one(value: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), value.alias("value"), F.length(F.get("pieces", i)).alias("gap"))

    return took.select("row", "kind", F.transform("values", one).alias("matches"))


def _mentions(matches: DataFrame) -> DataFrame:
    """Valid mentions: row, kind, entity, start, end. Places come from the lengths of what lies before."""
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = matches.select("row", "kind", F.explode("matches").alias("m")).select("row", "kind", "m.*")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(so_far))
    entity = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value"))
    return stored(
        placed.filter(_valid(F.col("kind"), F.col("value"))).select(
            "row", "kind", F.concat("kind", F.lit(":"), entity).alias("entity"),
            (F.col("end") - F.length("value")).alias("start"), "end",
        )
    )


def _entities(mentions: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """Distinct row, entity: those to count (entities and classes of enough documents), and those that judge each row."""
    value = F.substring_index("entity", ":", -1)
    wide = (
        F.when(F.col("kind") == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
        .when(F.col("kind") == "ip", F.concat(F.lit("net:"), F.substring_index(value, ".", 3)))
        .otherwise(F.concat("kind", F.lit("-prefix:"), F.substring(value, 1, 6)))
    )
    each = mentions.select("row", "entity", wide.alias("class")).distinct()
    enough = each.groupBy("entity").agg((F.count(F.lit(1)) >= support).alias("enough"))
    known = stored(each.join(enough, "entity"))
    classes = known.select("row", F.col("class").alias("entity")).distinct()
    common = classes.groupBy("entity").count().filter(F.col("count") >= support).select("entity")
    own = known.filter("enough").select("row", "entity")
    judging = own.union(known.filter("not enough").select("row", F.col("class").alias("entity"))).distinct()
    return stored(own.union(classes.join(common, "entity").select("row", "entity"))), judging


def _terms_of(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """row, term, start, end of every term of ``texts`` (row, text) that touches no base span."""
    spans = mentions.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = texts.join(spans, "row", "left").select(
        "row", "spans", F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)).alias("terms"), F.split("text", _TERM, -1).alias("gaps")
    ).filter(F.size("terms") > 0)
    each = found.select("row", "spans", F.posexplode(F.arrays_zip(F.col("terms").alias("term"), F.col("gaps").alias("gap"))).alias("i", "t"))
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("row", "spans", "i", "t.term", "t.gap").filter("term is not null").withColumn(
        "end", F.sum(F.length("gap") + F.length("term")).over(so_far)
    ).withColumn("start", F.col("end") - F.length("term"))
    inside = F.exists("spans", lambda m: (m["start"] < F.col("end")) & (m["end"] > F.col("start")))
    outside = F.col("spans").isNull() | ~inside
    return placed.filter(outside).select("row", F.lower("term").alias("term"), "start", "end")


def _general(term: Column) -> Column:
    return F.concat(F.substring(term, 1, PREFIX), F.lit("*"))


def _with_classes(terms: Column) -> Column:
    return F.array_distinct(F.concat(terms, F.transform(terms, _general)))


def _of_bounded_size(terms: DataFrame) -> DataFrame:
    """Broadcast hint when the stored ``terms`` stay below the bounds in rows and letters, else unchanged."""
    rows, letters = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    return F.broadcast(terms) if rows <= BROADCAST_TERMS and letters <= BROADCAST_LETTERS else terms


def _frequencies(held: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """term, n_t: rows whose ``terms``, with their generalisations, hold the term."""
    each = held.select(F.explode(_with_classes(F.col("terms"))).alias("term"))
    if candidates is not None:
        each = each.join(candidates, "term", "left_semi")
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosing_terms(
    docs: DataFrame, entities: DataFrame, held: DataFrame, total: int, disclosure: float = DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """entity, term, share, action (generalise or remove), replacement of the terms that reach the threshold.

    ``held`` (row, terms) are the distinct terms of the documents that may hold personal data; all others are read from ``docs``.
    """
    seen = held.join(entities, "row").select("entity", F.explode(_with_classes(F.col("terms"))).alias("term"))
    together = seen.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    alone = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") < total)
    information = F.log(F.lit(float(total)) / F.col("n_e"))
    share = 1 - F.log(F.col("n_t") / F.col("n_et")) / information
    # documents that may hold personal data give a lower bound of n_t, so an upper bound of the share
    possible = stored(
        together.join(alone, "entity")
        .join(_frequencies(held).withColumnRenamed("n_t", "_some"), "term")
        .filter(1 - F.log(F.col("_some") / F.col("n_et")) / information >= disclosure)
    )
    candidates = _of_bounded_size(stored(possible.select("term", F.col("_some").alias("n_t")).distinct()))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower))
    others = docs.filter(~F.regexp("text", F.lit(_HOLDS))).select(words.alias("terms"))  # NULL texts drop out
    counts = candidates.unionByName(_frequencies(others, candidates.select("term"))).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    shares = stored(
        possible.join(counts, "term").select("entity", "term", share.alias("share")).filter(F.col("share") >= disclosure)
    )
    wide = shares.select("entity", F.col("term").alias("class"), F.lit(True).alias("_wide"))
    return (
        shares.filter(~F.col("term").endswith("*"))
        .withColumn("class", _general(F.col("term")))
        .join(wide, ["entity", "class"], "left")
        .select(
            "entity", "term", "share",
            F.when(F.col("_wide"), "remove").otherwise("generalise").alias("action"),
            F.when(F.col("_wide"), "").otherwise(F.col("class")).alias("replacement"),
        )
    )


def find(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, spans (array of kind_no, start, end, kind, replacement in order) for every row of ``docs``.

    Places are code points, ends exclusive. Base spans of different kinds may overlap; term spans never touch
    a base span's text. NULL and empty texts have no spans. Rows that repeat a doc_id each get their own result and
    count as documents of their own; a NULL doc_id is carried along; an empty table gives an empty table; other columns are
    not read.
    """
    numbered = _numbered(docs)
    total = numbered.count()
    mentions = _mentions(_matches(numbered))
    counted, judging = _entities(mentions, support)
    texts = numbered.filter("text is not null").select("row", "text")
    held = stored(_terms_of(texts, mentions).groupBy("row").agg(F.collect_set("term").alias("terms")))
    telling = disclosing_terms(docs.select("text"), counted, held, max(total, 1), disclosure, support)
    judged = judging.join(telling.select("entity", "term", "replacement"), "entity")
    named = stored(judged.groupBy("row", "term").agg(F.min("replacement").alias("replacement")))  # removal, the empty string, wins
    terms = (
        _terms_of(texts.join(named.select("row").distinct(), "row", "left_semi"), mentions)
        .join(named, ["row", "term"])
        .select("row", F.lit("term").alias("kind"), "start", "end", "replacement")
    )
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    base = mentions.select("row", "kind", "start", "end", F.concat(F.lit("["), "kind", F.lit("]")).alias("replacement"))
    spans = (
        base.unionByName(terms)
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct(number.alias("kind_no"), "start", "end", "kind", "replacement"))).alias("spans"))
    )
    empty = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint,kind:string,replacement:string>>")
    return numbered.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "term")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """All columns of ``docs``, with the spans of ``found`` (joined by doc_id) replaced in ``text``.

    Of overlapping spans the one that starts first (then the longer) is replaced together with what the others add.
    """
    ordered = F.array_sort(
        F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["replacement"].alias("new")))
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        until = -s["until"]
        between = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.concat(state["out"], between, s["new"])
        return F.struct(
            F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], until).alias("at"),
        )

    def close(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    spans = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    spans = spans.dropDuplicates(["_id"])
    joined = docs.join(spans, docs["doc_id"] == F.col("_id"), "left")
    clean = F.when(F.col("_spans").isNull() | text.isNull(), text).otherwise(F.aggregate(ordered, start, step, close))
    return joined.select(*[clean.alias(c) if c == "text" else docs[c] for c in docs.columns])
