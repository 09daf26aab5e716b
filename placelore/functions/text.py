"""String, path and token expressions. Everything here is a JVM-side Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = " > "
# A token is a run of word characters or one other non-space character. The
# leading blanks belong to the token, so joining tokens gives the text back.
TOKEN = r"\w+|[^\w\s]"
TOKEN_WITH_BLANKS = r"\s*(?:\w+|[^\w\s])"


def category_at(path: Column | str, level: int = 1) -> Column:
    """Trimmed segment of a ``a > b > c`` path; NULL when the path is shorter."""
    return F.trim(F.get(F.split(path, ">"), F.lit(level)))


def leaf_category(path: Column | str) -> Column:
    return F.trim(F.element_at(F.split(path, ">"), -1))


def path_segments(path: Column | str) -> Column:
    """Trimmed, non-blank segments."""
    parts = F.transform(F.split(path, ">"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def normalize_path(path: Column | str) -> Column:
    return F.array_join(path_segments(path), SEP)


def path_level(path: Column | str) -> Column:
    return F.size(F.split(path, SEP))


def path_parent(path: Column | str) -> Column:
    """Parent path; NULL for the root."""
    parts = F.split(path, SEP)
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), SEP)
    )


def path_prefix(path: Column | str, level: int) -> Column:
    return F.array_join(F.slice(F.split(path, SEP), 1, level), SEP)


def token_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def token_prefix(text: Column | str, n: Column | int) -> Column:
    """Text up to and including its ``n``-th token (unchanged when it has fewer)."""
    n = F.lit(n) if isinstance(n, int) else n
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_WITH_BLANKS), F.lit(0))
    return F.when(token_count(text) <= n, F.col(text) if isinstance(text, str) else text).otherwise(
        F.array_join(F.slice(tokens, F.lit(1), n.cast("int")), "")
    )


def ordered_concat(order: list[str], text: str, sep: str) -> Column:
    """Aggregate: join ``text`` in the order of ``order`` (ascending).

    Only for groups whose size is bounded by construction; say by what at the call.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), sep)


def has_text(col: Column | str) -> Column:
    """True when not NULL and not blank; never NULL."""
    return F.coalesce(F.trim(col) != "", F.lit(False))


def is_json(col: Column | str) -> Column:
    """True when the whole text is one JSON value.

    The parser stops after the first value, so the text is wrapped in an array to notice the rest.
    """
    text = F.col(col) if isinstance(col, str) else col
    members = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    return F.coalesce(F.size(members) == 1, F.lit(False))


def strip(col: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")
