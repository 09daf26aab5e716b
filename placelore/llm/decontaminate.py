"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased letter-and-digit words. Runs of ``seed`` words that a document
shares with an item are the seeds of the join. For each (document, item) pair with seeds, running
Karp-Rabin searches for matches of a length that is lowered step by step; the longest matches are marked first (of
equals the earlier in the item, then in the text) and never overlap. The share of the item's words under tiles of at
least ``seed`` words is its coverage; as tiles may stand in any order, reordered passages are caught.

While the benchmark has at most ``LOCAL_WORDS`` words it travels with the tasks and documents are read once,
without a shuffle. A larger benchmark is joined by the hashes of its seeds instead, with the same results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import CACHE_ENTRIES, distinct, longs, shingles, stored, word_hashes

SEED, COVERAGE = 5, 0.8
LOCAL_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _runs(tokens: list, marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Unmarked stretches of at least ``length`` tokens; None separates stretches of a document."""
    start = 0
    for i in range(len(tokens) + 1):
        if i == len(tokens) or marked[i] or tokens[i] is None:
            if i - start >= length:
                yield start, i
            start = i + 1


def _rolling(tokens: list, start: int, end: int, length: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of each window."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top, value = pow(base, length - 1, modulus), 0
    for i in range(start, end):
        if i >= start + length:
            value = (value - hash_of(tokens[i - length]) * top) % modulus
        value = (value * base + hash_of(tokens[i])) % modulus
        if i >= start + length - 1:
            yield i - length + 1, value


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[token] = int(word_hashes([token.encode()])[0]) >> 3
        return value


_HASHES = _Hashes()
hash_of = _HASHES.__getitem__


def tiles(item: list[str], text: list, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length); None in ``text`` matches nothing.

    The longest free match is marked first, of equals the one that starts earlier in the item, then in the text.
    """
    item_marked, text_marked = [False] * len(item), [False] * len(text)
    out: list[tuple[int, int, int]] = []
    length = max(seed, len(item))
    while True:
        index = defaultdict(list)
        for start, end in _runs(item, item_marked, length):
            for at, value in _rolling(item, start, end, length):
                index[value].append(at)
        found: list[tuple[int, int, int]] = []
        if index:
            for start, end in _runs(text, text_marked, length):
                for at, value in _rolling(text, start, end, length):
                    for i in index.get(value, ()):
                        if i and at and item[i - 1] == text[at - 1] and not (item_marked[i - 1] or text_marked[at - 1]):
                            continue  # part of a match that starts earlier
                        n = 0
                        while (
                            i + n < len(item) and at + n < len(text) and item[i + n] == text[at + n]
                            and not item_marked[i + n] and not text_marked[at + n]
                        ):
                            n += 1
                        if n >= length:
                            found.append((n, i, at))
        # the longest free match comes next; what is left of one that meets a tile goes back into the queue
        queue = [(-n, i, at) for n, i, at in found]
        heapify(queue)
        while queue:
            n, i, at = heappop(queue)
            free = [not (item_marked[i + k] or text_marked[at + k]) for k in range(-n)]
            if all(free):
                item_marked[i : i - n] = text_marked[at : at - n] = [True] * -n
                out.append((i, at, -n))
                continue
            k = 0
            for is_free, part in groupby(free):
                size = len(list(part))
                if is_free and size >= length:
                    heappush(queue, (-size, i + k, at + k))
                k += size
        if length == seed:
            return out
        length = max(seed, length // 2)


def coverage(item: list[str], text: list, seed: int = SEED) -> float:
    """Share of the item's words under tiles; items shorter than ``seed`` words count when found whole."""
    if not item:
        return 0.0
    return sum(n for _, _, n in tiles(item, text, min(seed, len(item)))) / len(item)


def _seed_hashes(words: list[str], seed: int) -> np.ndarray:
    return shingles(word_hashes([w.encode() for w in words]), min(seed, len(words))) if words else np.empty(0, np.uint64)


class _Vocabulary(dict):
    """Hashes of the benchmark's words, 0 for others."""

    def __missing__(self, word: str) -> int:
        return 0


class _Local:
    """The whole benchmark inside a task."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int):
        self.seed, self.items = seed, dict(items)
        index = defaultdict(set)
        self.lengths = sorted({min(seed, len(w)) for _, w in items if w})
        for key, words in items:
            for h in _seed_hashes(words, seed).tolist():
                index[h].add(key)
        self.index = index
        self.known = {n: distinct(np.concatenate([_seed_hashes(w, seed) for _, w in items if min(seed, len(w)) == n])) for n in self.lengths}
        self.vocabulary = _Vocabulary()
        for _, words in items:
            self.vocabulary.update(zip(words, word_hashes([w.encode() for w in words]).tolist()))

    def best(self, text: str | None) -> tuple[float, int | None]:
        """Largest coverage of any item and that item (smallest id of equals)."""
        words = words_of(text)
        hashes = np.fromiter(map(self.vocabulary.__getitem__, words), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(hashes != 0)])
        result: tuple[float, int | None] = (0.0, None)
        candidates: dict[int, set[int]] = defaultdict(set)
        for n in self.lengths:
            if len(words) < n or known[-1] < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of known words only
            if not len(at):
                continue
            windows = shingles(hashes, n)[at]
            known_at = self.known[n]
            place = np.minimum(np.searchsorted(known_at, windows), len(known_at) - 1)
            for j in np.flatnonzero(known_at[place] == windows):
                for key in self.index[int(windows[j])]:
                    candidates[key].update(range(int(at[j]), int(at[j]) + n))
        for key in sorted(candidates):
            value = coverage(self.items[key], _cut(words, candidates[key]), self.seed)
            if value > result[0]:
                result = (value, key)
        return result


def _cut(words: list[str], places: set[int]) -> list:
    """Only the words at ``places``, stretches separated by None: no tile can lie elsewhere."""
    out, before = [], None
    for p in sorted(places):
        if before is not None and p != before + 1:
            out.append(None)
        out.append(words[p])
        before = p
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    seed: int = SEED,
    local_words: int = LOCAL_WORDS,
    names: tuple[str, str] = ("coverage", "item_id"),
) -> DataFrame:
    """All columns of ``docs`` with coverage (double, largest over the items) and item_id (that item; NULL without any seed).

    Of equally covered items the smallest item_id is named. NULL and empty texts have coverage 0; NULL and empty
    items, and items without id, are not tested. Columns of ``docs`` named as the two new ones are replaced; repeated
    rows get equal results, and an empty table gives an empty table.
    """
    kept = docs.drop(*names)
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(
        F.length(F.coalesce("text", F.lit(""))) > 0
    )
    schema = kept.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(None).cast("bigint")}).schema
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))), F.sum(F.length("text"))).first()
    if (size[0] or 0) > local_words or (size[1] or 0) > 20 * local_words:
        return _contamination_joined(kept, items, seed, names)
    local = _Local([(r["item_id"], words_of(r["text"])) for r in items.orderBy("item_id").collect()], seed)
    shared = kept.sparkSession.sparkContext.broadcast((list(local.items.items()), seed))
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _Local(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = [tool.best(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c for c, _ in found], pa.float64()), pa.array([i for _, i in found], pa.int64())],
                    [*part.schema.names, *names],
                )

    return kept.mapInArrow(run, schema)


def _contamination_joined(docs: DataFrame, items: DataFrame, seed: int, names: tuple[str, str]) -> DataFrame:
    """The same by a shuffled join on seed hashes, for a benchmark of any size.

    Words of one document that seed one item are gathered per pair; they are part of the document's text.
    """
    lengths = [r[0] for r in stored(items.mapInArrow(_lengths(seed), "n int").distinct()).collect()]  # at most ``seed`` numbers
    index = stored(items.mapInArrow(_item_seeds(seed), "hash long, item_id long").distinct())
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    places = rows.select("_row", "text").mapInArrow(_text_seeds(lengths), "_row long, hash long, at int, n int")
    hits = places.join(index, "hash").groupBy("_row", "item_id").agg(
        F.collect_list(F.struct("at", "n")).alias("places")
    )
    pairs = hits.join(rows.select("_row", "text"), "_row").join(
        items.select("item_id", F.col("text").alias("item")), "item_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, item, where in zip(*(batch.column(c).to_pylist() for c in ("text", "item", "places"))):
                at = {p["at"] + j for p in where for j in range(p["n"])}
                out.append(coverage(words_of(item), _cut(words_of(text), at), seed))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("item_id"), pa.array(out, pa.float64())], ["_row", "item_id", "coverage"]
            )

    best = (
        pairs.mapInArrow(run, "_row long, item_id long, coverage double")
        .groupBy("_row")
        .agg(F.max(F.struct("coverage", (-F.col("item_id")).alias("k"))).alias("b"))
        .select("_row", F.col("b.coverage").alias(names[0]), (-F.col("b.k")).alias(names[1]))
    )
    return rows.join(best, "_row", "left").withColumn(names[0], F.coalesce(names[0], F.lit(0.0))).drop("_row")


def _lengths(seed: int):
    def run(batches):
        for batch in batches:
            n = [min(seed, len(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in n if x], pa.int32())], ["n"])

    return run


def _item_seeds(seed: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                h = longs(_seed_hashes(words_of(text), seed))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([key] * len(h), pa.int64())], ["hash", "item_id"])

    return run


def _text_seeds(lengths: list[int]):
    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist()):
                hashes = word_hashes([w.encode() for w in words_of(text)])
                for n in lengths:
                    h = longs(shingles(hashes, n))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(h), row), pa.int64()), pa.array(h, pa.int64()),
                            pa.array(np.arange(len(h)), pa.int32()), pa.array(np.full(len(h), n), pa.int32()),
                        ],
                        ["_row", "hash", "at", "n"],
                    )

    return run
