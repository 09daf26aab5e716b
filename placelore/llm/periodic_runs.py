"""Runs of repeated words: maximal stretches of a text that repeat a sequence of words at least four times.

A run is a stretch of consecutive words with smallest period q, at least ``max(SHORTEST, POWER * q)`` words long, that no neighbouring
word extends. They are found by internal pattern matching, for the texts of a block at once:

1. Prefix doubling gives the suffix array and, for every dyadic length, the interval of the array in which a block of that
   length occurs.
2. A wavelet tree (as a matrix of its levels) over the suffix array answers where a dyadic block occurs next, to the right and to
   the left: two range successors per block, all blocks together. A run of period q holds an aligned block of the length L between q
   and 2q (L > q), which returns exactly q words away on one side, as the occurrences inside a run are a progression with difference q.
3. Distances in [L / 2, L) are the candidate periods of that text; the stretches that have them are compared word by word.

Texts are divided by separators that occur once, so no match leaves its text. Work is n log n per block of texts, however often words
repeat; memory grows with the block or the longest text, about 4 log2(n) bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import id_and_text

POWER, SHORTEST = 4, 6
BLOCK = 60_000  # words looked at together (a longer text is a block of its own)
Run = tuple[int, int, int]  # start, length, period


class WaveletTree:
    """Order statistics of ranges of ``values`` (integers from 0), for arrays of queries."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.levels: list[tuple[int, int, np.ndarray]] = []  # shift, zeros, ones before each place
        for shift in range(self.bits - 1, -1, -1):
            ones = (values >> shift) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((shift, len(values) - int(before[-1]), before))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many of ``values[lo:hi]`` are below ``than`` (which occurs among the values)."""
        count = np.zeros(len(lo), np.int64)
        for shift, zeros, before in self.levels:
            ones_lo, ones_hi = before[lo], before[hi]
            right = (than >> shift) & 1 == 1
            count += np.where(right, (hi - ones_hi) - (lo - ones_lo), 0)
            lo = np.where(right, zeros + ones_lo, lo - ones_lo)
            hi = np.where(right, zeros + ones_hi, hi - ones_hi)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest (from 0) of ``values[lo:hi]``."""
        value = np.zeros(len(lo), np.int64)
        for shift, zeros, before in self.levels:
            ones_lo, ones_hi = before[lo], before[hi]
            left = (hi - ones_hi) - (lo - ones_lo)
            right = n >= left
            n = np.where(right, n - left, n)
            value |= right.astype(np.int64) << shift
            lo = np.where(right, zeros + ones_lo, lo - ones_lo)
            hi = np.where(right, zeros + ones_hi, hi - ones_hi)
        return value


def dyadic_blocks(words: np.ndarray, longest: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Suffix array of ``words`` (sorted by as many words as matter) and the repeated aligned blocks.

    A block is its place, its length (a power of two from 2 to ``longest``) and its interval of the suffix array.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(first)
    rank, size = np.empty(n, np.int64), np.empty(n, np.int64)
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    size[order] = np.repeat(sizes, sizes)
    slots = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # places of the suffix array not settled yet
    length, found = 1, []
    while len(slots) and 2 * length <= longest:
        at = order[slots]
        second = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        keys = rank[at] * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        at, keys = at[by], keys[by]
        order[slots] = at
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(at)))
        of = np.repeat(slots[starts], sizes)
        sizes = np.repeat(sizes, sizes)
        rank[at], size[at] = of, sizes
        length *= 2
        repeated = sizes > 1
        slots = slots[repeated]
        here = repeated & (at % length == 0)
        found.append((at[here], np.full(int(here.sum()), length), of[here], of[here] + sizes[here]))
    if not found:
        empty = np.empty(0, np.int64)
        return order, (empty,) * 4
    return order, tuple(np.concatenate(c) for c in zip(*found))


def candidates(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods at which a repeated aligned block returns within its own length."""
    order, (at, length, lo, hi) = dyadic_blocks(words, longest)
    if not len(at):
        return at, at
    tree = WaveletTree(order)
    below = tree.smaller(lo, hi, at)
    places, periods = [], []
    for step in (1, -1):
        valid = (below + step >= 0) & (below + step < hi - lo)
        there = tree.nth(lo[valid], hi[valid], below[valid] + step)
        distance = np.abs(there - at[valid])
        near = (2 * distance >= length[valid]) & (distance < length[valid])
        places.append(at[valid][near])
        periods.append(distance[near])
    return np.concatenate(places), np.concatenate(periods)


def stretches(words: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """Start and end of the maximal stretches with this period that are long enough for a run."""
    same = np.concatenate([[False], words[:-period] == words[period:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if stop + period - start >= max(SHORTEST, POWER * period):
            yield start, stop + period


def runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each text (a list of words) by start, then period."""
    number: dict[bytes, int] = {}
    parts, begins, total = [], [], 0
    separators = sum(map(len, texts))  # numbers from here on occur once
    for k, text in enumerate(texts):
        begins.append(total)
        part = np.empty(len(text) + 1, np.int64)
        part[:-1] = [number.setdefault(w, len(number)) for w in text]
        part[-1] = separators + k
        parts.append(part)
        total += len(part)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    if texts:
        longest = max(map(len, texts)) // 2
        at, periods = candidates(np.concatenate(parts), longest)
        of = np.searchsorted(begins, at, "right") - 1
        for k, period in sorted(set(zip(of.tolist(), periods.tolist()))):
            for stretch in stretches(parts[k], period):
                found[k].setdefault(stretch, period)  # smaller periods come first
    return [sorted((start, stop - start, period) for (start, stop), period in f.items()) for f in found]


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words outside the repetitions; of each run its first period stays."""
    if not found:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are left out): doc_id, runs (array of start, length, period in words,
    by start, then period) and ``collapsed``, the words that stay, joined by one space.

    Words are what stands between spaces and the characters 9 to 13. NULL and empty texts have no runs and collapse to ''; rows with equal or
    NULL doc_id are kept apart; an empty table gives an empty table. ``prepare`` may change the words of a row before they are looked at.
    """
    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                ids.append(i)
                texts.append(prepare(i, words) if prepare else words)
                size += len(words)
                if size >= BLOCK:
                    yield ids, texts
                    ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            found = runs(texts)
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            names = ("start", "length", "period")
            listed = pa.ListArray.from_arrays(
                pa.array(ends),
                pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=[pa.field(n, pa.int64()) for n in names]),
            )
            kept = [b" ".join(collapsed(w, f)) for w, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
            )

    return id_and_text(docs).mapInArrow(run, schema)


def longest_run(runs):
    """The run of greatest length, then smallest start, then smallest period; NULL without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)
