"""Repeated passages: count-min prefilter over windows, then exact grouping of windows estimated repeated.

A window is a run of ``window`` words. Equal windows choose the same anchor inside them, the smallest hash among
their runs of ``ANCHOR`` words, so an anchor occurs at least as often as any window it stands for, and there are
several times fewer anchors than windows.

0. A document whose whole text an earlier document has is a repeat from its first to its last window. Such copies are
   found by the digest of the text and take no part in what follows.
1. Every task sketches its anchors; the merged sketch overestimates their counts and so those of the windows. It
   is kept as one bit per counter (counted twice or more), whose size does not depend on the input.
2. A second pass emits the windows whose anchor is estimated repeated, as one segment per anchor: windows in
   a row that share the anchor. No window that occurs twice is lost; when the sketch fills up, more segments are
   emitted, and the result stays the same.
3. Segments are grouped exactly. Of equal segments all but the first are repeats as a whole. Only where an anchor has
   different segments (the edges of copied passages) one of each kind is taken apart into windows, which are grouped by
   their own hash.
4. The repeated stretches return to their document, whose covered words are removed.

Grouping is by map-side combined aggregates and a join on the key, so a passage that occurs in a third of all
documents does not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm import sketch
from placelore.llm.common import broadcast_if_at_most, id_and_text, longs, mix, shingles, stored, word_hashes

WINDOW, ANCHOR = 20, 8
BITS, DEPTH = 27, 3  # one bit per counter: 3 x 16 MB
BROADCAST_IDS = 1_000_000  # ids of 8 bytes; beyond that joins are shuffled
PART = 256  # documents handled at once by a task


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Place of the anchor of each window (its leftmost smallest run), and the run hashes."""
    k = min(ANCHOR, window)
    runs = shingles(hashes, k)
    span = window - k + 1
    if len(runs) < span:
        return np.empty(0, np.int64), runs
    inside = np.lib.stride_tricks.sliding_window_view(runs, span)
    return inside.argmin(axis=1) + np.arange(len(inside)), runs


def _anchor_keys(window: int):
    def keys(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.empty(0, np.uint64)]
        for text in batch.column("text").to_pylist():
            at, runs = anchors(word_hashes(text.split()), window)
            out.append(runs[at[np.flatnonzero(np.diff(at, prepend=-1))]])
        return mix(np.concatenate(out))

    return keys


def _repeated(rows: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether all counters of a key are marked; ``rows`` hold one bit per counter."""
    found = np.ones(len(keys), bool)
    bits = (8 * len(rows[0])).bit_length() - 1
    for row in range(DEPTH):
        at = sketch.positions(keys, row, bits)
        found &= (rows[row][at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))) & 1).astype(bool)
    return found


SEGMENTS = pa.list_(
    pa.struct([("anchor", pa.int64()), ("segment", pa.int64()), ("start", pa.int32()), ("windows", pa.list_(pa.int64()))])
)


def _segments(words: list[bytes], window: int, bits: list[np.ndarray]) -> tuple | None:
    """Flat columns of the segments of one text: anchor, segment hash, first window, number of windows, window hashes."""
    hashes = word_hashes(words)
    at, runs = anchors(hashes, window)
    if not len(at):
        return None
    first = np.flatnonzero(np.diff(at, prepend=-1))
    keys = mix(runs[at[first]])
    hit = _repeated(bits, keys)
    if not hit.any():
        return None
    own = mix(shingles(hashes, window))
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    whole = np.add.reduceat(mix(own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    whole = mix(whole + length.astype(np.uint64))
    inside = np.repeat(hit, length)
    return keys[hit], whole[hit], first[hit], length[hit], own[inside]


def _mark(window: int, shared):
    """Second pass: one row per document with its segments, and its text where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = list(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, PART):
                part = batch.slice(begin, PART)
                counts, gone, digests, kept, sizes, flat = [], [], [], [], [], []
                for text, copy in zip(part.column("text").to_pylist(), part.column("copy").to_pylist()):
                    words = text.split()
                    copy = copy and len(words) >= window
                    found = None if copy else _segments(words, window, bits)
                    counts.append(len(words))
                    gone.append(len(words) if copy else 0)
                    digests.append(hashlib.sha256(b"" if copy else b" ".join(words)).hexdigest())
                    kept.append(None if found is None else text)
                    sizes.append(0 if found is None else len(found[0]))
                    if found is not None:
                        flat.append(found)
                column = [np.concatenate(c) for c in zip(*flat)] if flat else [np.empty(0, np.uint64)] * 5
                inner = np.cumsum([0, *column[3].tolist()]).astype(np.int32)
                windows = pa.ListArray.from_arrays(pa.array(inner), pa.array(longs(column[4])))
                segment = pa.StructArray.from_arrays(
                    [pa.array(longs(column[0])), pa.array(longs(column[1])), pa.array(column[2].astype(np.int32)), windows],
                    fields=list(SEGMENTS.value_type),
                )
                outer = np.cumsum([0, *sizes]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(kept, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(outer), segment),
                    ],
                    ["doc_id", "n_words", "n_removed", "sha256", "text", "segments"],
                )

    return run


def _remove(window: int):
    """Drops the covered words; stretches are (first window, number of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, stretches in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in stretches:
                    edge[s["start"]] += 1
                    edge[s["start"] + s["n"] + window - 1] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone])
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, sketch_bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs``.

    A word is removed when a window over it starts earlier too: in a smaller doc_id, or earlier in the same document.
    kept_text is the remaining words joined by one space, NULL where nothing was removed. NULL and
    empty texts have no words. Rows that repeat a doc_id are ordered by an arbitrary but fixed row number; a NULL doc_id
    comes before all others. Texts shorter than the window keep all words; an empty table gives an empty
    table; other columns are not read.
    """
    rows = id_and_text(docs)
    copies = broadcast_if_at_most(_whole_copies(rows), BROADCAST_IDS)
    fresh = rows.join(copies, rows["doc_id"] == copies["copy_id"], "left_anti")
    bits = sketch.build(fresh.select("text"), _anchor_keys(window), sketch_bits, DEPTH, lambda c: np.packbits(c > 1))
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    flagged = rows.join(copies, rows["doc_id"] == copies["copy_id"], "left").select(
        "doc_id", "text", F.col("copy_id").isNotNull().alias("copy")
    )
    marked = flagged.mapInArrow(
        _mark(window, shared),
        "doc_id long, n_words long, n_removed long, sha256 string, text binary, "
        "segments array<struct<anchor:bigint,segment:bigint,start:int,windows:array<bigint>>>",
    )
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()))

    segments = marked.select("doc_id", "row", F.explode("segments").alias("s")).select(
        F.col("s.anchor").alias("anchor"), F.col("s.segment").alias("segment"),
        F.struct("doc_id", "row", F.col("s.start").alias("start")).alias("at"),
        F.size("s.windows").alias("n"), F.col("s.windows").alias("windows"),
    )
    # equal segments: all but the first are repeats as a whole
    kinds = stored(segments.groupBy("anchor", "segment").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")))
    shared_anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("total")).filter("total > 1")
    groups = kinds.join(shared_anchors, "anchor").select("anchor", "segment", "first", (F.col("kinds") > 1).alias("mixed"))
    useful = stored(
        segments.join(groups, ["anchor", "segment"])
        .withColumn("whole", F.col("at") > F.col("first"))
        .filter("whole or mixed")
        .select("anchor", "at", "n", "whole", F.when(~F.col("whole"), F.col("windows")).alias("windows"))
    )
    # the first of each kind, where an anchor has several kinds, window by window
    single = useful.filter("not whole").select("anchor", "at", F.posexplode("windows").alias("i", "window")).select(
        "anchor", "window",
        F.struct("at.doc_id", "at.row", (F.col("at.start") + F.col("i")).alias("start")).alias("at"),
    )
    firsts = single.groupBy("anchor", "window").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = stored(firsts.filter("times > 1").drop("times"))  # a table of its own, so that a hot window's join can be split
    repeats = (
        single.join(firsts, ["anchor", "window"])
        .filter("at > first")
        .select(F.col("at.row").alias("row"), F.col("at.start").alias("start"), F.lit(1).alias("n"))
    )
    whole = useful.filter("whole").select(F.col("at.row").alias("row"), F.col("at.start").alias("start"), "n")
    stretches = stored(whole.unionByName(repeats).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("stretches")))
    # only texts that lose something meet their stretches
    touched = broadcast_if_at_most(stretches.select("row"), BROADCAST_IDS)
    changed = (
        marked.select("doc_id", "row", "n_words", "text")
        .join(touched, "row", "left_semi")
        .join(stretches, "row")
        .select("doc_id", "n_words", "text", "stretches")
        .mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
    rest = marked.join(touched, "row", "left_anti").select(
        "doc_id", "n_words", "n_removed", F.col("sha256").alias("kept_sha256"), F.when(F.col("n_removed") > 0, "").alias("kept_text")
    )
    return changed.unionByName(rest)


def _whole_copies(rows: DataFrame) -> DataFrame:
    """copy_id of the documents whose text a document of smaller id has; only ids that a single row carries."""
    digests = stored(rows.filter("doc_id is not null").select("doc_id", F.sha2("text", 256).alias("digest")))
    once = digests.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("digest").alias("digest")).filter("times = 1")
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"))
    first = stored(first.filter("members > 1").drop("members"))  # a table of its own, so that a hot digest's join can be split
    return stored(once.join(first, "digest").filter("doc_id > first").select(F.col("doc_id").alias("copy_id")))
