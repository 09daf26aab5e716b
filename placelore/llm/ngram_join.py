"""Jaccard join of word shingle sets: subsets for small sets, inverted lists for large ones.

A set is a document's distinct runs of ``words`` words. Two sets link when their Jaccard similarity is at
least ``percent`` / 100. The result is the connected components of all links; none is missed.

1. A count-min sketch of all shingles orders them from rare to frequent. The order only steers the work;
   any order gives the same result.
2. Equal sets become one node, so copies cost nothing further.
3. Small sets: two linked sets of sizes s and t share at least ``overlap(s, t)`` shingles, so they share a
   subset of exactly that size. Each small set lists these subsets (their number is bounded by the
   boundary below).
4. Large sets: two linked sets share one of the first s - ceil(p s) + 1 shingles of either. Each set
   enters the inverted lists of those shingles; lists of frequent shingles stay short, as these come last.
   A pair passes only where the places in both orders leave room for the needed overlap.
5. The boundary is the smallest size at which listing subsets costs more rows than entering and scanning lists,
   by the mean list length that the sketch shows.
6. Lists are not expanded into all pairs. First every member is compared with one representative per
   list; then only pairs of different components are compared, representatives no more, and a pair not again in the
   lists that follow a common one (``PRECEDING``). Bitmaps of
   each set (parity of the shingles per bit; a short one in the join, one as long as the set behind it) bound the
   symmetric difference from below before sets are fetched. Sets that remain are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from placelore.llm import sketch
from placelore.llm.common import (
    broadcast_if_at_most,
    id_and_text,
    longs,
    mix,
    shingle_set,
    stored,
    word_hashes,
)

BITS, DEPTH = 24, 2  # sketch of frequencies: 2 x 16M counters, one byte each after merging
LARGEST_SMALL = 20  # no boundary beyond this size is considered
BITMAP = 8  # 64-bit words of the parity bitmap
PRECEDING = 6  # keys of a node that a list remembers, to see that two members have met before
FETCHED_KEYS = 200_000  # keys of about 50 bytes that may be broadcast to filter texts
FETCHED_IDS = 1_000_000  # ids of 8 bytes that may be broadcast to drop rows


def overlap(s: int, t: int, percent: int) -> int:
    """Least intersection of linked sets of these sizes: 100 i >= percent (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def subset_sizes(s: int, percent: int) -> list[int]:
    partners = range(-(-percent * s // 100), s * 100 // percent + 1)
    return sorted({overlap(s, t, percent) for t in partners})


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def boundary(mean_list: float, percent: int) -> int:
    """Smallest size whose subsets cost more than its inverted lists; sets below it are small."""
    for s in range(1, LARGEST_SMALL):
        if sum(math.comb(s, c) for c in subset_sizes(s, percent)) > prefix_length(s, percent) * (1 + mean_list):
            return s
    return LARGEST_SMALL


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    # bytes.lower() changes A-Z only; bytes.split() cuts at ASCII white space only
    return [shingle_set(word_hashes(t.lower().split()), words) for t in batch.column("text").to_pylist()]


def _bitmap(values: np.ndarray) -> np.ndarray:
    counts = np.bincount((values >> np.uint64(55)).astype(np.int64), minlength=64 * BITMAP)
    return longs(np.packbits((counts & 1).astype(np.uint8)).view(np.uint64))


def _parity(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of at least as many bits as the set has shingles (a power of two), by the low bits of the shingles."""
    bits = max(64, 1 << (len(values) - 1).bit_length()) if len(values) else 64
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return longs(np.packbits((counts & 1).astype(np.uint8)).view(np.uint64))


def _nodes(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: set size, digest, parity bitmap, and the keys under which its set is looked up."""
    text = rows.select("text")
    levels = sketch.build(
        text,
        lambda batch: np.concatenate([np.empty(0, np.uint64), *_sets(batch, words)]),
        BITS,
        DEPTH,
        lambda counters: np.ceil(np.log2(counters + 1.0)).astype(np.uint8),
    )
    filled = levels[0][levels[0] > 0]
    mean_list = float(np.exp2(np.median(filled) - 1)) if len(filled) else 1.0
    small_below = boundary(mean_list, percent)
    frequent = int(np.ceil(np.log2(4 * mean_list + 8)))  # below this level shingles count as equally rare
    shared = text.sparkSession.sparkContext.broadcast(levels)

    def keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys with their place in the order; subsets carry place -1 (no bound on the place)."""
        s = len(values)
        out, places = [], []
        if s < small_below:
            for size in subset_sizes(s, percent):
                subsets = [np.bitwise_xor.reduce(mix(values[list(c)])) for c in combinations(range(s), size)]
                out.append(mix(np.array(subsets, np.uint64) + np.uint64(size)))
                places.append(np.full(len(subsets), -1, np.int32))
        if s >= math.ceil(small_below * percent / 100):
            n = prefix_length(s, percent)
            level = np.minimum.reduce([shared.value[r][sketch.positions(values, r, BITS)] for r in range(DEPTH)])
            first = np.lexsort((values, np.where(level <= frequent, 0, level)))[:n]
            out.append(values[first])
            places.append(np.arange(n, dtype=np.int32))
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.int32)
        return np.concatenate(out), np.concatenate(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = _sets(part, words)
                found = [keys(v) if len(v) else (v, np.empty(0, np.int32)) for v in sets]
                ends = np.cumsum([0, *(len(k) for k, _ in found)]).astype(np.int32)
                bitmaps = np.concatenate([_bitmap(v) for v in sets])
                parity = [_parity(v) for v in sets]
                parity_ends = np.cumsum([0, *map(len, parity)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(v) for v in sets], pa.int64()),
                        pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BITMAP, pa.array(bitmaps)),
                        pa.ListArray.from_arrays(parity_ends, pa.array(np.concatenate(parity))),
                        pa.ListArray.from_arrays(ends, pa.array(longs(np.concatenate([k for k, _ in found])))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for _, p in found]))),
                    ],
                    ["doc_id", "text_key", "n", "digest", "bitmap", "parity", "keys", "places"],
                )

    schema = "doc_id long, text_key string, n long, digest binary, bitmap array<long>, parity array<long>, keys array<long>, places array<int>"
    return stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps until nothing changes; every step is an aggregate and a join
    on the node, so no component meets in one task.
    """
    state = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _few_differences(differ: Column, percent: int) -> Column:
    """Whether a symmetric difference of at least ``differ`` leaves a pair of sizes n_a and n_b room to link."""
    # i >= percent (n_a + n_b) / (100 + percent) and the symmetric difference is n_a + n_b - 2 i
    return differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def _parity_allows(percent: int) -> Column:
    """The bound by the long bitmaps; the longer one is folded to the length of the other."""
    least = F.least(F.size("parity_a"), F.size("parity_b"))

    def folded(name: str) -> Column:
        halves = F.zip_with(F.slice(name, F.lit(1), least), F.slice(name, least + 1, least), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > least, halves).otherwise(F.col(name))

    differ = F.zip_with(folded("parity_a"), folded("parity_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _few_differences(F.aggregate(differ, F.lit(0), lambda s, x: s + x), percent)


def _may_link(percent: int) -> Column:
    """Size and bitmap bounds on a pair with columns n_a, n_b, bitmap_a, bitmap_b."""
    differ = sum(
        (F.bit_count(F.col("bitmap_a")[i].bitwiseXOR(F.col("bitmap_b")[i])) for i in range(1, BITMAP)),
        F.bit_count(F.col("bitmap_a")[0].bitwiseXOR(F.col("bitmap_b")[0])),
    )
    return _few_differences(differ, percent) & _sizes_fit(percent)


def _sizes_fit(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _places_fit(percent: int) -> Column:
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return (F.col("place_a") < 0) | (F.col("place_b") < 0) | (
        room * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    )


def _links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link: bounds first, then sets of the survivors made from their texts and compared."""
    info = nodes.select("row", "n", "parity", "text_key")

    def side(x: str) -> DataFrame:
        return info.select(F.col("row").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in info.columns if c != "row"])

    close = stored(
        pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_fit(percent) & _parity_allows(percent)).drop("parity_a", "parity_b")
    )
    wanted = stored(
        close.select(F.col("text_key_a").alias("text_key")).unionByName(close.select(F.col("text_key_b").alias("text_key"))).distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = _sets(part, words)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(longs(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.ListArray.from_arrays(ends, values)], ["text_key", "set"])

    few = broadcast_if_at_most(wanted, FETCHED_KEYS)
    texts = rows.join(few, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = stored(texts.select("text_key", "text").mapInArrow(run, "text_key string, set array<long>"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return stored(
        close.join(sets.select(F.col("text_key").alias("text_key_a"), F.col("set").alias("set_a")), "text_key_a")
        .join(sets.select(F.col("text_key").alias("text_key_b"), F.col("set").alias("set_b")), "text_key_b")
        .filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common))
        .select("a", "b")
    )


def _preceding() -> WindowSpec:
    """The ``PRECEDING`` rows before a node's own, in the order of its keys."""
    return Window.partitionBy("node").orderBy("place", "key").rowsBetween(-PRECEDING, -1)


def _crossing(full: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different roots that share a list of ``full`` and pass the bounds on sizes, places and bitmaps.

    A pair with many common keys meets once per list. It is left out of a list if one of the keys ``before`` the list's own is
    the same on both sides: the pair meets there too, at smaller places, which leave no less room. Its first common list keeps it.
    """

    def side(x: str) -> DataFrame:
        return full.select("key", *[F.col(c).alias(f"{c}_{x}") for c in full.columns if c != "key"])

    other = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    bounds = _sizes_fit(percent) & _places_fit(percent) & _may_link(percent)
    return (
        side("a")
        .join(side("b"), "key")
        .filter(other & bounds & ~F.arrays_overlap("before_a", "before_b"))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, the document's own included. Texts are lower-cased
    (A-Z) and cut at ASCII white space; with fewer words than ``words`` the whole sequence is one shingle; NULL,
    empty and blank texts have an empty set and link with nothing. Rows that repeat a text share a component; a NULL
    doc_id is carried along and names a component only if no member has an id (NULL then). An empty
    table gives an empty table; other columns are not read.
    """
    key = F.concat_ws(":", F.md5("text"), F.col("doc_id").cast("string"))
    rows = id_and_text(docs).withColumn("text_key", key)
    nodes_all = _nodes(rows, words, percent)  # numbers the rows; the numbers are stored
    members = nodes_all.select("doc_id", "row", "n", "digest")
    node_of = stored(members.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node")))
    reps = nodes_all.join(node_of.select(F.col("node").alias("row")), "row", "left_semi")
    entries = reps.select("row", "n", F.explode(F.arrays_zip("keys", "places")).alias("e")).select(
        F.col("e.keys").alias("key"), F.col("row").alias("node"), "n", F.col("e.places").alias("place")
    )
    by_node = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = stored(
        entries.select("*", *[F.first(c).over(by_node).alias(f"{c}_a") for c in ("node", "n", "place")]).filter("node <> node_a")
    )  # lists of one member are gone, and so is the representative's own row
    led = shared.withColumnsRenamed({"node": "node_b", "n": "n_b", "place": "place_b"}).filter(_sizes_fit(percent) & _places_fit(percent))
    first = _links(led.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), rows, reps, words, percent)
    root_1 = components(first)
    whole = Window.partitionBy("key")
    named = (
        shared.select("key", "node", "n", "place")
        .join(root_1, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumns({"lo": F.min("root").over(whole), "hi": F.max("root").over(whole)})
        .filter("lo < hi")
        .drop("lo", "hi")
    )
    full = stored(
        named.withColumn("before", F.collect_list("key").over(_preceding()))
        .join(reps.select(F.col("row").alias("node"), "bitmap"), "node")
    )
    crossing = _crossing(full, percent)
    second = _links(crossing, rows, reps, words, percent)
    roots = components(first.unionByName(second))
    placed = (
        members.join(node_of, "digest", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node", "row"))
    )
    placed = stored(placed.select("doc_id", "n", "root"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the document with the smallest doc_id stays.

    Rows without doc_id stay, and rows that repeat a doc_id share its decision.
    """
    lost = jaccard_components(docs, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_lost"))
    lost = broadcast_if_at_most(stored(lost.distinct()), FETCHED_IDS)
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")
