"""Helpers shared by the operators: inputs, words and their hashes, shingles, tables of checked size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.functions.skew import cut_lineage

#: Entries a word cache of one Python worker may hold before it starts anew (results do not depend on it).
CACHE_ENTRIES = 400_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (UTF-8 bytes, NULL as empty); other columns, whatever their names, are left out."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    return cut_lineage(df)


def broadcast_if_at_most(narrow: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when the stored, fixed-width table ``narrow`` has at most ``rows`` rows, else unchanged (a shuffled join)."""
    return F.broadcast(narrow) if narrow.limit(rows + 1).count() <= rows else narrow


_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Called by an operator inside a task: the worker drops the caches of other operators, so these never add up."""
    others = [o for o in _HELD if o != owner]
    for other in others:
        _HELD.pop(other)()
    _HELD[owner] = clear
    if others:
        _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system, which neither Arrow nor the C library does by itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


@contextmanager
def collector_off() -> Iterator[None]:
    """Python's cycle collector rests: it would walk a worker's cache of plain values again and again and find nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, computed once per word and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHES_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Hashes are made faster than they are kept; the worker keeps only as many as pay.
HASHES_HELD = 100_000
_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if "hashes" not in _HELD or len(_HELD) > 1:
        claim("hashes", _WORDS.clear)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words (splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per run of ``k`` consecutive words; empty when there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _STEP
    for j in range(1, k):
        out = (out + hashes[j : j + n]) * _STEP
    return mix(out ^ np.uint64(k))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; on 64-bit words a sort is faster than the hashing of np.unique."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``k`` words make one shingle, none make an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return distinct(shingles(hashes, min(k, len(hashes))))


def longs(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, as Spark stores them."""
    return values.view(np.int64)
