"""Count-min sketch of keys made inside tasks, merged by Spark, returned with a fixed size.

Each task keeps the counter positions it has touched, sorted and delta-coded, cut into slots.
The slots are dealt out by number; a task adds up the slots it gets as they stream in, so its
memory is the counters of its slots, however many tasks sent parts. The driver receives the
finished slots, whose total size depends on ``bits`` and ``depth`` only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOTS = 64
FLUSH = 2_000_000  # keys held by a task before it sends a part
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def positions(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Counter of each (well mixed) key in one sketch row."""
    return ((keys * np.uint64(_SALTS[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def _parts(keys: np.ndarray, bits: int, depth: int) -> pa.RecordBatch:
    slots, payloads = [], []
    for row in range(depth):
        at = np.sort(positions(keys, row, bits))
        cuts = np.searchsorted(at, np.arange(SLOTS + 1, dtype=np.int64) << (bits - 6))
        for s in range(SLOTS):
            part = at[cuts[s] : cuts[s + 1]] - np.uint32(s << (bits - 6))
            if len(part):
                slots.append(row * SLOTS + s)
                payloads.append(zlib.compress(np.diff(part, prepend=np.uint32(0)).tobytes(), 1))
    return pa.RecordBatch.from_pydict(
        {"slot": pa.array(slots, pa.int32()), "payload": pa.array(payloads, pa.binary())}
    )


def build(
    df: DataFrame,
    keys_of: Callable[[pa.RecordBatch], np.ndarray],
    bits: int,
    depth: int,
    finish: Callable[[np.ndarray], np.ndarray],
) -> np.ndarray:
    """Runs the sketch over ``df``; ``finish`` turns the counters of a slot into what is kept of them.

    Returns an array (depth, ...) of the finished slots in order. Missing slots are those of zero counters.
    """
    size = 1 << (bits - 6)  # counters of a slot

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = keys_of(batch)
            held.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield _parts(np.concatenate(held), bits, depth)
                held, n = [], 0
        if n:
            yield _parts(np.concatenate(held), bits, depth)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.cumsum(np.frombuffer(zlib.decompress(payload), np.uint32), dtype=np.uint32)
                starts = np.flatnonzero(np.diff(at, prepend=np.uint32(2**32 - 1)))
                have = counters.get(slot)
                if have is None:
                    have = counters[slot] = np.zeros(size, np.uint32)
                have[at[starts]] += np.diff(starts, append=len(at)).astype(np.uint32)
        for slot, have in counters.items():
            yield pa.RecordBatch.from_pydict(
                {"slot": pa.array([slot], pa.int32()), "payload": pa.array([finish(have).tobytes()], pa.binary())}
            )

    schema = "slot int, payload binary"
    merged = df.mapInArrow(count, schema).repartition(SLOTS, "slot").mapInArrow(merge, schema)
    empty = finish(np.zeros(size, np.uint32))
    out = np.tile(empty, (depth * SLOTS, 1))
    for slot, payload in merged.collect():  # fixed size: depth * SLOTS finished slots
        out[slot] = np.frombuffer(payload, empty.dtype)
    return out.reshape(depth, -1)
