"""Operations on items applied to a store of versions."""

import os
import random
from datetime import date, timedelta

from placelore.operators import notes
from placelore.sources import store

D = date(2024, 1, 1)
ROUTED = "idhash bigint, path string, item string, axis string, polarity bigint, datestr date, support bigint"


def batch(spark, rng, users, first, last, n=150):
    rows = {
        (rng.choice(users), rng.choice(["root", "root > A", "root > A > x"]), rng.choice("abcdef"), rng.choice(list(notes.RANKS)),
         rng.choice([1, -1]), D + timedelta(rng.randrange(first, last)))
        for _ in range(n)
    }
    return spark.createDataFrame([(*r, rng.randrange(1, 4)) for r in rows], ROUTED)


def rows_of(items):
    return sorted(tuple(r[c] for c in ("idhash", "path", "item", "axis", "polarity", "last_seen", "support")) for r in items.collect())


def test_applied_operations_equal_the_update(spark):
    rng = random.Random(8)
    held = notes.apply_batch(batch(spark, rng, [1, 2, 3], 0, 6))[0].cache()
    for first, last in ((6, 9), (3, 8), (0, 2)):  # newer, overlapping and late days
        routed = batch(spark, rng, [2, 3, 4], first, last).cache()
        after = notes.apply_ops(held, routed)
        assert rows_of(after) == rows_of(notes.apply_batch(routed, held)[0])
    ops = {(r.path, r.item): r.op for r in notes.memory_ops(held.filter("idhash = 2"), routed.filter("idhash = 2")).collect()}
    assert {"ADD", "UPDATE", "DELETE", "NO_CHANGE"} >= set(ops.values()) and "DELETE" in ops.values()
    assert rows_of(notes.apply_ops(held, routed.filter("false"))) == rows_of(held)
    assert rows_of(notes.apply_ops(held.filter("false"), routed)) == rows_of(notes.apply_batch(routed)[0])


def test_upsert_writes_changed_partitions_and_keeps_versions(spark, tmp_path):
    rng, folder = random.Random(9), str(tmp_path / "store")
    days = [D, D + timedelta(7), D + timedelta(14), D + timedelta(21)]
    first = notes.apply_batch(batch(spark, rng, list(range(40)), 0, 6, 400))[0].cache()
    store.write_buckets(first, folder, days[0], 8)
    routed = batch(spark, rng, [3, 77], 7, 9, 30).cache()

    def upsert(day, rows):
        store.upsert(rows, folder, notes.ITEM_SCHEMA, day, notes.apply_ops, 8)

    def read(day):
        return rows_of(store.read_as_of(spark, folder, notes.ITEM_SCHEMA, day))

    upsert(days[1], routed)
    want = rows_of(notes.apply_batch(routed, first)[0])
    assert read(days[0]) == rows_of(first) and read(days[1]) == read(days[1] + timedelta(1)) == want
    written = {p for p in os.listdir(f"{folder}/rows/run_date={days[1]}") if p.startswith("bucket=")}
    assert 1 <= len(written) <= 2 and len(os.listdir(f"{folder}/rows/run_date={days[0]}")) > 4
    upsert(days[1], routed)  # a repeated run
    assert read(days[1]) == want
    upsert(days[2], routed)  # the same batch again on a later day
    assert read(days[2]) == want
    upsert(days[3], routed.filter("false"))
    assert read(days[3]) == want and read(days[0]) == rows_of(first)


def test_empty_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    none = spark.createDataFrame([], notes.ITEM_SCHEMA)
    store.write_buckets(none, folder, D, 4)
    assert store.read_as_of(spark, folder, notes.ITEM_SCHEMA, D).count() == 0
    routed = batch(spark, random.Random(1), [1], 0, 2, 5)
    store.upsert(routed, folder, notes.ITEM_SCHEMA, D + timedelta(1), notes.apply_ops, 4)
    assert rows_of(store.read_as_of(spark, folder, notes.ITEM_SCHEMA, D + timedelta(1))) == rows_of(notes.apply_batch(routed)[0])
    assert store.read_as_of(spark, folder, notes.ITEM_SCHEMA, D - timedelta(1)).count() == 0
