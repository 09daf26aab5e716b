"""The streamed form of an operator gives the rows of its batch form."""

import os
import random
from datetime import datetime, timedelta

from placelore.operators import sessions
from placelore.streaming import sessions as streamed

START = datetime(2024, 1, 1)
CLICKS = "event_id bigint, idhash bigint, etimestamp timestamp_ntz, sid bigint"


def run(spark, folder, batches, **options):
    """Rows written by the stream that reads ``batches`` in order, one file each."""
    source, out = f"{folder}/in", f"{folder}/out"
    os.makedirs(source)
    for n, rows in enumerate(batches):
        part = f"{folder}/part{n}"
        spark.createDataFrame(rows, CLICKS).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.link(f"{part}/{name}", f"{source}/{n}.parquet")
        os.utime(f"{source}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))  # the order of arrival
    stream = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        streamed.place_sessions(stream, **options)
        .writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()
    return spark.read.schema("idhash bigint, sid bigint, start_ts timestamp_ntz, end_ts timestamp_ntz, n_clicks bigint").parquet(out)


def test_place_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1 if rng.random() < 0.4 else rng.randrange(2, 6), START + timedelta(minutes=rng.randrange(0, 3000)), rng.randrange(3)) for i in range(300)]
    rows += [(300, 7, START, 1), (301, 7, START + timedelta(minutes=60), 1)]  # exactly one gap apart
    rows += [(302, 8, START, 1), (303, 8, START + timedelta(minutes=60, microseconds=1), 1)]  # and a little more
    rows += [(304, None, START, 1), (305, 9, None, 1), (306, 9, START, None), (None, 9, START, 1)]
    rows.sort(key=lambda r: (r[2] or START) + timedelta(minutes=rng.randrange(0, 90)))  # out of order, within the lateness
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third] + rows[third - 5 : third], rows[2 * third :]]  # five are delivered twice
    far = START + timedelta(days=30)
    late = [(900, 1, START, 0)]
    batches += [[(901, 99, far, 1)], late, [(902, 99, far + timedelta(days=1), 1)]]
    got = run(spark, str(tmp_path), batches, late_minutes=200).filter("idhash <> 99").collect()
    want = sessions.place_sessions(spark.createDataFrame(rows, CLICKS)).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in ("idhash", "sid", "start_ts", "end_ts", "n_clicks")) for r in want)
    assert [r.n_clicks for r in want if r.idhash == 7] == [2] and [r.n_clicks for r in want if r.idhash == 8] == [1, 1]
    assert len(want) > 50 and max(r.n_clicks for r in want) > 3
