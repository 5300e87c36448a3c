"""Streams with event-time timers over several batches, against plain loops."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fathomline.streaming import timers

pytest.importorskip("google.protobuf")
START, MINUTE = 1_700_000_000_000_000, 60_000_000


def run(spark, tmp_path, files, columns, answer):
    """Answers of a stream that takes one file a batch, and the rows that came too late."""
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(files):
        path = str(tmp_path / "in" / f"{i}.parquet")
        pq.write_table(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(columns)}), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = answer(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())), timers.late_rows(q)


AT = pa.timestamp("us", tz="UTC")


def test_trailing_sums_over_batches(spark, tmp_path):
    """Each window is answered once and whole, whichever batch its rows come in; null times and late rows change nothing."""
    rng = random.Random(3)
    files, rows = [], []
    for b in range(4):  # forty minutes a file, up to eight minutes out of order
        f = [(k % 2, 100 * b + k, START + (40 * b + rng.randint(0, 47)) * MINUTE + rng.randint(0, 3), None if k % 4 == 0 else rng.randint(-5, 50)) for k in range(60)]
        rows += f
        files.append(f)
    files[0] = [*files[0], (0, 9001, None, None), (0, 9002, None, 7)]
    files[3] = [*files[3], (0, 9003, START - 600 * MINUTE, None)]
    got, late = run(spark, tmp_path, files, [("pair_id", pa.int64()), ("id", pa.int64()), ("at", AT), ("amount", pa.int64())], lambda e: timers.trailing_sums(e, 900, "10 minutes"))
    passed = max(r[2] for r in rows) // 1000 - 600_000
    want = []
    for p, i, at, a in rows:
        if a is None and at // 1000 + 1 < passed:
            seen = [x for q, _, t, x in rows if q == p and x is not None and at - 15 * MINUTE < t <= at]
            want.append((p, i, at, len(seen), sum(seen)))
    assert got == sorted(want) and len(got) > 30 and late == 1


def test_overdue_over_batches(spark, tmp_path):
    """Compared in time, too late, never, before its recording, twice, and a comparison of nothing."""
    m = [(1, 0, False), (1, 3, True), (2, 1, False), (2, 7, True), (3, 2, False), (5, 1, True), (5, 3, False), (6, 3, False), (6, 3, False), (7, 4, True), (8, 4, False), (8, 9, True)]
    late = [(9, 60, False), (10, 80, False)]
    files = [[(i, START + t * MINUTE, c) for i, t, c in part] for part in (m[:6], m[6:], late)]
    got, dropped = run(spark, tmp_path, files, [("id", pa.int64()), ("at", AT), ("compared", pa.bool_())], lambda e: timers.overdue(e, 300, "10 minutes", buckets=2))
    assert got == [(i, START + t * MINUTE) for i, t in ((2, 1), (3, 2), (6, 3), (9, 60))] and dropped == 0


def test_window_within_a_slice(spark, tmp_path):
    with pytest.raises(ValueError):
        timers.trailing_sums(spark.createDataFrame([], "pair_id bigint, id bigint, at timestamp, amount bigint"), 7200)
