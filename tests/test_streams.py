"""Streams against their batch forms: grids with gaps, ripe returns, and a feed that is subscribed while it runs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.operators import grid, targets
from tickloom.sources import mock
from tickloom.streaming import book as live
from tickloom.streaming import feed

TICKS = "instrument_token long, mono_nanos long, seq long, ltp double, event_time timestamp"


def run(stream, spark, tmp_path, name):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def files(spark, tmp_path, name, parts, schema_):
    """Each part as one file, one a micro-batch."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        time.sleep(0.02)
    return spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name))


def ticks(rows):
    from datetime import UTC, datetime

    return [(tok, int(t * schema.SECOND), s, p, datetime.fromtimestamp(1_700_000_000 + t, UTC)) for tok, t, s, p in rows]


def test_grid_with_gaps_ties_and_late_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "CHUNK", 7)
    rng = np.random.default_rng(4)
    rows = ticks([(tok, float(t), k, float(rng.integers(90, 110))) for tok in (1, 2) for k, t in enumerate(sorted([*rng.choice(400, 40) / 10, 10.0, 10.0, 20.0, 300.0, 301.5]))])
    rows.sort(key=lambda r: (r[1], r[2]))
    cut = [rows[:30], rows[30:31], rows[31:80], rows[80:]]
    for part in cut:
        rng.shuffle(part)
    got = run(live.locf(files(spark, tmp_path, "in", [[tuple(r) for r in p] for p in cut], TICKS), 500, "10 days"), spark, tmp_path, "out")
    want = grid.resample(spark.createDataFrame(rows, TICKS), (500,)).select("instrument_token", "grid_seq", "grid_nanos", F.col("mono_nanos").alias("tick_nanos"), "seq", "ltp")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silent_token_is_dropped_after_the_delay(spark, tmp_path):
    parts = [ticks([(1, 0, 0, 1.0), (2, 0, 0, 1.0)]), ticks([(2, 100, 1, 1.0)]), ticks([(2, 300, 2, 1.0)]), ticks([(2, 600, 3, 1.0)]), ticks([(1, 601, 9, 2.0), (2, 601, 4, 1.0)]), ticks([(1, 603, 10, 2.0)])]
    got = run(live.locf(files(spark, tmp_path, "in", parts, TICKS), 1000, "1 minute"), spark, tmp_path, "out")
    of = lambda tok: [r["grid_nanos"] // schema.SECOND for r in got.where(F.col("instrument_token") == tok).orderBy("grid_nanos").collect()]
    assert of(2) == list(range(1, 602)) and of(1) == [602, 603]  # its grid begins anew


def test_ripe_returns_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    kind = "instrument_token long, grid_seq long, grid_nanos long, interval_ms int, mid_price double, event_time timestamp"
    rows = [(tok, k, k * schema.SECOND, 1000, float(rng.integers(0, 50)), r[4]) for tok in (1, 2) for k, r in enumerate(ticks([(tok, k, k, 0.0) for k in range(260)]))]
    rows.sort(key=lambda r: r[1])
    parts = [rows[i : i + 170] for i in range(0, len(rows), 170)]
    stream = files(spark, tmp_path, "in", parts, kind).withColumnRenamed("mid_price", "mid")
    got = run(live.forward_returns(stream, "10 days"), spark, tmp_path, "out")
    want = targets.returns(spark.createDataFrame(rows, kind)).where(f"grid_nanos <= {199 * schema.SECOND}")
    names = ["instrument_token", "grid_nanos", *[f"r_{h}s" for h in schema.HORIZONS_SEC]]
    pairs = zip(sorted(map(tuple, got.select(*names).collect())), sorted(map(tuple, want.select(*names).collect())), strict=True)
    for a, b in pairs:
        assert a[:2] == b[:2] and all(x == y if x is None or y is None else x == pytest.approx(y, abs=1e-12) for x, y in zip(a[2:], b[2:], strict=True))


def test_feed_is_subscribed_while_it_runs(spark, tmp_path):
    f = feed.Feed(spark, str(tmp_path), rows=20)
    f.subscribe([7, 1001])
    seen: dict[int, set] = {}

    def listener(batch, epoch):
        for r in batch.select("instrument_token", "client_arrival_nanos").collect():
            seen.setdefault(r[0], set()).add(r[1])

    q = f.listen(listener, str(tmp_path / "check"))

    def wait(for_):
        end = time.time() + 60
        while not for_() and time.time() < end:
            time.sleep(0.1)
        assert for_(), q.exception()

    wait(lambda: set(seen) == {7, 1001})
    f.unsubscribe([7])
    f.subscribe([9])
    wait(lambda: 9 in seen)
    before = len(seen[7])
    wait(lambda: len(seen[9]) >= 60)
    assert len(seen[7]) == before and len(seen[1001]) > before
    f.disconnect()
    assert not q.isActive
    want = {r[0] for r in mock.batch(spark, len(seen[1001])).select("client_arrival_nanos").collect()}
    assert seen[1001] == want and feed._read(f.path) == {"connected": False, "tokens": [9, 1001]}
