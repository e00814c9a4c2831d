"""Logs, decoders, the store, the registry, streams, models, and every registered query."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.operators import flow, grid
from tickloom.plans import features, ml, queries
from tickloom.sources import decoders, mock, store, ticks, wal
from tickloom.streaming import book as live


def _frames(n):
    return b"".join(wal.frame(struct.pack(">qdqqd", 738561, 2500.0 + i, 10, 100 + i, 2500.0), i, i * schema.SECOND, i * 1_000_000) for i in range(n))


def test_frames():
    data = _frames(3)
    rows, valid, why = wal.parse(data)
    assert len(rows) == 3 and valid == len(data) and why == "CLEAN" and rows[2][2] == 2
    flipped = bytearray(data)
    flipped[45] ^= 1
    assert wal.parse(bytes(flipped))[2] == "CRC_MISMATCH"
    assert wal.parse(b"\0" + data)[2] == "BAD_MAGIC"


@pytest.mark.parametrize(("data", "frames", "cut", "why"), [(_frames(10), 10, 0, "CLEAN"), (_frames(5) + b"x" * 12, 5, 12, "PARTIAL_HEADER"), (_frames(3) + wal.frame(b"y" * 100, 9, 0, 0)[:60], 3, 60, "SHORT_PAYLOAD")])
def test_recovery(spark, tmp_path, data, frames, cut, why):
    (tmp_path / "feed_conn1_0.raw").write_bytes(data)
    r = wal.recovery_report(spark, str(tmp_path)).first()
    assert (r["n_frames"], r["truncated_bytes"], r["diagnosis"]) == (frames, cut, why)
    assert (tmp_path / "feed_conn1_0.raw").read_bytes() == data
    got = wal.ticks(wal.read(spark, str(tmp_path)))
    assert got.count() == frames and got.orderBy("seq").first()["a0"] == 2500.25
    spark.dataSource.register(wal.FrameSource)
    assert spark.read.format("frame_log").option("path", str(tmp_path)).load().count() == frames


def test_kite(spark):
    head = struct.pack(">IiIiIII", 738561, 250050, 50, 249820, 1_500_000, 1, 1) + b"\0" * 32 + struct.pack(">I", 1700000005)
    depth = b"".join(struct.pack(">IiHH", q, 250000 - 50 * i, i + 1, 0) for i, q in enumerate((100, 250, 500, 1000, 2000)))
    depth += b"".join(struct.pack(">IiHH", q, 250050 + 50 * i, i + 1, 0) for i, q in enumerate((150, 300, 600, 1200, 2400)))
    packet = head + depth
    assert len(packet) == 184
    df = spark.createDataFrame([(packet, 1, 2)], "packet binary, arrival_nanos long, arrival_micros long")
    r = decoders.kite(df).first()
    assert (r["instrument_token"], r["ltp"], r["ltq"], r["cumulative_volume"], r["day_vwap"], r["exchange_epoch_secs"], r["symbol"]) == (738561, 2500.5, 50, 1_500_000, 2498.2, 1700000005, "TOKEN_738561")
    assert r["bid_prices"] == [2500.0, 2499.5, 2499.0, 2498.5, 2498.0] and r["ask_quantities"] == [150, 300, 600, 1200, 2400] and r["state_tag"] == "NORMAL"
    short = spark.createDataFrame([(packet[:100], 1, 2)], "packet binary, arrival_nanos long, arrival_micros long")
    with pytest.raises(Exception, match="184"):
        decoders.kite(short).collect()
    assert decoders.kite(short, strict=False).count() == 0


def test_dhan(spark):
    side = lambda p, s, q, o: [{"price": round(p + s * 0.1 * i, 2), "quantity": q[0] + q[1] * i, "orders": o + i} for i in range(20)]
    full = json.dumps({"securityId": "1333", "LTP": 1450.2, "LTQ": 5, "avgPrice": 1449.0, "volume": 9, "exchangeTime": 7, "depth": {"buy": side(1450, -1, (500, 50), 5), "sell": side(1450.5, 1, (400, 40), 3)}})
    part = json.dumps({"securityId": "1", "depth": {"buy": [{"price": 10.0}]}})
    df = spark.createDataFrame([(full, 1, 2), (part, 3, 4)], "json string, arrival_nanos long, arrival_micros long")
    a, b = decoders.dhan(df, spark.createDataFrame([(1333, "HDFCBANK")], "instrument_token long, symbol string")).orderBy("client_arrival_nanos").collect()
    assert (a["bid_prices"][-1], a["ask_prices"][-1], a["bid_quantities"][19], a["ask_orders"][19], a["symbol"]) == (1448.1, 1452.4, 1450, 22, "HDFCBANK")
    assert b["bid_prices"] == [10.0] + [0.0] * 19 and b["ask_quantities"] == [0] * 20 and b["ltp"] == 0.0 and b["state_tag"] == "STATE_EMPTY_SIDE"


def test_store_round_trip_and_pruning(spark, sf, tmp_path):
    t = features.feature_table(ticks.load(spark, sf)).where("instrument_token < 4")
    assert list(t.columns) == [*schema.FEATURE_COLUMNS, "interval_ms"] and len(schema.FEATURE_COLUMNS) == 43
    store.write_features(t, str(tmp_path / "f"), "2026-08-29")
    store.write_features(t.where("instrument_token = 2"), str(tmp_path / "f"), "2026-08-29")
    assert store.read_features(spark, str(tmp_path / "f")).count() == t.count()
    one = store.read_features(spark, str(tmp_path / "f"), 1000, "2026-08-29", 2)
    assert one.count() == t.where("instrument_token = 2").count()
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan
    store.write_csv(t, str(tmp_path / "c"), "2026-08-29")
    text = spark.read.option("header", "true").csv(str(tmp_path / "c"))
    assert text.count() == t.count() and text.where("r_60s = 'NaN'").count() == t.where("r_60s is null").count()


def test_one_exchange_by_instrument(spark, sf):
    """Tick and grid windows share one exchange."""
    df = features.feature_table(ticks.load(spark, sf), (500, 1000))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    got = queries.stream_locf(spark, sf)
    want = queries.locf_grid_1000ms(spark, sf)
    keys = ["instrument_token", "grid_seq", "seq"]
    assert got.count() == want.count() and got.select(*keys).exceptAll(want.select(*keys)).count() == 0


def test_messages_and_failing_sinks(spark, tmp_path):
    feed = mock.batch(spark, 50)
    assert feed.schema.names == schema.SNAPSHOT.names
    m = json.loads(store.messages(feed, F.lit(0.5), F.lit(None).cast("double")).first()["message"])
    assert len(m) == 22 and m["depthImbalancePercent"] == 50.0 and m["tradeStrengthPercent"] == 0.0 and len(m["bids"]) == 20
    feed.select("instrument_token", F.col("client_arrival_nanos").alias("mono_nanos"), F.col("ltq").alias("seq"), "ltp").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []

    def broken(df, epoch):
        raise RuntimeError("sink")

    stream = spark.readStream.schema("instrument_token long, mono_nanos long, seq long, ltp double").parquet(str(tmp_path / "in"))
    live.broadcast_messages(stream, [broken, lambda df, epoch: seen.extend(df.collect())], str(tmp_path / "check"), None).awaitTermination()
    assert len(seen) == 1 and seen[0]["mono_nanos"] == 49 * 10_000_000


def test_models(spark, sf, tmp_path):
    t = ml.matrix(features.feature_table(ticks.load(spark, sf)))
    model, took = ml.train(t, trees=3, depth=3)
    stats = ml.scaler(t)
    facts = ml.save(model, str(tmp_path / "m"), stats)
    again = ml.load(str(tmp_path / "m"), facts)
    some = t.limit(200).persist()
    v = ml.verify(ml.predict(model, some).withColumn("k", F.col("grid_seq") * 1000 + F.col("instrument_token")), ml.predict(again, some).withColumn("k", F.col("grid_seq") * 1000 + F.col("instrument_token")), "k").first()
    assert v["max_error"] <= 1e-5 and v["match_rate"] == 1.0 and took > 0
    with pytest.raises(ValueError, match="metadata"):
        ml.load(str(tmp_path / "m"), {"sha256": "0"})
    base = ml.adaptive(str(tmp_path / "none"), some)
    assert base.select("mode").distinct().collect()[0][0] == "MODE_BASELINE_ACTIVE" and base.where("p_up is not null").count() == 0
    assert ml.adaptive(str(tmp_path / "m"), some).select("mode").first()[0] == "MODE_MODEL_ACTIVE"
    z = ml.standardized(t, stats).agg(F.avg("l1_obi"), F.stddev_pop("l1_obi")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    with pytest.raises(Exception, match="finite"):
        ml.standardized(spark.createDataFrame([(None,)], "l1_obi double"), {"l1_obi": (0.0, 1.0)}).collect()


def test_latest_and_tail(spark):
    df = spark.createDataFrame([(1, 5, 1, 9.0), (1, 5, 2, 8.0), (2, 1, 3, None)], "instrument_token long, mono_nanos long, seq long, ltp double")
    assert {(r["instrument_token"], r["seq"], r["n_updates"]) for r in flow.latest(df).collect()} == {(1, 2, 2), (2, 3, 1)}
    assert flow.tail(df, 1).count() == 1


def test_registry(spark):
    reg = spark.createDataFrame([("MOCK", True, "1", True, True), ("DHAN", False, "", False, True)], store.SOURCES)
    out = {r["source"]: r for r in store.source_status(store.select_source(reg, " dhan", "3, 3,,4")).collect()}
    assert out["DHAN"]["selected"] and out["DHAN"]["tokens"] == "3,4" and out["DHAN"]["status"] == "CREDENTIALS_MISSING" and not out["MOCK"]["selected"]


def test_empty_ticks(spark, sf):
    t = ticks.load(spark, sf).limit(0)
    assert features.feature_table(t).count() == 0 and grid.resample(t).count() == 0
