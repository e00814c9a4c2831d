"""The session export, streamed logs, the synthetic table and the reports on it."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.operators import flow
from tickloom.plans import export, research
from tickloom.sources import store, synthetic, ticks, wal


def test_finalize_session(spark, sf, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "features")
    source = flow.cumulative(ticks.load(spark, sf)).where("instrument_token < 4").coalesce(1)
    wal.write(source, log)
    n = source.count()
    part = next((tmp_path / "log").iterdir())
    with part.open("ab") as f:
        f.write(b"broken")
    report = export.finalize_session(spark, log, out, "2026-08-29", intervals_ms=(1000, 2000))
    back = store.read_features(spark, out)
    assert (report["frames"], report["corrupted_frames"], report["rows"]) == (n, 1, back.count())
    assert back.where("l1_obi = 0 and abs(microprice - mid_price) < 1e-9").count() == back.where("l1_obi is not null").count() > 0
    table = export.record_session(spark.createDataFrame([("2026-08-29", "MOCK", 0, 0, 0, 0), ("2026-08-28", "MOCK", 0, 0, 0, 0)], export.SESSIONS), report)
    assert {r["trade_date"]: r["frames"] for r in table.collect()} == {"2026-08-28": 0, "2026-08-29": n}
    assert store.lookup(table, trade_date="2026-08-28").count() == 1


def test_streamed_log(spark, sf, tmp_path):
    t = flow.cumulative(ticks.load(spark, sf)).where("instrument_token = 1").select("instrument_token", "ltp", "ltq", "cum_volume", "vwap", "seq", "mono_nanos", "epoch_micros")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    wal.write_stream(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert wal.ticks(wal.read(spark, str(tmp_path / "log"))).count() == t.count()


def test_synthetic_surface(spark):
    t = synthetic.table(spark, ("2026-08-25",), 400, (1000, 2000)).persist()
    assert t.count() == 3 * (400 + 200) and t.where("isnan(r_60s)").count() == 0
    ic = research.table_ic(t, ("l1_obi", "trade_strength"), (1, 5))
    shown = research.surface(ic)
    cells = research.composite(shown)
    got = json.loads(research.surface_json(shown, cells).first()[0])
    assert len(got["surfaces"]) == 8 and got["peak"]["composite"] == max(c["composite"] for c in got["composite"]) > 0
    assert research.peak(cells).first()["composite"] == got["peak"]["composite"]
    tests = research.benjamini_hochberg(research.tested(ic).withColumns({"family": F.lit("s"), "position": F.xxhash64("feature", "horizon", "interval_ms")}))
    r = research.report(tests).first()
    assert r["n_tests"] == r["n_defined"] == 8 and r["n_discoveries"] > 0
    c = {(x["a"], x["b"]): x["r"] for x in research.correlations(t, ("l1_obi", "total_obi")).collect()}
    assert c["l1_obi", "l1_obi"] == pytest.approx(1) and c["l1_obi", "total_obi"] > 0.9
    assert not research.deflated_sharpe()["available"]
    with pytest.raises(ValueError, match="missing"):
        research.table_ic(t.drop("l1_obi"))
    assert set(schema.FEATURE_COLUMNS) <= set(t.columns)


def test_export_is_made_and_written_by_many_tasks(spark, sf, tmp_path):
    """Small logs become large tables: the tasks follow the cores, and an instrument's interval is still one file."""
    log, out = str(tmp_path / "log"), tmp_path / "features"
    wal.write(flow.cumulative(ticks.load(spark, sf)).where("instrument_token < 12").coalesce(1), log)
    export.finalize_session(spark, log, str(out), "2026-08-29", intervals_ms=(1000, 2000))
    files = list(out.rglob("*.parquet"))
    folders = {f.parent for f in files}
    assert len(files) == len(folders) == store.read_features(spark, str(out)).select("instrument_token", "interval_ms").distinct().count() > 8
    assert len({f.name.split("-")[1] for f in files}) > 4
