"""Queries over whole tables, where the one with frozen SQL takes a part."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.plans import features, queries, research, surface
from tickloom.sources import ticks
from tickloom.sources.scratch import local


def test_crossed_duration_of_all_ticks(spark, tmp_path):
    # Crossed are events whose id is 0 or 1 modulo 5. Instrument 1 has one sound tick between two of them, instrument 7 (2 of five) none.
    rows = [(50, 1, 0), (78, 1, 36), (100, 1, 72), (151, 1, 108), (200, 7, 0), (250, 7, 360)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, s long")
    e = e.select("event_id", "user_id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("s") * 1_000_000).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["instrument_token"]: r["crossed_nanos"] for r in queries.QUERIES["crossed_duration"](spark, str(tmp_path)).collect()}
    assert got == {1: 36 * 1_000_000 * 5 // 18, 2: 360 * 1_000_000 * 5 // 18}


def test_rank_ic_of_columns_that_are_defined_apart(spark):
    """Features and returns with gaps of their own, ties, constants and infinities: as pandas ranks them."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    n = 400
    t = pd.DataFrame({"interval_ms": np.repeat([500, 1000], n // 2), "a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n), "c": 1.0, "d": rng.normal(size=n), "e": np.nan, "r_1s": rng.integers(-3, 3, n) / 7, "r_5s": rng.normal(size=n)})
    t.loc[rng.random(n) < 0.3, "b"] = np.nan
    t.loc[rng.random(n) < 0.2, "r_5s"] = np.nan
    t.loc[3, "d"] = np.inf
    df = spark.createDataFrame(t).select("interval_ms", *[F.when(~F.isnan(c), F.col(c)).alias(c) if c != "d" else c for c in t.columns[1:]])
    got = {(r["interval_ms"], r["horizon"], r["feature"]): (r["n"], r["ic"]) for r in research.table_ic(df, ("a", "b", "c", "d", "e"), (1, 5)).collect()}
    assert len(got) == 16
    clean = t.replace([np.inf], np.nan)
    for (i, h, f), (count, ic) in got.items():
        cell = clean[clean.interval_ms == i][[f, f"r_{h}s"]].dropna()
        assert count == len(cell)
        want = cell[f].rank().corr(cell[f"r_{h}s"].rank()) if cell[f].nunique() > 1 else None
        assert ic == (None if want is None else pytest.approx(want, abs=1e-12))
    cells = df.select(F.lit("x").alias("feature"), F.col("b").alias("x"), F.col("r_5s").alias("y"))
    cell = clean[["b", "r_5s"]].dropna()
    r = research.rank_ic(cells, ("feature",)).first()
    assert r["n"] == len(cell) and r["ic"] == pytest.approx(cell.b.rank().corr(cell.r_5s.rank()), abs=1e-12)
    tests = research.surface_tests(research.table_ic(df, ("a", "c"), (1, 5)), (500, 1000, 2000), (1, 5), ("a", "c")).orderBy("position").collect()
    assert [(r["interval_ms"], r["horizon"], r["feature"]) for r in tests] == [(i, h, f) for i in (500, 1000, 2000) for h in (1, 5) for f in "ac"]
    assert [r["p_value"] is None for r in tests] == [r["feature"] == "c" or r["interval_ms"] == 2000 for r in tests]
    with pytest.raises(Exception, match="outside the surface"):
        research.surface_tests(research.table_ic(df, ("a", "d"), (1,)), (500, 1000), (1,), ("a",)).collect()


def test_feature_store_of_all_instruments(spark, sf):
    got = queries.QUERIES["feature_store"](spark, sf)
    want = features.feature_table(ticks.load(spark, sf))
    count = lambda d: {r[0]: r[1] for r in d.groupBy(F.col("instrument_token").cast("long")).count().collect()}
    assert count(got) == count(want) and len(count(got)) > 1


def test_whole_surface_equals_brute_force(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").where("user_id <= 2").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    t = features.feature_table(ticks.load(spark, str(tmp_path)), schema.INTERVALS_MS).toPandas()
    shown, p_values = {}, {}
    for i in schema.INTERVALS_MS:
        for h in schema.HORIZONS_SEC:
            each = []
            for f in schema.IC_FEATURES:
                cell = t[t.interval_ms == i][[f, f"r_{h}s"]].dropna().astype(float).round(9)
                x, y = cell[f].rank(), cell[f"r_{h}s"].rank()
                ic = x.corr(y) if len(cell) >= 3 and x.nunique() > 1 and y.nunique() > 1 else None
                each.append(abs(ic) if ic is not None and len(cell) >= 30 else 0.0)
                if ic is not None:
                    p_values[i, h, f] = research.student_p(ic * ((len(cell) - 2) / (1 - ic * ic)) ** 0.5, len(cell) - 2)
            shown[i, h] = sum(each) / len(each)
    got = {(r["interval_ms"], r["horizon"]): r["composite"] for r in queries.QUERIES["information_surface"](spark, str(tmp_path)).collect()}
    assert got.keys() == shown.keys() and len(got) == 25
    assert all(got[c] == pytest.approx(shown[c], abs=1e-8) for c in got)
    top = queries.QUERIES["surface_peak"](spark, str(tmp_path)).first()
    assert top["composite"] == max(got.values()) and got[top["interval_ms"], top["horizon"]] == top["composite"]
    tests = {(r["interval_ms"], r["horizon"], r["feature"]): r for r in queries.QUERIES["surface_tests"](spark, str(tmp_path)).collect()}
    assert len(tests) == 250
    order, adjusted, least = sorted(p_values, key=p_values.get, reverse=True), {}, 1.0
    for k, c in enumerate(order):
        least = min(least, p_values[c] * len(order) / (len(order) - k))
        adjusted[c] = least
    assert all(tests[c]["p_adjusted"] == pytest.approx(adjusted[c], rel=1e-5, abs=1e-12) for c in order)


def test_false_discovery_of_large_families(spark):
    """As a plain loop corrects them, with ties, undefined p-values and a family without a name; no frame is summed anew for each row."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), 0.0, rng.randrange(50) / 1000, rng.random(), rng.random() ** 4])) for i in range(6000)]
    out = research.benjamini_hochberg(spark.createDataFrame(rows, "position long, family string, p_value double"))
    got = {r["position"]: (r["rank"], r["p_adjusted"], r["rejected"]) for r in out.collect()}
    want = {i: (None, None, False) for i, _, _ in rows}
    for family in ("a", "b", None):
        own = sorted((p, i) for i, f, p in rows if f == family and p is not None and p == p)
        last, least = max((k for k, (p, _) in enumerate(own, 1) if p <= 0.05 * k / len(own)), default=0), 1.0
        for k in range(len(own), 0, -1):
            p, i = own[k - 1]
            least = min(least, p * len(own) / k)
            want[i] = (k, least, k <= last)
    assert got == want
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bad", [False, True])
def test_runs_stand_for_the_rows_of_the_feature_table(spark, sf, bad):
    names, intervals = schema.IC_FEATURES, (250, 1000, 2000)
    columns = ["instrument_token", "interval_ms", *names, *[f"r_{h}s" for h in schema.HORIZONS_SEC]]
    t = ticks.load(spark, sf, bad=bad).where("instrument_token < 6")
    table = features.feature_table(t, intervals)
    last = table.groupBy("instrument_token", "interval_ms").agg(F.max("grid_nanos").alias("_g"))
    ripe = table.join(last, ["instrument_token", "interval_ms"]).where(F.col("_g") >= F.col("grid_nanos") + 60 * schema.SECOND)
    runs = features.feature_runs(t, intervals, names)
    count = lambda d, n: {tuple(r)[:-1]: r[-1] for r in d.groupBy(*columns).agg(n).collect()}
    want = count(ripe, F.count("*"))
    assert count(runs, F.sum("n_rows")) == want and len(want) > 100
    if bad:
        assert any(k[2] is None for k in want)


def test_surfaces_follow_ticks_not_grid_points(spark, tmp_path):
    """Three ticks with gaps of days between them: 8 million points, of which 14 pieces at most differ in each grid."""
    day, start = 86_400_000_000, 1_704_067_200_000_000
    rows = [(50, 1, start, 1.0), (78, 1, start + 10_000 * day, 2.0), (100, 1, start + 20_000 * day, 3.0)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, us long, value double")
    e.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), F.lit("view").alias("event_type"), "value", F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    runs = features.feature_runs(ticks.load(spark, str(tmp_path)), schema.INTERVALS_MS, digits=9)
    points = lambda ms: 20_000 * day * 5 // 18 // (ms * 1_000_000) - 60_000 // ms
    got = {r["interval_ms"]: (r["n"], r["pieces"]) for r in runs.groupBy("interval_ms").agg(F.sum("n_rows").alias("n"), F.count("*").alias("pieces")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {ms: points(ms) for ms in schema.INTERVALS_MS}
    assert max(pieces for _, pieces in got.values()) <= 14
    ic = queries.QUERIES["rank_ic_surface"](spark, str(tmp_path)).collect()
    assert {(r["interval_ms"], r["n"]) for r in ic} == {(ms, points(ms)) for ms in schema.INTERVALS_MS}


@pytest.mark.parametrize("bad", [False, True])
def test_packed_surfaces_give_the_correlations_of_the_runs(spark, sf, monkeypatch, bad):
    """Bit by bit, with chunks and ranges of a few rows, and with features and returns that are undefined in rows of their own."""
    t = ticks.load(spark, sf, bad=bad).where("instrument_token < 6")
    if bad:
        t = t.withColumns({"b0": F.when(F.col("seq") % 7 == 0, 0.0).otherwise(F.col("b0")), "ltp": F.when(F.col("seq") % 11 != 0, F.col("ltp"))})
    monkeypatch.setattr(surface, "CHUNK", 37)
    monkeypatch.setattr(surface, "DEALT", 100)
    rows = lambda d: {(r["interval_ms"], r["horizon"], r["feature"]): (r["n"], r["ic"]) for r in d.collect()}
    intervals, horizons = (250, 2000), (1, 30)
    want = rows(research.table_ic(features.feature_runs(t, intervals, horizons=horizons, digits=9), horizons=horizons, n="n_rows"))
    assert rows(surface.runs_ic(t, intervals, horizons=horizons)) == want and len(want) == 40
    if bad:
        assert len({n for n, _ in want.values()}) > 6


def test_packed_numbers_are_the_engines(spark):
    import numpy as np

    x = np.array([0.5e-9, 1.5e-9, -2.5e-9, 0.1234567885, 1e-3 / 3, 4200.0000000005, -1e7 / 3, 3e12 + 1 / 3, 0.0, 1e-30, float("inf"), float("nan")])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x[:10]], "x double").select(F.round("x", 9)).collect()]
    got = surface.rounded(x)
    assert got[:10].tolist() == want and np.isnan(got[10:]).all()
    big = np.array([3, 1 << 40, (1 << 62) + 1])
    assert surface._total(big, big) == sum(int(v) ** 2 for v in big)
    small = np.array([7, (1 << 31) - 1, 5])
    assert surface._total(small, small) == sum(int(v) ** 2 for v in small)
    r, n = np.array([0, 2, 2]), np.array([5, 1 << 33, 3])
    for rank in (np.array([1, 9, 4]), np.array([1, 1 << 33, 4])):
        assert surface._by_row(r, n, rank, 4).tolist() == [5, 0, (1 << 33) * int(rank[1]) + 12, 0]


def test_surfaces_deal_out_packed_values_not_rows(spark, sf, monkeypatch):
    """The registered queries take no path that joins ranks to rows."""
    def refuse(*_, **__):
        raise AssertionError("rows of a surface are ranked one by one")

    monkeypatch.setattr(research, "table_ic", refuse)
    assert queries.QUERIES["information_surface"](spark, sf).count() == 25
    assert queries.QUERIES["surface_peak"](spark, sf).count() == 1
    assert queries.QUERIES["surface_tests"](spark, sf).count() == 250


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_packed_tick_features_are_the_engines(spark, sf, monkeypatch, chunk):
    """Bit by bit over batches that cut instruments, with missing levels, prices and volumes, and instruments of one tick or without a token."""
    import numpy as np

    t = ticks.load(spark, sf, bad=True).where("instrument_token < 6")
    lost = lambda c, k: F.when(F.col("seq") % k != 0, F.col(c))
    t = t.withColumns({"ltp": lost("ltp", 11), "ltq": lost("ltq", 13), "b0": lost("b0", 17), "qb0": lost("qb0", 19), "a3": lost("a3", 5), "qa2": lost("qa2", 7)})
    t = t.withColumn("instrument_token", F.when(F.col("seq") % 23 == 0, None).when(F.col("seq") % 29 == 0, F.col("seq") + 100).otherwise(F.col("instrument_token"))).coalesce(1).cache()
    names = [*surface.TOLD, *surface.STRENGTH]
    want = features.tick_features(t).coalesce(1).orderBy("instrument_token", "mono_nanos", "seq").select("instrument_token", "mono_nanos", F.coalesce("ready", F.lit(False)).alias("ready"), *[F.col(n).cast("double") for n in names]).toPandas()
    seen = []
    frame = type(t)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *_: seen.append(self) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        surface.runs_ic(t)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" in plan
    rows, parts, state = seen[0].coalesce(1).orderBy("_key0", "_time0").toArrow(), [], None
    for batch in rows.combine_chunks().to_batches(max_chunksize=chunk):
        part, state = surface._running(batch, state)
        parts.append(part)
    got = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    assert got["_t"].tolist() == want["mono_nanos"].tolist() and got["_ready"].tolist() == want["ready"].tolist() and 0 < got["_ready"].sum() < len(want)
    for n in names:
        assert np.array_equal(got[n], want[n].to_numpy(dtype=float), equal_nan=True), n
    first = want.groupby("instrument_token", dropna=False)["mono_nanos"].transform("min")
    assert got["_first"].tolist() == first.tolist() and got["_new"].sum() == want["instrument_token"].nunique(dropna=False)


def test_packed_values_come_back(spark):
    import pickle

    import numpy as np

    for v in (np.array([-0.5, 0.0, 1e-9, 0.123456789, 4200.5]), np.array([1 / 3, 2.0]), np.array([1e-9, 3e12 + 0.25]), np.array([]), np.array([7.25])):
        c = np.arange(len(v))[None]
        (back, n), = pickle.loads(surface._packed({5: (v, c)})).values()
        assert surface._values_of(back).tolist() == v.tolist() and n.tolist() == c.tolist()
    v, place = surface._distinct(np.array([2.0, np.nan, 1.0, 2.0]))
    assert v.tolist() == [1.0, 2.0] and place.tolist() == [1, -1, 0, 1]
    (kept, n), index = surface._counted(np.array([1.0, 2.0, 3.0]), np.array([2, 0, 2]), np.array([[300, 1, 5]]))
    assert kept.tolist() == [1.0, 3.0] and n.tolist() == [[1, 305]] and index.tolist() == [1, 0, 1]


def test_surface_tests_start_no_python_rows(spark):
    """The cells of the surface and their sums are tables of the plan, not rows that Python workers read."""
    ic = local(spark, {"interval_ms": [500], "horizon": [1], "feature": ["a"], "n": [40], "ic": [0.5]}, "interval_ms int, horizon int, feature string, n long, ic double")
    out = research.surface_tests(ic, (500, 1000), (1,), ("a",))
    assert "LogicalRDD" not in out._jdf.queryExecution().analyzed().toString()
    assert [(r["position"], r["n"]) for r in out.orderBy("position").collect()] == [(0, 40), (1, 0)]


def test_packed_surfaces_by_day(spark, sf, monkeypatch):
    """With two keys, of which one is a string, and a feature that only the engine's windows have."""
    monkeypatch.setattr(surface, "CHUNK", 23)
    t = ticks.load(spark, sf, dense=True, dated=True, bad=True, pace=18000).where("instrument_token < 3")
    names = ("l1_obi", "ml_ofi_exp", "trade_strength", "vwap")
    rows = lambda d: {(r["interval_ms"], r["horizon"], r["feature"]): (r["n"], r["ic"]) for r in d.collect()}
    want = rows(research.table_ic(features.feature_runs(t, (1000, 2000), names, (1, 60), ticks.BY_DAY, 9), names, (1, 60), n="n_rows"))
    assert rows(surface.runs_ic(t, (1000, 2000), names, (1, 60), ticks.BY_DAY)) == want and len(want) == 16
