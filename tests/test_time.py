"""Grids, targets, costs, sessions, folds and tests against golden values and sequential models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema, scores
from tickloom.operators import flow, grid, targets
from tickloom.plans import research

MS = schema.MS


def ticks(spark, rows):
    return spark.createDataFrame([(int(k), int(t), i, float(p)) for i, (k, t, p) in enumerate(rows)], "instrument_token long, mono_nanos long, seq long, ltp double")


def test_locf(spark):
    df = ticks(spark, [(1, 0, 2500), (1, 400 * MS, 2501), (1, 1200 * MS, 2505), (1, 3000 * MS, 2506)])
    out = grid.resample(df).orderBy("grid_seq").collect()
    assert [(r["grid_nanos"] // MS, r["ltp"], r["snapshot_age_ms"]) for r in out] == [(1000, 2501, 600), (2000, 2505, 800), (3000, 2505, 1800)]
    on = grid.resample(df, inclusive=True).where("grid_seq = 3").collect()
    assert on == []  # the tick at 3 s has no successor
    assert grid.resample(df, inclusive=True, flush=F.lit(3500 * MS)).where("grid_seq = 3").first()["ltp"] == 2506


def test_five_grids_and_flush(spark):
    df = ticks(spark, [(1, 0, 2500)])
    n = {r["interval_ms"]: r["count"] for r in grid.resample(df, schema.INTERVALS_MS, flush=F.lit(1000 * MS)).groupBy("interval_ms").count().collect()}
    assert n == {100: 10, 250: 4, 500: 2, 1000: 1}
    assert grid.resample(df, (2000,), flush=F.lit(2000 * MS)).count() == 1


def sequential(rows, delta):
    """One token's grid, tick by tick."""
    out, first, step, held = [], None, 1, None
    for t, s, p in sorted(rows):
        if first is None:
            first = t
        else:
            while first + step * delta <= t:
                out.append((step, held[1], held[2]))
                step += 1
        held = (t, s, p)
    return out


def test_grid_equals_a_sequential_model_in_any_order(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 100, 250, rng.randint(0, 9000)]) * MS, rng.random()) for k in (1, 2, 3) for _ in range(150)]
    df = ticks(spark, rows)
    got = grid.resample(df.repartition(7).orderBy(F.rand(3)), (100, 500)).collect()
    for k in (1, 2, 3):
        for ms in (100, 500):
            want = sequential([(t, i, float(p)) for i, (kk, t, p) in enumerate(rows) if kk == k], ms * MS)
            assert sorted((r["grid_seq"], r["seq"], r["ltp"]) for r in got if r["instrument_token"] == k and r["interval_ms"] == ms) == want


def test_gaps_and_staleness(spark):
    r = flow.arrival_gaps(ticks(spark, [(1, 100, 1), (1, 120, 1), (1, 200, 1), (2, 5, 1)])).orderBy("instrument_token").collect()
    assert (r[0]["n_gaps"], r[0]["mean_gap"], r[0]["min_gap"], r[0]["max_gap"]) == (2, 50.0, 20, 80)
    assert (r[1]["n_gaps"], r[1]["mean_gap"], r[1]["n_updates"]) == (0, 0.0, 1)
    s = grid.staleness(grid.resample(ticks(spark, [(1, 0, 1), (1, 7000 * MS, 1)]))).first()
    assert (s["n_points"], s["n_stale"]) == (7, 2)


def test_crossed_duration(spark):
    rows = [(1, 0, 0, 1499.0, 1500.0), (1, 10 * MS, 1, 1502.0, 1500.0), (1, 25 * MS, 2, 1503.0, 1500.0)]
    df = spark.createDataFrame([(*r, 1.0, 2000.0) for r in rows], "instrument_token long, mono_nanos long, seq long, b0 double, a0 double, b1 double, a1 double")
    assert flow.crossed_duration(df).first()["crossed_nanos"] == 15 * MS


def test_forward_returns(spark):
    df = spark.createDataFrame([(1, 1000, k, k * schema.SECOND, schema.SECOND, 1000.0 + k) for k in range(66)], "instrument_token long, interval_ms int, grid_seq long, grid_nanos long, delta_nanos long, mid_price double")
    out = {r["grid_seq"]: r for r in targets.returns(df).collect()}
    for h in schema.HORIZONS_SEC:
        assert out[0][f"r_{h}s"] == pytest.approx(math.log((1000 + h) / 1000))
    assert out[10]["r_1s"] is None and out[5]["r_60s"] is not None


def test_thresholds_labels_costs(spark):
    one = spark.range(1)
    t = lambda spread: one.select(scores.threshold(F.lit(schema.SECOND), 4 * schema.SECOND, F.lit(spread), F.lit(1000.0))).first()[0]
    assert t(0.10) == pytest.approx(0.0004) and t(2.0) == pytest.approx(0.001)
    assert [one.select(scores.label(F.lit(r), F.lit(0.0005))).first()[0] for r in (0.0008, -0.0007, 0.0002)] == [1, -1, 0]
    assert one.select(scores.label(F.lit(None).cast("double"), F.lit(0.0005))).first()[0] == 0
    assert scores.fixed_cost() == pytest.approx(0.000824452, abs=1e-9)
    assert scores.fixed_cost(scores.SCHEDULES[0]) == pytest.approx(0.00083578, abs=1e-8)
    assert scores.fixed_cost(value=0.0) == 0.0
    r = one.select(scores.long_return(F.lit(1001.0), F.lit(1003.0), 0.0), scores.short_return(F.lit(1000.0), F.lit(998.0), 0.0)).first()
    assert tuple(r) == (pytest.approx(2 / 1001), pytest.approx(2 / 1000))


def test_schedules_by_day(spark):
    df = spark.createDataFrame([("2024-09-30",), ("2024-10-01",), (None,), ("2020-01-01",)], "d string").select(F.to_date("d").alias("day"))
    got = {str(r["day"]): r["schedule"] for r in scores.with_schedule(df, "day").collect()}
    assert got == {"2024-09-30": "NSE_EQUITY_LEGACY_2023", "2020-01-01": "NSE_EQUITY_LEGACY_2023", "2024-10-01": "NSE_EQUITY_OCT_2024", "None": "NSE_EQUITY_OCT_2024"}


def test_session_phases(spark):
    # Indian time is 5:30 ahead of UTC; 2024-01-02 is a Tuesday, 6 and 7 are a weekend.
    at = lambda day, hm: f"2024-01-{day:02d} {hm}"
    rows = [(at(2, t), p) for t, p in (("03:00", "CLOSED"), ("03:35", "PRE_OPEN_ORDER_ENTRY"), ("03:40", "PRE_OPEN_MATCHING"), ("03:45", "CONTINUOUS_TRADING"), ("09:15", "CONTINUOUS_TRADING"), ("10:00", "POST_CLOSE"), ("10:15", "POST_CLOSE"), ("10:35", "CLOSED"))]
    rows += [(at(6, "06:00"), "CLOSED"), (at(7, "06:00"), "CLOSED")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(scores.session_phase(F.to_timestamp("t")) != F.col("want")).count() == 0


def test_purge_and_folds(spark):
    df = spark.createDataFrame([(float(t),) for t in range(100)], "t double")
    assert df.where(research.purged(F.col("t"), 50.0, 60.0, 5, 5, 2)).count() == 25
    assert spark.range(1).select(research.purged(F.lit(50 - 5 - 1e-12), 50.0, 60.0, 5, 5, 2)).first()[0]
    s = research.walk_forward(df, "t", 3, 5, 5, 2)
    n = {(r["fold"], r["part"]): r["count"] for r in s.groupBy("fold", "part").count().collect()}
    assert n == {(0, "train"): 18, (1, "train"): 43, (2, "train"): 68, (0, "test"): 25, (1, "test"): 25, (2, "test"): 25}
    assert research.violations(s, "t", 5, 5, 2).count() == 0
    with pytest.raises(ValueError, match="not enough"):
        research.fold_bounds(df.limit(3), 3)


def test_rank_correlation_equals_pandas(spark):
    import pandas as pd

    rng = random.Random(1)
    rows = [(f, rng.randint(0, 30) / 3, rng.choice([rng.random(), 0.5])) for f in "ab" for _ in range(400)] + [("c", 1.0, 2.0)] * 5
    df = spark.createDataFrame(rows, "feature string, x double, y double")
    got = {r["feature"]: r for r in research.rank_ic(df, ("feature",)).collect()}
    pdf = pd.DataFrame(rows, columns=["f", "x", "y"])
    for f in "ab":
        p = pdf[pdf.f == f]
        assert got[f]["ic"] == pytest.approx(p.x.rank().corr(p.y.rank()), abs=1e-12)
    assert got["c"]["ic"] is None and got["c"]["n"] == 5


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.005, 0.5]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, position int, p_value double")
    out = research.benjamini_hochberg(df).orderBy("position").collect()
    assert [r["rejected"] for r in out] == [True, True, True, False, True, False]
    assert [r["p_adjusted"] for r in out] == [pytest.approx(v) if v is not None else None for v in (0.025, 0.05, 0.05, None, 0.025, 0.5)]


def test_student_tail():
    assert research.student_p(2.0, 10) == pytest.approx(0.0733880348)
    assert research.student_p(12.7062047364, 1) == pytest.approx(0.05)
    assert research.student_p(0.0, 5) == 1.0


def test_baseline(spark):
    r = spark.range(1).select(scores.baseline_score(F.lit(1.0), F.lit(1.0), F.lit(0.0)), scores.baseline_score(F.lit(None).cast("double"), F.lit(float("nan")), F.lit(None).cast("double"))).first()
    assert tuple(r) == (pytest.approx(0.7), 0.0)
    assert [spark.range(1).select(scores.band(F.lit(x))).first()[0] for x in (0.2, -0.2, 0.15)] == [1, -1, 0]
