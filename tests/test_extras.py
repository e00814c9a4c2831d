"""Operators beyond the feature table: what their SQL does not show."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import extras


def test_segments_and_undefined_values(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(extras.segment(F.col("x"), (1.0, 2.0), ("a", "b", "c"))).collect()] == ["a", "b", "c", None, None]


def test_deflated_sharpe_by_the_formula(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.08, 1, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "r double")
    got = extras.deflated_sharpe(df, "r", 20, 0.002)
    sharpe = x.mean() / x.std(ddof=1)
    z = (x - x.mean()) / x.std()
    n = NormalDist()
    best = 0.002**0.5 * ((1 - 0.5772156649015329) * n.inv_cdf(1 - 1 / 20) + 0.5772156649015329 * n.inv_cdf(1 - 1 / (20 * np.e)))
    want = n.cdf((sharpe - best) * np.sqrt(499) / np.sqrt(1 - (z**3).mean() * sharpe + ((z**4).mean() - 1) / 4 * sharpe**2))
    assert got["available"] and got["sharpe"] == pytest.approx(sharpe) and got["deflated"] == pytest.approx(want, abs=1e-9)
    assert extras.deflated_sharpe(df, "r", 1, 0.0)["expected_best"] == 0
    assert not extras.deflated_sharpe(df.limit(2), "r", 5, 0.1)["available"]
    assert not extras.deflated_sharpe(df.withColumn("r", F.lit(1.0)), "r", 5, 0.1)["available"]


def test_depths_beyond_the_book(spark):
    rows = spark.createDataFrame([(10, 0, None, 5), (0, 0, 0, 0)], "qb0 long, qa0 long, qb1 long, qa1 long")
    got = extras.depth_imbalances(rows, (1, 2)).collect()
    assert [(r["obi_1"], r["obi_2"]) for r in got] == [(1.0, pytest.approx(1 / 3)), (0.0, 0.0)]
