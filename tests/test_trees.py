"""The trainer on counted rows against Spark's, which is given the same rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.plans import features, ml, rows, trees
from tickloom.sources import ticks

F12 = schema.MODEL_FEATURES


@pytest.fixture(scope="module")
def table(spark, sf):
    return rows.model_rows(ticks.load(spark, sf)).where("t % 3 = 0").persist()


def scores_of(table, e, points):
    return {tuple(r)[:2]: r["score_0"] for r in trees.predicted(table, [e], points, ("t", "microprice")).collect()}


def test_boosted_trees_are_sparks(spark, table):
    """Same split points, splits, means and steps: scores are those of ml.train(), but of a few rows where two splits are equally good."""
    e = trees.of_kind("boosted", 2, 3)
    points = trees.fit(table, [e])
    model, _ = ml.train(table, trees=2, depth=3, kind="boosted")
    want = {(r["t"], r["microprice"]): r["score"] for r in ml.predict(model, table).select("t", "microprice", "score").collect()}
    got = scores_of(table, e, points)
    assert got.keys() == want.keys() and len(got) > 1000 and len(set(want.values())) > 10
    gaps = np.array([abs(got[k] - want[k]) for k in want])
    assert (gaps < 1e-9).mean() > 0.99 and gaps.max() < 0.02


def test_equal_rows_are_counted(spark, table, monkeypatch):
    """A table three times over gives the same trees, in many shards and steps, and no file stays."""
    one, three = (trees.of_kind("boosted", 2, 3) for _ in range(2))
    points = trees.fit(table, [one])
    seen = []
    monkeypatch.setattr(trees, "SHARD", 500)
    monkeypatch.setattr(trees, "Scratch", lambda s, make=trees.Scratch: seen.append(make(s)) or seen[-1])
    again = trees.fit(table.union(table).union(table), [three])
    assert all(np.array_equal(a, b) for a, b in zip(points, again, strict=True))
    assert scores_of(table, three, again) == pytest.approx(scores_of(table, one, points), abs=1e-9)
    assert not os.path.exists(f"{seen[0].root.removeprefix('file:')}/shards")


def test_forest_and_parts_of_rows(spark, table):
    """A forest and a booster on a part of the rows learn what the features tell, as ml.train()'s do."""
    y = F.when(F.col("l1_obi") > 0.3, 2.0).when(F.col("l1_obi") < -0.3, 0.0).otherwise(1.0)
    told = table.withColumn("class", y)
    grown = [trees.of_kind(kind, 8, 4) for kind in ml.KINDS]
    points = trees.fit(told, grown)
    assert [len(e.trees) for e in grown] == [8, 8, 16] and len({repr(t) for t in grown[0].trees}) == 8
    p = trees.predicted(told, grown, points, ("class",))
    n = p.count()
    for k in range(3):
        assert p.where(F.col(f"predicted_{k}") == F.col("class") - 1).count() > 0.9 * n
        assert p.where(F.abs(f"score_{k}") > 1).count() == 0


def test_split_points():
    assert list(trees.split_points(np.array([3.0, 1.0, 1.0, 2.0]))) == [1.5, 2.5]
    points = trees.split_points(np.random.default_rng(1).normal(size=5000))
    sizes = np.bincount(np.searchsorted(points, np.random.default_rng(1).normal(size=5000), "left"))
    assert len(points) == 31 and sizes.min() > 120 and sizes.max() < 190


def test_model_rows_are_the_matrix(spark, sf):
    """Bit by bit those of the feature table, with bad books too."""
    t = ticks.load(spark, sf, bad=True)
    want = ml.matrix(features.feature_table(t)).select(F.col("grid_nanos").alias("t"), *F12, "y_5s", "r_5s", "class")
    got = rows.model_rows(t)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.count() == want.count() > 1000 and got.exceptAll(want).count() == 0
