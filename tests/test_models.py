"""Models: forests and boosted ensembles, their ONNX files, and what is done when a file is not sound."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.plans import features, ml, onnx_file, queries, research
from tickloom.sources import ticks


@pytest.fixture(scope="module")
def rows(spark, sf):
    t = ml.matrix(features.feature_table(ticks.load(spark, sf)))
    # Classes that the features can tell, as the generated returns are noise.
    y = F.when(F.col("l1_obi") > 0.3, 1).when(F.col("l1_obi") < -0.3, -1).otherwise(0)
    return t.withColumn("y_5s", y).withColumn("class", (y + 1).cast("double")).select("instrument_token", "grid_seq", "w_obi_lin", *[f for f in schema.MODEL_FEATURES if f != "w_obi_lin"], "micro_pressure_bps", "y_5s", "r_5s", "class").persist()


@pytest.mark.parametrize("kind", ml.KINDS)
def test_files_give_the_models_probabilities(spark, rows, tmp_path, kind):
    model, took = ml.train(rows, trees=4, depth=3, kind=kind)
    assert took > 0
    own = ml.predict(model, rows)
    assert own.columns[-6:] == ["mode", "score", "p_down", "p_neutral", "p_up", "predicted"] and not [c for c in own.columns if c.startswith("_")]
    total = F.abs(F.col("p_down") + F.col("p_neutral") + F.col("p_up") - 1)
    assert own.where((total > 1e-9) | (F.abs("score") > 1)).count() == 0
    assert ml.accuracy(own).first()["accuracy"] > 0.9
    facts = ml.save_onnx(model, str(tmp_path), rows)
    assert facts["verified"]["match_rate"] == 1 and facts["opset"] == 15 and facts["input"]["shape"] == ["N", 12]
    key = F.concat_ws(":", "instrument_token", "grid_seq")
    found = ml.verify(own.withColumn("k", key), ml.onnx_predict(rows, str(tmp_path)).withColumn("k", key), "k").first()
    assert found["max_error"] < ml.TOLERANCE and found["match_rate"] == 1
    used = ml.adaptive(str(tmp_path), rows)
    assert {r["mode"] for r in used.select("mode").distinct().collect()} == {"MODE_MODEL_ACTIVE"} and used.columns == own.columns
    ml.save(model, str(tmp_path / "p"))
    again = ml.predict(ml.load(str(tmp_path / "p")), rows)
    assert ml.verify(own.withColumn("k", key), again.withColumn("k", key), "k").first()["max_error"] == 0
    assert ml.onnx_predict(rows.limit(0), str(tmp_path)).count() == 0


def test_unsound_files_fall_back_to_the_baseline(spark, rows, tmp_path):
    model, _ = ml.train(rows, trees=2, depth=2)
    ml.save_onnx(model, str(tmp_path), rows)
    whole, said = (tmp_path / "model.onnx").read_bytes(), json.loads((tmp_path / "metadata.json").read_text())

    def changed(**more):
        (tmp_path / "model.onnx").write_bytes(more.pop("data", whole))
        (tmp_path / "metadata.json").write_text(json.dumps(said | more))

    import hashlib

    cases = [
        ({"data": whole[:-7]}, "hash"), ({"data": b"no model", "sha256": hashlib.sha256(b"no model").hexdigest()}, "can't be run"),
        ({"features": said["features"][::-1]}, "features"), ({"n_features": 11}, "features"), ({"labels": [1, 0, -1]}, "labels"), ({"opset": 9}, "opset"),
        ({"input": {"name": "features", "dtype": "float64", "shape": ["N", 12]}}, "input"), ({"input": {"name": "x", "dtype": "float32", "shape": ["N", 12]}}, "input"),
        ({"outputs": {"probabilities": "tensor"}}, "output"), ({"sha256": "0"}, "hash"), ({"outputs": None}, "not whole"),
    ]
    for more, why in cases:
        changed(**more)
        with pytest.raises(ValueError, match=why):
            ml.load_onnx(str(tmp_path))
        assert ml.adaptive(str(tmp_path), rows).select("mode").distinct().first()[0] == "MODE_BASELINE_ACTIVE"
    changed()
    ml.load_onnx(str(tmp_path), {"sha256": said["sha256"]})
    with pytest.raises(ValueError, match="hash"):
        ml.load_onnx(str(tmp_path), {"sha256": "1"})
    (tmp_path / "metadata.json").unlink()
    with pytest.raises(ValueError, match="missing"):
        ml.load_onnx(str(tmp_path))
    for path in (None, str(tmp_path / "nowhere"), str(tmp_path)):
        assert ml.adaptive(path, rows).select("mode").distinct().first()[0] == "MODE_BASELINE_ACTIVE"


def test_undefined_features_raise(spark, rows, tmp_path):
    model, _ = ml.train(rows, trees=2, depth=2)
    ml.save_onnx(model, str(tmp_path), rows)
    for bad in (F.lit(float("nan")), F.lit(None).cast("double"), F.lit(float("inf"))):
        with pytest.raises(Exception, match="not finite"):
            ml.onnx_predict(rows.limit(5).withColumn("l1_obi", bad), str(tmp_path)).collect()


def test_thresholds_are_rounded_down():
    for x in (0.1, -0.1, 1 / 3, 1e-45, 16777217.0, 0.5):
        assert onnx_file._float_below(x) <= x
    with pytest.raises(ValueError, match="one of"):
        ml._stage("other", 1, 1, 1)


def test_report_evaluates_the_table_once(spark, sf, monkeypatch):
    """Folds are found on a written table in the models' columns, with all rows of the feature table that models can take."""
    class Seen(Exception):
        pass

    def folds(df, *_):
        raise Seen(df)

    monkeypatch.setattr(research, "walk_forward", folds)
    with pytest.raises(Seen) as seen:
        queries.QUERIES["ml_report"](spark, sf)
    df = seen.value.args[0]
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = ml.matrix(features.feature_table(ticks.load(spark, sf))).withColumn("t", F.col("grid_nanos")).select(*df.columns)
    assert df.exceptAll(want).count() == 0 and df.count() == want.count() > 1000
