"""Classifiers on the feature table: one pipeline for fitting and serving, with a baseline to fall back on."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import schema, scores
from tickloom.plans import onnx_file, research
from tickloom.sources.scratch import Scratch
from tickloom.sources.wal import file_system

TARGET = "y_5s"
#: Classes of the model by index, and the labels they stand for (fixed values).
LABELS = (-1, 0, 1)
STD_FLOOR = 1e-12


def matrix(table: DataFrame, target: str = TARGET, features: tuple[str, ...] = schema.MODEL_FEATURES) -> DataFrame:
    """Rows whose features and return are all defined, with class (0, 1, 2) of the label."""
    kept = table.dropna(subset=[*features, "r" + target[1:]])
    return kept.withColumn("class", (F.col(target) + 1).cast("double"))


def scaler(train: DataFrame, features: tuple[str, ...] = schema.MODEL_FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature; 1 for one that hardly varies."""
    row = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] if (row[f"s_{f}"] or 0.0) >= STD_FLOOR else 1.0) for f in features}


def standardized(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """df with each feature as (x - mean) / std; a value that is not finite raises."""
    return df.withColumns({f: scores.standardize(F.col(f), m, s) for f, (m, s) in stats.items()})


#: The kinds of models. Boosted ones are one ensemble a class against the others; the fine one grows
#: more and smaller steps on a part of the rows, as a second booster beside the first.
KINDS = ("forest", "boosted", "boosted_fine")


def _stage(kind: str, trees: int, depth: int, seed: int):
    if kind == "forest":
        return RandomForestClassifier(featuresCol="vector", labelCol="class", numTrees=trees, maxDepth=depth, seed=seed)
    if kind not in KINDS:
        raise ValueError(f"a model is one of {', '.join(KINDS)}")
    fine = {"stepSize": 0.05, "subsamplingRate": 0.8, "maxIter": 2 * trees, "maxDepth": max(1, depth - 1)}
    booster = GBTClassifier(featuresCol="vector", labelCol="class", seed=seed, **(fine if kind == "boosted_fine" else {"stepSize": 0.1, "maxIter": trees, "maxDepth": depth}))
    return OneVsRest(featuresCol="vector", labelCol="class", classifier=booster)


def train(rows: DataFrame, features: tuple[str, ...] = schema.MODEL_FEATURES, trees: int = 20, depth: int = 5, seed: int = 42, kind: str = "forest") -> tuple[PipelineModel, float]:
    """A fitted three-class model of a kind on raw features, taken as 32-bit floats as the exported file takes them, and the seconds it took."""
    began = time.perf_counter()
    floats = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS _f_{f}" for f in features) + " FROM __THIS__")
    vector = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="vector", handleInvalid="skip")
    model = Pipeline(stages=[floats, vector, _stage(kind, trees, depth, seed)]).fit(rows)
    return model, time.perf_counter() - began


def _scored(out: DataFrame) -> DataFrame:
    """out (with the three probabilities) with mode and score."""
    return out.withColumns({"mode": F.lit("MODE_MODEL_ACTIVE"), "score": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p_up") - F.col("p_down")))})


def predict(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    """rows with mode, label, score and the three probabilities; by the baseline, without probabilities, if there is no model."""
    if model is None:
        score = scores.baseline_score(F.col("w_obi_lin"), F.col("trade_strength"), F.col("micro_pressure_bps"))
        none = F.lit(None).cast("double")
        return rows.withColumns({"mode": F.lit("MODE_BASELINE_ACTIVE"), "score": score, "p_down": none, "p_neutral": none, "p_up": none}).withColumn("predicted", scores.band(F.col("score")))
    out = model.transform(rows)
    if "probability" in out.columns:
        out = out.withColumn("_p", vector_to_array("probability"))
    else:  # a margin for each class against the others: their logistic values as shares of the sum
        each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        out = out.withColumn("_e", each).withColumn("_p", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)))
    p = lambda k: F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0))
    out = out.withColumns({"p_down": p(0), "p_neutral": p(1), "p_up": p(2), "predicted": (F.col("prediction") - 1).cast("int")})
    return _scored(out).select(*rows.columns, "mode", "score", "p_down", "p_neutral", "p_up", "predicted")


def adaptive(path: str | None, rows: DataFrame, expected: dict | None = None) -> DataFrame:
    """predict() with the model saved at path, an ONNX file or a pipeline, or the baseline if it is missing or fails its checks."""
    try:
        if path and _exists(f"{path}/model.onnx"):
            load_onnx(path, expected)
            return onnx_predict(rows, path, expected)
        return predict(load(path, expected) if path else None, rows)
    except Exception:  # any fault of a model means the baseline
        return predict(None, rows)


#: The most bytes of an ONNX file, as it is broadcast.
MOST_ONNX_BYTES = 64 << 20
#: Largest difference of a probability between a model and its file.
TOLERANCE = 1e-5


def _exists(path: str) -> bool:
    from pyarrow import fs

    store, where = file_system(path)
    return store.get_file_info(where).type == fs.FileType.File


def _trees(model, classes: dict[int, float] | None) -> list[list[onnx_file.Node]]:
    """The trees of a fitted ensemble as nodes: classes maps each class to its sign of a regression tree's value, or None takes a leaf's shares."""
    spark = _session()
    scratch = Scratch(spark)
    path = f"{scratch.root}/model"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the size of the model
    weights = model.treeWeights
    by_tree: dict[int, dict[int, object]] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for t in sorted(by_tree):
        nodes = by_tree[t]
        place = {i: k for k, i in enumerate(sorted(nodes))}
        tree = []
        for i in sorted(nodes):
            r = nodes[i]
            if r["leftChild"] >= 0:
                tree.append(onnx_file.Node(r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0], place[r["leftChild"]], place[r["rightChild"]]))
            elif classes is None:
                total = sum(r["impurityStats"]) or 1.0
                tree.append(onnx_file.Node(weights={c: v / total for c, v in enumerate(r["impurityStats"])}))
            else:
                tree.append(onnx_file.Node(weights={c: s * weights[t] * r["prediction"] for c, s in classes.items()}))
        out.append(tree)
    return out


def to_onnx(model: PipelineModel, features: tuple[str, ...] = schema.MODEL_FEATURES) -> bytes:
    """The fitted pipeline as an ONNX file: features in order, classes 0, 1, 2."""
    last = model.stages[-1]
    facts = {"features": ",".join(features), "labels": ",".join(map(str, LABELS))}
    if isinstance(last, OneVsRestModel):
        trees = [t for c, m in enumerate(last.models) for t in _trees(m, {c: 2.0})]  # the logistic function of twice the margin
        return onnx_file.classifier(trees, len(LABELS), len(features), True, facts)
    return onnx_file.classifier(_trees(last, None), len(LABELS), len(features), False, facts)


def save_onnx(model: PipelineModel, path: str, check: DataFrame, most_rows: int = 2000, stats: dict | None = None, features: tuple[str, ...] = schema.MODEL_FEATURES) -> dict:
    """Write model.onnx and metadata.json into the folder path, after the file has given the model's own probabilities and classes on rows of check.

    Raises ValueError, and writes nothing, if a probability is off by more than TOLERANCE or a class differs.
    """
    data = to_onnx(model, features)
    some = check.limit(most_rows).withColumn("_row", F.monotonically_increasing_id()).select("_row", *features)
    some = Scratch(check.sparkSession).write(some)
    found = verify(predict(model, some), _predicted(some, data, features), "_row").first()
    if found["max_error"] is None or found["max_error"] > TOLERANCE or found["match_rate"] < 1:
        raise ValueError(f"the file does not give the model's probabilities: {found.asDict()}")
    facts = {
        "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "opset": onnx_file.OPSET, "ml_opset": onnx_file.ML_OPSET,
        "features": list(features), "n_features": len(features), "labels": list(LABELS), "classes": len(LABELS),
        "input": {"name": "features", "dtype": "float32", "shape": ["N", len(features)]},
        "outputs": {"label": {"dtype": "int64", "shape": ["N"]}, "probabilities": "sequence<map<int64,float32>>"},
        "verified": {"max_error": found["max_error"], "mean_error": found["mean_error"], "match_rate": found["match_rate"]}, "scaler": stats or {},
    }
    store, where = file_system(path)
    store.create_dir(where, recursive=True)
    for name, body in (("model.onnx", data), ("metadata.json", json.dumps(facts).encode())):
        with store.open_output_stream(f"{where}/{name}") as f:
            f.write(body)
    return facts


def load_onnx(path: str, expected: dict | None = None, features: tuple[str, ...] = schema.MODEL_FEATURES) -> tuple[bytes, dict]:
    """The file in the folder path and its metadata, if all that they promise holds; else ValueError."""
    import onnxruntime

    if not (_exists(f"{path}/model.onnx") and _exists(f"{path}/metadata.json")):
        raise ValueError("the model or its metadata is missing")
    store, where = file_system(path)
    if store.get_file_info(f"{where}/model.onnx").size > MOST_ONNX_BYTES:
        raise ValueError("the model is too large to be broadcast")
    data, said = (bytes(store.open_input_stream(f"{where}/{n}").read()) for n in ("model.onnx", "metadata.json"))
    try:
        said = json.loads(said)
        true = {
            "hash": hashlib.sha256(data).hexdigest() == said["sha256"] == (expected or said)["sha256"],
            "features": said["features"] == list(features) and said["n_features"] == len(features),
            "labels": said["labels"] == list(LABELS) and said["classes"] == len(LABELS),
            "input": said["input"]["dtype"] == "float32" and said["input"]["shape"] == ["N", len(features)],
            "output": said["outputs"]["probabilities"] == "sequence<map<int64,float32>>",
            "opset": (said["opset"], said["ml_opset"]) == (onnx_file.OPSET, onnx_file.ML_OPSET),
        }
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ValueError(f"the metadata is not whole: {e}") from e
    if wrong := [k for k, ok in true.items() if not ok]:
        raise ValueError(f"the model is not the one its metadata describes: {', '.join(wrong)}")
    try:
        session = onnxruntime.InferenceSession(data, providers=["CPUExecutionProvider"])
    except Exception as e:
        raise ValueError(f"the model can't be run: {e}") from e
    given = session.get_inputs()
    if len(given) != 1 or given[0].name != said["input"]["name"] or given[0].type != "tensor(float)" or list(given[0].shape)[1:] != [len(features)]:
        raise ValueError("the model's input is not what its metadata says")
    if [o.name for o in session.get_outputs()] != ["label", "probabilities"]:
        raise ValueError("the model's outputs are not label and probabilities")
    return data, said


def onnx_predict(rows: DataFrame, path: str, expected: dict | None = None, features: tuple[str, ...] = schema.MODEL_FEATURES) -> DataFrame:
    """rows with mode, score, the three probabilities and predicted by the verified file in the folder path. A value that is not finite raises."""
    return _predicted(rows, load_onnx(path, expected, features)[0], features)


def _predicted(rows: DataFrame, data: bytes, features: tuple[str, ...]) -> DataFrame:
    """By the bytes of a file, broadcast; one session a task, Arrow batches as [N, features] floats."""
    import pandas as pd

    held = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        import numpy as np
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(held.value, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for columns in batches:
            x = np.stack([c.to_numpy(dtype=np.float32, na_value=np.nan) for c in columns], axis=1)
            if not np.isfinite(x).all():
                raise ValueError("feature is not finite")
            label, out = session.run(["label", "probabilities"], {name: x}) if len(x) else ([], [])
            p = np.array([[row.get(k, 0.0) for k in range(len(LABELS))] for row in out], float).reshape(-1, len(LABELS))
            yield pd.DataFrame({"p_down": p[:, 0], "p_neutral": p[:, 1], "p_up": p[:, 2], "predicted": np.asarray(label, np.int32) - 1})

    score = F.pandas_udf(run, "p_down double, p_neutral double, p_up double, predicted int", functionType=F.PandasUDFType.SCALAR_ITER)
    out = _scored(rows.withColumn("_p", score(*features)).select(*rows.columns, "_p.*"))
    return out.select(*rows.columns, "mode", "score", "p_down", "p_neutral", "p_up", "predicted")


def accuracy(predicted: DataFrame, target: str = TARGET) -> DataFrame:
    return predicted.agg(F.avg((F.col("predicted") == F.col(target)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def model_ic(predicted: DataFrame, target: str = "r_5s") -> DataFrame:
    """Rank correlation of the score with the return, with its t statistic and p-value."""
    cells = predicted.select(F.lit("score").alias("feature"), F.col("score").alias("x"), F.col(target).alias("y")).dropna()
    return research.tested(research.rank_ic(cells, ("feature",)))


def metadata(model: PipelineModel, features: tuple[str, ...] = schema.MODEL_FEATURES, stats: dict | None = None) -> dict:
    """What must hold of a model before it is used: features in order, labels, scaler, and a hash of its trees."""
    last = model.stages[-1]
    parts = [m.toDebugString for m in last.models] if isinstance(last, OneVsRestModel) else [last.toDebugString]
    body = "".join(p[p.index("\n") :] for p in parts)  # the first line holds a uid that differs from run to run
    classes = len(parts) if isinstance(last, OneVsRestModel) else last.numClasses
    return {"features": list(features), "labels": list(LABELS), "classes": classes, "sha256": hashlib.sha256(body.encode()).hexdigest(), "scaler": stats or {}}


def save(model: PipelineModel, path: str, stats: dict | None = None) -> dict:
    """Write the pipeline and its metadata beside it."""
    model.write().overwrite().save(f"{path}/pipeline")
    facts = metadata(model, stats=stats)
    _session().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return facts


def load(path: str, expected: dict | None = None) -> PipelineModel:
    """The pipeline at path, if its features, labels and hash are what its metadata, and expected, say; else ValueError."""
    model = PipelineModel.load(f"{path}/pipeline")
    said = json.loads(_session().read.text(f"{path}/metadata").first()[0])
    features = tuple(c.removeprefix("_f_") for c in model.stages[1].getInputCols())
    if features != schema.MODEL_FEATURES or list(features) != said["features"] or said["labels"] != list(LABELS):
        raise ValueError("the model's features or labels are not in the agreed order")
    found = metadata(model)
    if found["sha256"] != said["sha256"] or expected and expected.get("sha256") != said["sha256"]:
        raise ValueError("the model is not the one its metadata describes")
    return model


def verify(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Largest and mean absolute difference of probabilities, and the share of equal classes, of two predictions."""
    one = a.select(key, *[F.col(c).alias(f"{c}_a") for c in ("p_down", "p_neutral", "p_up", "predicted")])
    two = b.select(key, *[F.col(c).alias(f"{c}_b") for c in ("p_down", "p_neutral", "p_up", "predicted")])
    gap = F.greatest(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in ("p_down", "p_neutral", "p_up")])
    return one.join(two, key).agg(F.max(gap).alias("max_error"), F.avg(gap).alias("mean_error"), F.avg((F.col("predicted_a") == F.col("predicted_b")).cast("int")).alias("match_rate"))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()
