"""Quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words, runs of signs, and line ends. Features are hashed n-grams of lowered tokens
(1 and 2) and of their shapes (1 to 3), where a word's shape is its case, whether it has
digits, and whether it repeats the token before the last sign; a feature's value is its share
of the text's n-grams. A score is a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import ragged
from tickloom.llm.samples import collected, fold, labelled
from tickloom.sources.scratch import Scratch

#: Hash buckets.
BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on, by label, passes over them, and the most bytes of all those of a label.
#: Twice as many good ones: a text too short to tell is taken as good.
PER_LABEL, PASSES, MOST_BYTES = {0: 1500, 1: 3000}, 3, 12_000_000
#: FTRL-proximal: learning rate, its smoothing, and the two regularisers.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
#: Shares of n-grams are scaled by this, so that weights stay small.
SCALE = 20.0
#: Added to a text's number of n-grams, so that a few of them decide little.
PRIOR = 40

_SIGN = ~ragged.byte_flags([*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100), 0x20, *range(0x09, 0x0E), 0])
_NAME = ragged.byte_flags([*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)])


def features(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram of rows of bytes, in no order."""
    low = ragged.ascii_lower(x)
    parts = []
    for kind, flag in enumerate((_NAME[x], _SIGN[x], x == 10)):
        starts, ends, row = ragged.runs(flag, bounds)
        parts.append((starts, ends, row, np.full(starts.size, kind), ragged.run_hashes(low, flag, starts, ends) if kind < 2 else np.full(starts.size, 10, np.uint64)))
    starts, ends, row, kind, h = (np.concatenate(v) for v in zip(*parts, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, row, kind, h = starts[order], ends[order], row[order], kind[order], h[order]
    if not starts.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper = np.concatenate([[0], np.cumsum((x >= 65) & (x <= 90))])
    digit = np.concatenate([[0], np.cumsum((x >= 48) & (x <= 57))])
    n_upper, n_digit, length = upper[ends] - upper[starts], digit[ends] - digit[starts], ends - starts
    first_upper = (x[starts] >= 65) & (x[starts] <= 90)
    case = np.select([n_digit > 0, n_upper == 0, first_upper & (n_upper == 1), n_upper == length], [1, 2, 3, 4], 5)
    words = np.flatnonzero(kind == 0)
    repeats = np.zeros(starts.size, bool)
    if words.size > 1:
        repeats[words[1:]] = (h[words[1:]] == h[words[:-1]]) & (row[words[1:]] == row[words[:-1]])
    shape = ragged.mix(np.where(kind == 0, (case + 8 * repeats).astype(np.uint64), h ^ np.uint64(0xABCDEF)))
    buckets, rows = [], []
    for salt, (tokens, grams) in enumerate(((h, (1, 2)), (shape, (1, 2, 3)))):
        for n in grams:
            w = ragged.window_hashes(tokens ^ np.uint64(salt * 977 + 1), n)
            if w.size:
                whole = row[: w.size] == row[n - 1 :]
                buckets.append((w[whole] >> np.uint64(46)).astype(np.int64))
                rows.append(row[: w.size][whole])
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, x, bounds in ragged.slices(column):
            bucket, row = features(x, bounds)
            n = len(bounds) - 1
            z = SCALE * np.bincount(row, self.weights[bucket], n) / (PRIOR + np.bincount(row, minlength=n)) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.round(np.concatenate(out), 9) if out else np.zeros(0)


def train(texts: list[str], labels: np.ndarray, passes: int = PASSES, seed: int = 5) -> Model:
    """FTRL-proximal over the examples in a fixed random order."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -5.0 if len(labels) and not labels[0] else 5.0)
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the bias
    examples = []
    for t in texts:
        x, bounds = ragged.raw(pa.array([t], pa.string()))
        at, count = np.unique(features(x, bounds)[0], return_counts=True)
        examples.append((np.append(at, BUCKETS).astype(np.int32), np.append(SCALE * count / (PRIOR + count.sum()), 1.0).astype(np.float32)))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(examples)):
            at, value = examples[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - labels[i]) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str, per_label: dict[int, int] = PER_LABEL, most_bytes: int = MOST_BYTES) -> Model:
    """A model of labels' column label (0 or 1, by doc_id) on about per_label documents, of most_bytes a label at most.

    A document labelled twice takes the higher label; null labels, null ids and documents without
    text teach nothing, rows that repeat id and text teach once. Length decides nothing: where the
    bytes don't suffice there are fewer documents. With no label or one only, the score is the same for every text.
    """
    scratch = Scratch(docs.sparkSession)
    rows = collected(labelled(scratch, docs, labels, label, per_label, strict=False), "label", ("doc_id", "text"), per_label, most_bytes)
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone.

    A null or empty text has the score of the bias. Repeated rows are treated alike; other
    columns stay, save those named like a new one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = held.value.score(ragged.column(batch, "text"))
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    return ragged.append(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], drop)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: quality of all documents, learned from labels outside fold 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(fold("doc_id", 3) != 1), "quality")
    return score(docs, model, drop=("text",)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
