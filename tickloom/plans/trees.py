"""Forests and boosted ensembles of rows that are counted once where they are alike.

What a tree asks of a row is the bin of each feature, so a row is a number of 62 bits: twelve bins of
32 and its class. Rows of equal number are one with its count, and a pass over them is a histogram
in arrays. The algorithms are those of ml.train(): split points between quantiles; gini forests with
Poisson weights and a few features a node; one ensemble of regression trees a class on the gradient
of the logistic loss, the first tree with weight 1. The three kinds go through the same passes.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.sources.scratch import Scratch
from tickloom.sources.wal import file_system

BINS, BITS, CLASSES = 32, 5, 3
#: Rows that split points are found on, where there are more (Spark's trainer takes 10,000), rows that are
#: counted together, distinct rows of a shard, about, and rows of a histogram's step.
LOOKED, COUNTED, SHARD, STEP = 20_000, 1 << 18, 1 << 20, 1 << 16


@dataclass
class Ensemble:
    """A kind's parameters and its trees so far: for each iteration and class, or each tree of a forest, a heap of splits and values."""

    kind: str
    rounds: int
    depth: int
    step: float = 1.0
    share: float = 1.0
    seed: int = 42
    trees: list[list[dict]] = field(default_factory=list)
    now: list[_Growing] = field(default_factory=list)

    @property
    def forest(self) -> bool:
        return self.kind == "forest"

    def weight(self, m: int) -> float:
        return 1.0 if self.forest or m == 0 else self.step


def of_kind(kind: str, trees: int, depth: int, seed: int = 42) -> Ensemble:
    """The parameters that ml.train() gives to a kind."""
    if kind == "boosted":
        return Ensemble(kind, trees, depth, 0.1, seed=seed)
    return Ensemble(kind, trees, depth, seed=seed) if kind == "forest" else Ensemble(kind, 2 * trees, max(1, depth - 1), 0.05, 0.8, seed)


def split_points(x: np.ndarray) -> np.ndarray:
    """Points between distinct values of x that part it into BINS of about equal size; between all where these are few."""
    v, n = np.unique(x, return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(v) <= BINS:
        return between
    upto, stride = np.cumsum(n), len(x) / BINS
    out, target = [], stride
    for k in range(1, len(v)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            out.append(between[k - 1])
            target += stride
    return np.array(out[: BINS - 1])


def as_rows(columns: list[np.ndarray], points: list[np.ndarray]) -> np.ndarray:
    """The bins of features as numbers; features are taken as 32-bit floats."""
    out = np.zeros(len(columns[0]), np.int64)
    for f, (x, p) in enumerate(zip(columns, points, strict=True)):
        out |= np.searchsorted(p, x.astype(np.float32).astype(float), "left").astype(np.int64) << (BITS * f)
    return out


def _bins(numbers: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(numbers >> (BITS * f) & (BINS - 1)).astype(np.uint8) for f in range(n)])


def fit(train: DataFrame, ensembles: list[Ensemble], features: tuple[str, ...] = schema.MODEL_FEATURES) -> list[np.ndarray]:
    """Grow the ensembles on train's features and class, all rows of it; returns the features' split points.

    What reaches the driver is LOOKED rows, and for each pass a histogram from each task.
    """
    spark = train.sparkSession
    scratch = Scratch(spark)
    if len(features) * BITS + 2 > 63:
        raise ValueError("too many features for a row's number")
    total = train.count()
    some = train.select(*[F.col(f).cast("float").cast("double") for f in features])
    some = (some if total <= LOOKED else some.sample(LOOKED / total, seed=42)).toArrow()
    points = [split_points(some[f].to_numpy()) for f in features]
    cores = spark.sparkContext.defaultParallelism
    shards = max(cores, -(-total // SHARD))
    folder = f"{scratch.root}/shards"
    store, where = file_system(folder)
    store.create_dir(where, recursive=True)
    counted = train.select(*features, "class").mapInArrow(partial(_count, points=points, shards=shards), "shard int, numbers binary, counts binary")

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, folder)

    counted.groupBy("shard").applyInArrow(merge, "shard int").count()
    while growing := [e for e in ensembles if len(e.trees) < e.rounds and not (e.forest and e.trees)]:
        # Each of them grows a level a pass; a forest's trees all at once.
        for e in growing:
            e.now = e.now or [_Growing(e.depth) for _ in range(e.rounds if e.forest else CLASSES)]
        tasks = spark.range(0, shards, 1, min(shards, cores)).mapInArrow(partial(_look, folder=folder, ensembles=growing, n=len(features)), "e int, h binary")
        sums: dict[int, np.ndarray] = {}
        for row in tasks.collect():
            h = np.frombuffer(row["h"])
            sums[row["e"]] = sums[row["e"]] + h if row["e"] in sums else h
        for k, e in enumerate(growing):
            level = e.now[0].level
            parts = CLASSES if e.forest else 2
            h = sums[k].reshape(len(e.now), 1 << level, parts, len(features), BINS)
            if level == 0 and len(e.trees) > 1:
                _drop(folder, e, len(e.trees) - 1, shards)
            rng = np.random.default_rng([e.seed, len(e.trees), level])
            for tree, own in zip(e.now, h, strict=True):
                tree.grow(own, e.forest, rng)
            if e.now[0].level == e.depth:
                e.trees.append([t.heap() for t in e.now])
                e.now = []
    for e in ensembles:
        if e.forest:
            e.trees = [[t] for t in e.trees[0]]
    store.delete_dir(where)
    return points


class _Growing:
    """A tree that grows by levels, as a heap: node k has the children 2 k + 1 and 2 k + 2; a node without a split sends all rows left."""

    def __init__(self, depth: int):
        self.level, self.depth = 0, depth
        self.feature, self.bin = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS, np.int64)
        self.value: dict[int, np.ndarray] = {}
        self.ended: set[int] = set()

    def grow(self, h: np.ndarray, forest: bool, rng: np.random.Generator) -> None:
        """Split the nodes of the level by their histograms (node, class or [count, sum], feature, bin)."""
        nodes, parts, n, _ = h.shape
        for i in range(nodes):
            k = (1 << self.level) - 1 + i
            whole = h[i, :, 0].sum(axis=1)
            self.value.setdefault(k, whole)
            left = np.cumsum(h[i], axis=2)[:, :, :-1]
            right = whole[:, None, None] - left
            with np.errstate(all="ignore"):
                if forest:
                    a, b = left.sum(axis=0), right.sum(axis=0)
                    gain = (left**2).sum(axis=0) / a + (right**2).sum(axis=0) / b - (whole**2).sum() / whole.sum()
                    there = (a >= 1) & (b >= 1)
                    chosen = rng.choice(n, ceil(sqrt(n)), replace=False)
                    there &= np.isin(np.arange(n), chosen)[:, None]
                else:
                    gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
                    there = (left[0] >= 1) & (right[0] >= 1)
            gain = np.where(there, gain, -np.inf)
            best = int(np.argmax(gain))
            if k not in self.ended and gain.flat[best] > 1e-12 * max(1.0, whole.sum() if forest else whole[0]):
                f, s = divmod(best, BINS - 1)
                self.feature[k], self.bin[k] = f, s
                self.value[2 * k + 1], self.value[2 * k + 2] = left[:, f, s], right[:, f, s]
            else:
                self.value[2 * k + 1], self.value[2 * k + 2] = self.value[k], np.zeros_like(whole)
                self.ended |= {2 * k + 1, 2 * k + 2}
        self.level += 1

    def heap(self) -> dict:
        ends = np.stack([self.value[(1 << self.depth) - 1 + i] for i in range(1 << self.depth)])
        return {"feature": self.feature, "bin": self.bin, "ends": ends}


def _walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The place of each row among the nodes of a level."""
    place, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for level in range(levels):
        k = place + (1 << level) - 1
        place = 2 * place + (bins[feature[k], at] > cut[k]) if level else 2 * place + (bins[feature[0]] > cut[0])
    return place


def _leaf(tree: dict, forest: bool) -> np.ndarray:
    """What a tree says at each of its ends: shares of classes, or a mean."""
    with np.errstate(all="ignore"):
        if forest:
            return np.nan_to_num(tree["ends"] / tree["ends"].sum(axis=1, keepdims=True))
        return np.nan_to_num(tree["ends"][:, 1] / tree["ends"][:, 0])


def _count(batches: Iterator[pa.RecordBatch], points: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows as numbers with their class, each once with its count, dealt to shards."""
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        numbers, counts = np.unique(np.concatenate(held), return_counts=True)
        shard = ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        parts = [(s, order[a:b]) for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([numbers[k].tobytes() for _, k in parts], pa.binary()), pa.array([counts[k].tobytes() for _, k in parts], pa.binary())], names=["shard", "numbers", "counts"])

    held, size = [], 0
    for b in batches:
        *x, y = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        held.append(as_rows(x, points) | y.astype(np.int64) << (BITS * len(points)))
        size += len(b)
        if size >= COUNTED:
            yield counted(held)
            held, size = [], 0
    if size:
        yield counted(held)


def _save(path: str, *arrays: np.ndarray) -> None:
    """Arrays as a file that is whole when it has its name."""
    store, where = file_system(path)
    part, whole = f"{where}.{uuid.uuid4().hex}", io.BytesIO()
    for a in arrays:
        np.save(whole, a)
    with store.open_output_stream(part) as f:
        f.write(whole.getbuffer())
    store.move(part, where)


def _load(path: str, n: int) -> list[np.ndarray]:
    store, where = file_system(path)
    with store.open_input_stream(where) as f:
        whole = io.BytesIO(f.read())
    return [np.load(whole) for _ in range(n)]


def _merge(table: pa.Table, folder: str) -> pa.Table:
    """A shard's rows, each once with its count, as a file."""
    numbers, counts = (np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in table[c]]) for c in ("numbers", "counts"))
    every, place = np.unique(numbers, return_inverse=True)
    shard = table["shard"][0].as_py()
    _save(f"{folder}/{shard}", every, np.bincount(place, counts, len(every)))
    return pa.table({"shard": pa.array([shard], pa.int32())})


def _margins_at(folder: str, e: Ensemble, m: int, shard: int) -> str:
    return f"{folder}/{shard}-{e.kind}-{m}"


def _drop(folder: str, e: Ensemble, m: int, shards: int) -> None:
    for s in range(shards):
        store, where = file_system(_margins_at(folder, e, m, s))
        if store.get_file_info(where).is_file:
            store.delete_file(where)


def _drawn(e: Ensemble, counts: np.ndarray, tree: int, shard: int) -> np.ndarray:
    """How often each row is drawn: of a forest's tree, or of a part of the rows in an iteration. As if each of equal rows were drawn apart."""
    rng = np.random.default_rng([e.seed, tree, shard])
    if e.forest:
        return rng.poisson(counts).astype(float)
    if e.share == 1:
        return counts
    out = (rng.random(len(counts), np.float32) < e.share).astype(float)
    more = np.flatnonzero(counts > 1)
    out[more] = rng.binomial(counts[more].astype(np.int64), e.share)
    return out


def _look(batches: Iterator[pa.RecordBatch], folder: str, ensembles: list[Ensemble], n: int) -> Iterator[pa.RecordBatch]:
    """The histograms of these shards for the next level of each ensemble."""
    sums: dict[int, np.ndarray] = {}
    for shard in (s for b in batches for s in b[0].to_pylist()):
        store, where = file_system(f"{folder}/{shard}")
        if not store.get_file_info(where).is_file:  # no row was dealt to it
            continue
        numbers, counts = _load(f"{folder}/{shard}", 2)
        bins, kind = _bins(numbers, n), numbers >> (BITS * n)
        pairs = [bins[f].astype(np.int64) * BINS + (bins[f + 1] if f + 1 < n else 0) for f in range(0, n, 2)]
        for k, e in enumerate(ensembles):
            h = _histograms(e, bins, pairs, kind, counts, folder, shard)
            sums[k] = sums[k] + h if k in sums else h
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([h.tobytes() for h in sums.values()], pa.binary())], names=["e", "h"])


def _histograms(e, bins, pairs, kind, counts, folder, shard) -> np.ndarray:
    n, size, m, level = len(bins), len(counts), len(e.trees), e.now[0].level
    parts = CLASSES if e.forest else 2
    margins = None
    if not e.forest and m:
        if level == 0:
            margins = _load(_margins_at(folder, e, m - 1, shard), 1)[0] if m > 1 else np.zeros((CLASSES, size))
            for c, tree in enumerate(e.trees[-1]):
                margins[c] += e.weight(m - 1) * _leaf(tree, False)[_walk(bins, tree["feature"], tree["bin"], e.depth)]
            _save(_margins_at(folder, e, m, shard), margins)
        else:
            margins = _load(_margins_at(folder, e, m, shard), 1)[0]
    out = np.zeros((len(e.now), 1 << level, parts, n, BINS))
    drawn = None
    for c, tree in enumerate(e.now):
        if e.forest or drawn is None:
            drawn = _drawn(e, counts, c if e.forest else m, shard)
        place = _walk(bins, tree.feature, tree.bin, level)
        if e.forest:
            place, weights = place * CLASSES + kind, [drawn]
        else:
            y = np.where(kind == c, 1.0, -1.0)
            weights = [drawn, drawn * (y if margins is None else 4 * y / (1 + np.exp(2 * y * margins[c])))]
        place = place * (BINS * BINS)
        rows = len(out[c]) * (CLASSES if e.forest else 1)
        for p, pair in enumerate(pairs):
            both = [np.zeros(rows * BINS * BINS) for _ in weights]
            for a in range(0, size, STEP):
                index = place[a : a + STEP] + pair[a : a + STEP]
                for total, w in zip(both, weights, strict=True):
                    total += np.bincount(index, w[a : a + STEP], len(total))
            for q, total in enumerate(both):
                cube = total.reshape(-1, CLASSES, BINS, BINS) if e.forest else total.reshape(-1, 1, BINS, BINS)
                to = slice(None) if e.forest else slice(q, q + 1)
                out[c][:, to, 2 * p] = cube.sum(axis=3)
                if 2 * p + 1 < n:
                    out[c][:, to, 2 * p + 1] = cube.sum(axis=2)
    return out


def scored(e: Ensemble, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score, probability up less probability down, and the class (0, 1, 2) by a grown ensemble."""
    shares = np.zeros((CLASSES, bins.shape[1]))
    for m, trees in enumerate(e.trees):
        for c, tree in enumerate(trees):
            said = _leaf(tree, e.forest)[_walk(bins, tree["feature"], tree["bin"], e.depth)]
            if e.forest:
                shares += said.T
            else:
                shares[c] += e.weight(m) * said
    p = shares if e.forest else 1 / (1 + np.exp(-2 * shares))
    p = p / p.sum(axis=0)
    return np.clip(p[2] - p[0], -1.0, 1.0), np.argmax(p, axis=0)


def predicted(rows: DataFrame, ensembles: list[Ensemble], points: list[np.ndarray], keep: tuple[str, ...], features: tuple[str, ...] = schema.MODEL_FEATURES) -> DataFrame:
    """Columns keep of rows with score_<k> and predicted_<k> (-1, 0, 1) by each ensemble."""
    kinds = dict(rows.select(*keep).dtypes)
    shape = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"score_{k} double, predicted_{k} int" for k in range(len(ensembles))])
    return rows.select(*keep, *[F.col(f).alias(f"_f{i}") for i, f in enumerate(features)]).mapInArrow(partial(_predicted, ensembles=ensembles, points=points, n=len(keep)), shape)


def _predicted(batches: Iterator[pa.RecordBatch], ensembles: list[Ensemble], points: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        numbers, place = np.unique(as_rows([c.to_numpy(zero_copy_only=False) for c in b.columns[n:]], points), return_inverse=True)
        bins, columns, names = _bins(numbers, len(points)), list(b.columns[:n]), b.schema.names[:n]
        for k, e in enumerate(ensembles):
            score, kind = scored(e, bins)
            columns += [pa.array(score[place]), pa.array((kind - 1).astype(np.int32)[place])]
            names += [f"score_{k}", f"predicted_{k}"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
