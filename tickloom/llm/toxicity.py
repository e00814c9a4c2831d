"""Toxicity: embeddings of subwords, averaged over passages, into a linear softmax.

A word is the bag of its byte n-grams and the word itself, each hashed to a row of one
embedding table; a passage of a few words is the mean of its rows and goes to a two-class
softmax. A document is as toxic as its worst passage. Table and softmax are trained jointly
in numpy, so a misspelling that was never seen shares most of its rows with words that were.
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

#: Rows of the embedding table, its width, and the n-gram lengths in bytes (a word's edges count).
BUCKETS, WIDTH, GRAMS = 1 << 18, 8, (3, 4, 5)
#: Words in a passage.
PASSAGE = 3
#: Labelled documents that the model is fitted on, by label, and the most bytes of all those of a label.
PER_LABEL, MOST_BYTES = {0: 3000, 1: 1500}, 6_000_000
#: Rounds of full-batch training: on means of whole documents first, then on worst passages.
WARM, ROUNDS = 8, 45

_WORD = ragged.WORDLIKE.copy()
_WORD[0x2A] = True  # an asterisk hides letters


@dataclass
class Bags:
    """Subwords of texts: bucket and place of each, the words' places, and the texts' words."""

    bucket: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    count: np.ndarray
    size: int

    def __post_init__(self) -> None:
        self.counted = np.concatenate([[0], np.cumsum(np.bincount(self.place, minlength=self.size))])


def bags(x: np.ndarray, bounds: np.ndarray) -> Bags:
    """Subwords of rows of bytes. A place is a byte's, counted with one space before each row."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    spaced = np.full(x.size + n + 1, 32, np.uint8)
    x = ragged.latin_lower(x)
    spaced[np.arange(x.size) + row + 1] = np.where(_WORD[x], x, 32)
    edges = bounds + np.arange(n + 1)
    flag = spaced != 32
    starts, ends, owner = ragged.runs(flag, np.concatenate([edges, [spaced.size]]))
    spaces = np.concatenate([[0], np.cumsum(~flag)])
    buckets, places = [], []
    h = np.zeros(spaced.size, np.uint32)
    for k in range(1, max(GRAMS) + 1):
        if spaced.size < k:
            break
        h = h[: spaced.size - k + 1] * np.uint32(0x01000193) + spaced[k - 1 :] + np.uint32(k)
        if k in GRAMS:
            inside = spaces[k - 1 : spaces.size - 1] - spaces[1 : spaces.size - k + 1]
            at = np.flatnonzero(inside == 0)
            buckets.append((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(14))
            places.append(at + 1)
    buckets.append((ragged.run_hashes(spaced, flag, starts, ends) >> np.uint64(46)).astype(np.uint32))
    places.append(starts)
    return Bags(np.concatenate(buckets), np.concatenate(places), starts, ends, np.bincount(owner, minlength=n)[:n], spaced.size)


def worst(b: Bags, value: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text with words: the logit of its worst passage, and that passage's first and last place."""
    summed = np.concatenate([[0.0], np.cumsum(np.bincount(b.place, value[b.bucket], b.size))])
    counted = b.counted
    filled = np.flatnonzero(b.count)
    first = (np.cumsum(b.count) - b.count)[filled]
    last_word = np.repeat(first + b.count[filled] - 1, b.count[filled])
    upto = b.ends[np.minimum(np.arange(b.starts.size) + PASSAGE - 1, last_word)]
    z = (summed[upto] - summed[b.starts]) / np.maximum(1, counted[upto] - counted[b.starts]) + bias
    top = np.maximum.reduceat(z, first) if first.size else np.zeros(0)
    at = np.flatnonzero(z == np.repeat(top, b.count[filled]))
    at = at[np.searchsorted(at, first)]  # the first of equals
    return top, b.starts[at], upto[at]


@dataclass
class Model:
    """The softmax applied to each embedding row: what a subword adds to the logit, and the bias."""

    value: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, x, bounds in ragged.slices(column):
            b = bags(x, bounds)
            z = np.full(len(bounds) - 1, self.bias)
            z[b.count > 0] = worst(b, self.value, self.bias)[0]
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.round(np.concatenate(out), 9) if out else np.zeros(0)


@dataclass
class _Words:
    """Training texts as numbers of distinct words, each with its bag of subwords: far less than a bag for each text."""

    word: np.ndarray  # of each place in the texts
    count: np.ndarray  # places of each text
    bucket: np.ndarray
    owner: np.ndarray  # the word of each bucket
    n_subwords: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> _Words:
        hashes, counts, spelling = [], [], {}
        for _, x, bounds in ragged.slices(pa.array(texts, pa.large_string())):
            x = ragged.latin_lower(x)
            flag = _WORD[x]
            starts, ends, row = ragged.runs(flag, bounds)
            h = ragged.run_hashes(x, flag, starts, ends)
            hashes.append(h)
            counts.append(np.bincount(row, minlength=len(bounds) - 1))
            values, at = np.unique(h, return_index=True)
            for v, k in zip(values.tolist(), at.tolist(), strict=True):
                if v not in spelling:
                    spelling[v] = x[starts[k] : ends[k]].tobytes()
        known = np.array(sorted(spelling), np.uint64)
        word = np.searchsorted(known, np.concatenate(hashes) if hashes else known).astype(np.int32)
        x, bounds = ragged.raw(pa.array([spelling[v] for v in known.tolist()], pa.binary()))
        b = bags(x, bounds)
        owner = (np.searchsorted(b.starts, b.place, "right") - 1).astype(np.int32)
        return cls(word, np.concatenate(counts) if counts else np.zeros(0, np.int64), b.bucket, owner, np.bincount(owner, minlength=known.size))


def train(texts: list[str], labels: np.ndarray, rate: float = 0.15, seed: int = 7) -> Model:
    """Fit table and softmax jointly by full-batch AdaGrad; both labels weigh alike."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 5.0 if len(labels) and labels[0] else -5.0)
    w = _Words.of(texts)
    y = labels.astype(np.float64)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 1, WIDTH).astype(np.float32)  # difference of the two classes' weights
    bias = 0.0
    seen_t, seen_s, seen_b = np.full((BUCKETS, WIDTH), 1e-10, np.float32), np.full(WIDTH, 1e-10, np.float32), 1e-10
    filled = np.flatnonzero(w.count)
    count = w.count[filled]
    first = np.cumsum(count) - count
    counted = np.concatenate([[0], np.cumsum(w.n_subwords[w.word])]).astype(np.int32)
    upto = np.minimum(np.arange(PASSAGE, w.word.size + PASSAGE, dtype=np.int32), np.repeat((first + count).astype(np.int32), count))  # a passage's words: from its place to here
    inside = np.maximum(1, counted[upto] - counted[:-1])
    for round_ in range(ROUNDS):
        value = (table @ soft).astype(np.float64)
        of_word = np.bincount(w.owner, value[w.bucket], w.n_subwords.size)
        summed = np.concatenate([[0.0], np.cumsum(of_word[w.word])])
        if round_ < WARM:
            lo, hi = first, first + count
            z = (summed[hi] - summed[lo]) / np.maximum(1, counted[hi] - counted[lo]) + bias
        else:
            each = summed[upto]
            each -= summed[:-1]
            each /= inside
            each += bias
            z = np.maximum.reduceat(each, first) if first.size else np.zeros(0)
            at = np.flatnonzero(each == np.repeat(z, count))
            lo = at[np.searchsorted(at, first)]  # the first of equals
            hi = upto[lo]
        slope = weight[filled] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[filled])
        # Each subword inside the passage chosen in its text gets the text's slope.
        size = hi - lo
        on = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        of_word = np.bincount(w.word[on], np.repeat(slope / np.maximum(1, counted[hi] - counted[lo]), size), w.n_subwords.size)
        rows = np.bincount(w.bucket, of_word[w.owner], BUCKETS).astype(np.float32)
        used = np.flatnonzero(rows)
        grad_t = rows[used, None] * soft
        grad_s = rows[used] @ table[used]
        seen_t[used] += grad_t**2
        table[used] -= rate * grad_t / np.sqrt(seen_t[used])
        seen_s += grad_s**2
        soft -= rate * grad_s / np.sqrt(seen_s)
        grad_b = float(slope.sum())
        seen_b += grad_b**2
        bias -= rate * grad_b / np.sqrt(seen_b)
    return Model((table @ soft).astype(np.float32), float(bias))


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

    A null or empty text, or one without words, has the score of the bias. Repeated rows are
    treated alike; other columns stay, save those named like a new one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = held.value.score(ragged.column(batch, "text"))
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    return ragged.append(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], drop)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: toxicity of all documents, learned from labels outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0), "toxic")
    return score(docs, model, drop=("text",)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
