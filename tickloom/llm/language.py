"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of the lowered whole text, square-rooted and scaled to length one.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import ragged
from tickloom.llm.samples import fold, stratified

#: Hash buckets, and the n-gram lengths in bytes.
BUCKETS, GRAMS = 1 << 13, (1, 2, 3, 4)
#: Labelled documents of each language that the models are fitted on, and of all languages together.
PER_LANGUAGE, MOST_ROWS = 500, 4000
#: Languages that one model can hold: so many samples of 20 rows fit in the driver.
MOST_LANGUAGES = 256
#: Families of ISO 639-1 codes (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
}
UNDETERMINED = "und"


def family(lang: str) -> str:
    """The family of a language code."""
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def _prepared(x: np.ndarray) -> np.ndarray:
    """Lowered text with everything that is neither letter nor beyond ASCII as a space."""
    x = ragged.latin_lower(x)
    return np.where((x >= 0x80) | ((x >= 97) & (x <= 122)), x, np.uint8(32))


def features(x: np.ndarray) -> np.ndarray:
    """Dense vector of one prepared text."""
    total = np.zeros(BUCKETS)
    h = np.zeros(x.size, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if x.size < n:
            break
        h = h[: x.size - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            total += np.bincount(((h * np.uint32(0x9E3779B1)) >> np.uint32(7)) % np.uint32(BUCKETS), minlength=BUCKETS)
    v = np.sqrt(total).astype(np.float32)
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm else v


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights of linear SVMs with squared hinge loss, a column for each column of y (1 or -1); classes weigh alike.

    The last column of x is the constant 1, whose weight is the bias.
    """
    n_up = np.maximum(1, (y > 0).sum(axis=0))
    n_down = np.maximum(1, (y < 0).sum(axis=0))
    share = np.where(y > 0, 0.5 / n_up, 0.5 / n_down).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v, t, step = w.copy(), 1.0, 1 / (4 + penalty)
    for _ in range(rounds):  # Nesterov's accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * (x.T @ (share * slack * y)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = (new + ((t - 1) / t2) * (new - w)).astype(np.float32)
        w, t = new.astype(np.float32), t2
    return w


@dataclass
class Model:
    """families and, for each, its languages; all weights as columns of one matrix (bias in the last row)."""

    families: list[str]
    languages: list[list[str]]
    weights: np.ndarray
    pairs: list[tuple[int, int, int]]  # (family, language, language), after the columns of families

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language of one prepared text and a confidence from 0 to 1."""
        if not self.families:
            return UNDETERMINED, 0.0
        m = features(x) @ self.weights[:-1] + self.weights[-1]
        sure = lambda z: float(1 / (1 + np.exp(-4 * z)))
        f, score = 0, 1.0
        if len(self.families) > 1:
            order = np.argsort(-m[: len(self.families)], kind="stable")
            f, score = int(order[0]), sure((m[order[0]] - m[order[1]]) / 2)
        langs = self.languages[f]
        votes = np.zeros(len(langs))
        least = [9.0] * len(langs)
        for k, (g, a, b) in enumerate(self.pairs):
            if g == f:
                z = float(m[len(self.families) + k])
                votes[a if z > 0 else b] += 1 + 1e-3 * min(abs(z), 9)  # margins break ties
                least[a], least[b] = min(least[a], z), min(least[b], -z)
        best = int(votes.argmax())
        if len(langs) > 1:
            score *= sure(least[best])
        return langs[best], round(score, 6)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model of docs' text and non-null lang, on about per_language distinct documents of each language.

    Rows without a letter teach nothing, rows that repeat doc_id, text and lang teach once; a null
    doc_id is one more id. With more languages than MOST_ROWS // per_language all get smaller shares, of about 20 rows at least. Beyond
    most_languages the most frequent ones are learned, and a warning names the others.
    """
    counts = docs.where("lang is not null and text is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2 * most_languages)
    langs = [r["lang"] for r in counts.collect()]
    if len(langs) > most_languages:
        warnings.warn(f"{most_languages} languages are learned; left out: {', '.join(langs[most_languages:])}", stacklevel=2)
        langs = langs[:most_languages]
    each = min(per_language, max(20, MOST_ROWS // max(1, len(langs))))
    wanted = docs.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = stratified(wanted, "lang", each, ("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for _, x, bounds in ragged.slices(ragged.column(batch, "text")):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                p = _prepared(x[a:b])
                v = features(p) if (p != 32).any() else np.zeros(0, np.float32)
                at = np.flatnonzero(v)
                out.append(at.astype("<u2").tobytes() + v[at].astype("<f4").tobytes())
        return [pa.array(out, pa.binary())]

    got = ragged.append(rows, run, [T.StructField("features", T.BinaryType())], drop=("text",)).select("lang", "features").collect()
    got = sorted((r["lang"], bytes(r["features"])) for r in got if len(r["features"]))
    x = np.zeros((len(got), BUCKETS + 1), np.float32)
    x[:, -1] = 1
    for i, (_, data) in enumerate(got):
        n = len(data) // 6
        x[i, np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", n, 2 * n)
    lang = np.array([g[0] for g in got], dtype=object)
    langs = sorted(set(lang))
    families = sorted({family(v) for v in langs})
    members = [[v for v in langs if family(v) == f] for f in families]
    group = np.array([families.index(family(v)) for v in lang], np.int64)
    if len(families) > 1:
        weights = [fit_svm(x, np.where(group[:, None] == np.arange(len(families)), 1, -1).astype(np.float32))]
    else:
        weights = [np.zeros((BUCKETS + 1, len(families)), np.float32)]
    pairs = []
    for f, own in enumerate(members):
        for a, b in combinations(range(len(own)), 2):
            some = np.flatnonzero((lang == own[a]) | (lang == own[b]))
            weights.append(fit_svm(x[some], np.where(lang[some] == own[a], 1, -1).astype(np.float32)[:, None]))
            pairs.append((f, a, b))
    return Model(families, members, np.concatenate(weights, axis=1), pairs)


def predict(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone.

    A null text, an empty one or one without a letter is UNDETERMINED with score 0, as is every
    text if the model has learned no language. Repeated rows are treated alike; other columns
    stay, save those named like a new one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, scores = [], []
        column = ragged.column(batch, "text")
        for first, x, bounds in ragged.slices(column):
            p = _prepared(x)
            ascii_letters = np.concatenate([[0], np.cumsum((p >= 97) & (p <= 122))])
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if ascii_letters[b] > ascii_letters[a] or any(map(str.isalpha, column[first + k].as_py() or "")):
                    lang, score = held.value.predict(p[a:b])
                else:
                    lang, score = UNDETERMINED, 0.0
                langs.append(lang)
                scores.append(score)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return ragged.append(docs, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], drop)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: languages of all documents, learned from those outside fold 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    found = predict(docs.select("doc_id", "text"), fit(docs.where(~held_out)), drop=("text",))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
