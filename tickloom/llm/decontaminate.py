"""Benchmark decontamination: words of a document that lie inside an occurrence of a benchmark window.

The benchmark's windows are a broadcast hash set; a document's windows are looked up in it
and each hit is verified against the benchmark's words. A benchmark over the broadcast bound is
taken in blocks, one after another: each is scanned against all documents, what it finds is
written, and the findings are united at the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import ragged
from tickloom.llm.marks import MARKED, marked
from tickloom.sources.scratch import Scratch

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark words that one broadcast set is made from (a set takes some ten times as much), and words of one piece of a long item.
BLOCK_BYTES, PIECE_WORDS = 8 << 20, 10_000

_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_HIT = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _words(text: str | None) -> list[bytes]:
    """Words of one text: runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    x = ragged.ascii_lower(np.frombuffer((text or "").encode(), np.uint8))
    return np.where(ragged.WORDLIKE[x], x, 32).astype(np.uint8).tobytes().split()


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id and words of the benchmark, joined by single spaces, each item in pieces that share window - 1 words; repeated ones once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py())
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    if piece:
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b" ".join(piece)], pa.binary())], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, words binary").distinct()


class WindowSet:
    """Windows of benchmark pieces by hash, as arrays: for each window length the sorted hashes, a place where each
    window stands in the words, and the items it stands in."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int = WINDOW):
        pieces = sorted(pieces, key=lambda p: (p[0] is None, p[0], p[1]))
        self.names = sorted({n for n, _ in pieces if n is not None})
        number = {n: k for k, n in enumerate(self.names)}
        self.words, bounds = ragged.raw(pa.array([b" " + w for _, w in pieces], pa.binary()))
        flag = self.words != 32
        self.starts, self.ends, row = ragged.runs(flag, bounds)
        h = ragged.run_hashes(self.words, flag, self.starts, self.ends)
        count = np.bincount(row, minlength=len(pieces))
        owner = np.array([number.get(n, -1) for n, _ in pieces], np.int64)
        self.sorted: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.others: dict[tuple[int, int], list[tuple[int, int]]] = {}  # windows whose hash another one has as well
        for n in sorted(set(np.minimum(count, window).tolist()) - {0}):
            w = ragged.window_hashes(h, n)
            last = row[n - 1 :]
            at = np.flatnonzero((row[: w.size] == last) & (np.minimum(count[last], window) == n))
            at = at[np.argsort(w[at], kind="stable")]
            hashes, first, which = np.unique(w[at], return_index=True, return_inverse=True)
            self.sorted[n], self.place[n] = hashes, at[first]
            for k in np.flatnonzero(~self._same(n, at, at[first][which])).tolist():
                self.others.setdefault((n, int(w[at[k]])), []).append((int(at[k]), int(owner[row[at[k]]])))
            true = self._same(n, at, at[first][which]) & (owner[row[at]] >= 0)
            # One number for each window and item that go together.
            both = np.unique(which[true].astype(np.int64) * max(1, len(self.names)) + owner[row[at[true]]])
            of, item = both // max(1, len(self.names)), both % max(1, len(self.names))
            self.owners[n] = np.searchsorted(of, np.arange(hashes.size + 1)), item.astype(np.int32)
            self.bits[n] = np.zeros(1 << max(16, int(hashes.size).bit_length() + 3), bool)
            self.bits[n][hashes & np.uint64(self.bits[n].size - 1)] = True

    def text(self, at: int, n: int) -> bytes:
        """The n words from place at on."""
        return self.words[self.starts[at] : self.ends[at + n - 1]].tobytes()

    def _same(self, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at places a and b are the same words, compared byte by byte in slices."""
        out = np.zeros(a.size, bool)
        length = self.ends[a + n - 1] - self.starts[a]
        out[length == self.ends[b + n - 1] - self.starts[b]] = True
        out_at = np.flatnonzero(out & (a != b))
        for lo in range(0, out_at.size, 20_000):
            k = out_at[lo : lo + 20_000]
            size = length[k]
            first = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(first, size)
            equal = self.words[np.repeat(self.starts[a[k]], size) + inside] == self.words[np.repeat(self.starts[b[k]], size) + inside]
            out[k] = np.logical_and.reduceat(equal, first)
        return out

    def _items(self, n: int, h: int, k: int, words: bytes) -> list[int] | None:
        """The items with this window, -1 for one without an id; None if no item has these words."""
        if self.text(int(self.place[n][k]), n) == words:
            bounds, item = self.owners[n]
            return item[bounds[k] : bounds[k + 1]].tolist()
        found = [i for at, i in self.others.get((n, h), ()) if self.text(at, n) == words]
        return found or None

    def find(self, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: its words, the united word ranges [first, last) that are hit, and the items."""
        counts: list[int] = []
        hits: list[list[tuple[int, int]]] = []
        items: list[list[str]] = []
        for _, x, bounds in ragged.slices(column):
            x = ragged.ascii_lower(x)
            flag = ragged.WORDLIKE[x]
            starts, ends, row = ragged.runs(flag, bounds)
            h = ragged.run_hashes(x, flag, starts, ends)
            n_rows = len(bounds) - 1
            count = np.bincount(row, minlength=n_rows)
            first_word = np.cumsum(count) - count
            found: dict[int, list[tuple[int, int]]] = defaultdict(list)
            owners: dict[int, set[int]] = defaultdict(set)
            for n, known in self.sorted.items():
                w = ragged.window_hashes(h, n)
                if not w.size:
                    continue
                bits = self.bits[n]
                at = np.flatnonzero(bits[w & np.uint64(bits.size - 1)] & (row[: w.size] == row[n - 1 :]))
                place = np.minimum(np.searchsorted(known, w[at]), known.size - 1)
                true = np.flatnonzero(known[place] == w[at])
                for k, p in zip(at[true].tolist(), place[true].tolist(), strict=True):
                    words = b" ".join(x[starts[j] : ends[j]].tobytes() for j in range(k, k + n))
                    names = self._items(n, int(w[k]), p, words)
                    if names is not None:
                        d = int(row[k])
                        found[d].append((k - int(first_word[d]), k - int(first_word[d]) + n))
                        owners[d].update(names)
            counts += count.tolist()
            for d in range(n_rows):
                hits.append(united(found[d]) if d in found else [])
                items.append(sorted(self.names[i] for i in owners[d] if i >= 0) if d in owners else [])
        return counts, hits, items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [first, last) as the fewest disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, hits (word ranges [first, last) inside benchmark windows) and items (their ids as strings).

    benchmark has item_id and text; items without words have no window, shorter ones than a
    window are one; repeated items count once. An item without an id is hit like others but adds none to items. A null or empty text has no words. Repeated rows are treated alike; other
    columns stay, save those named like a new one. With no benchmark item nothing is hit.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(_pieces(benchmark, window))
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words") + F.lit(1)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))

    def windows(k: int):
        some = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k)
        return docs.sparkSession.sparkContext.broadcast(WindowSet([(r[0], bytes(r[1])) for r in some.collect()], window))

    def scan(held):
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            n, hits, owners = held.value.find(ragged.column(batch, "text"))
            return [pa.array(n, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in h] for h in hits], pa.list_(_HIT)), pa.array(owners, pa.list_(pa.string()))]

        return run

    if blocks == 1:
        return ragged.append(docs, scan(windows(0)), _FIELDS, drop)
    # What is found depends on the text alone, so findings are kept by its hash, once for each text.
    keys = {"_tickloom_a": F.xxhash64("text"), "_tickloom_b": F.xxhash64(F.lit(1), "text")}
    texts = docs.where("text is not null").select("text", *[c.alias(n) for n, c in keys.items()])
    parts = []
    for k in range(blocks):
        held = windows(k)
        found = ragged.append(texts, scan(held), _FIELDS, ("text",)).where(F.size("hits") > 0)
        parts.append(scratch.write(found.groupBy(*keys).agg(F.first("hits").alias("hits"), F.first("items").alias("items"))))
        held.destroy()
    every = reduce(DataFrame.union, parts).groupBy(*keys).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))  # a row a block at most
    every = scratch.write(every.select(*keys, _united(F.array_sort("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items")))
    gone = {f.name for f in _FIELDS} | {c.lower() for c in drop}

    def counted(batch: pa.RecordBatch) -> list[pa.Array]:
        n: list[int] = []
        for _, x, bounds in ragged.slices(ragged.column(batch, "text")):
            n += np.bincount(ragged.runs(ragged.WORDLIKE[ragged.ascii_lower(x)], bounds)[2], minlength=len(bounds) - 1).tolist()
        return [pa.array(n, pa.int64())]

    own = docs.drop(*[c for c in docs.columns if c.lower() in gone - {"text"}]).withColumns(keys)
    told = marked(own, "_tickloom_a", every.select(F.col("_tickloom_a").alias("id")))
    clear = told.where(~F.col(MARKED)).drop(MARKED).withColumns({f.name: F.array().cast(f.dataType) for f in _FIELDS[1:]})
    doubtful = told.where(MARKED).drop(MARKED).join(every, [*keys], "left").withColumns({f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in _FIELDS[1:]})
    both = clear.unionByName(doubtful).drop(*keys)
    return ragged.append(both, counted, _FIELDS[:1], tuple(c for c in drop if c.lower() not in {"hits", "items"})).select(*[c for c in docs.columns if c.lower() not in gone], *[f.name for f in _FIELDS])


def _united(spans):
    """Sorted ranges as the fewest disjoint ones."""
    def step(done, r):
        end = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], r["last"]).alias("last"))))
        return F.when(F.size(done) == 0, F.array(r)).when(r["first"] <= end["last"], joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def digest(found: DataFrame) -> DataFrame:
    """What find() found, as counts and a hash of the item ids."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: hits of all benchmark items in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop=("text",)))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (k) WHERE dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
