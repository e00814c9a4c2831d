"""Sharding by histogram sort: exact byte counts below probe keys, refined until splitters fit.

A document's key is the hash of its text, the hash of its doc_id and a number of its row: 192
bits that spread evenly, so equal texts lie side by side, and a group of copies, or of rows that
repeat a document, still splits. Each round counts the bytes below a few probes in each
splitter's interval, over a narrow table of keys and sizes; the splitters then deal the documents
in one exchange, whose result is written once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.scratch import Scratch

#: A shard is dealt in bins, each sorted by one task: this many at least, and as many as keep a bin near this size.
BINS_PER_SHARD, BIN_BYTES = 8, 1 << 30
#: Probes in a splitter's interval each round; in the first, sampled keys: so many a part, and in all.
PROBES, SAMPLED, MOST_SAMPLED = 24, 64, 1 << 18
#: How far the bytes below a splitter may be from their share, as part of a bin's bytes: between shards, and inside one.
TOLERANCE, INSIDE = 0.002, 0.1
_WORD = 1 << 64
_KEY = ("high", "low", "row")


def size_of(text: Column | str) -> Column:
    """Bytes a document takes in a shard: its UTF-8 text and 8 more; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _split(keys: list[int]) -> list[np.ndarray]:
    """192-bit keys as three arrays of signed 64-bit numbers in the order of Spark's longs."""
    return [np.array([(k >> shift) % _WORD - (_WORD >> 1) for k in keys], np.int64) for shift in (128, 64, 0)]


def below(parts: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
    """For each key the number of boundaries (ascending) that are not above it; keys and boundaries part by part."""
    if len(at) == 1:
        return np.searchsorted(at[0], parts[0], "right")
    left, right = np.searchsorted(at[0], parts[0], "left"), np.searchsorted(at[0], parts[0], "right")
    out = left.copy()
    tied = np.flatnonzero(left != right)
    order = tied[np.argsort(left[tied], kind="stable")]
    for rows in np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if order.size else ():
        a, b = left[rows[0]], right[rows[0]]
        out[rows] = a + below([p[rows] for p in parts[1:]], [x[a:b] for x in at[1:]])
    return out


def _count(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Bytes and rows between neighbouring probes, by the number of probes not above a key."""
    at = _split(probes)

    def run(batches):
        total = np.zeros((3, len(probes) + 1), np.int64)
        for b in batches:
            place = below([b.column(k).to_numpy() for k in range(3)], at)
            size = b.column(3).to_numpy()
            # Sums of halves of the sizes are exact in the doubles that bincount adds.
            total[0] += np.bincount(place, size >> 16, len(probes) + 1).astype(np.int64)
            total[1] += np.bincount(place, size & 0xFFFF, len(probes) + 1).astype(np.int64)
            total[2] += np.bincount(place, minlength=len(probes) + 1)
        used = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array((total[0][used] << 16) + total[1][used]), pa.array(total[2][used])], names=["place", "bytes", "n"])

    counted = keys.select(*_KEY, "size").mapInArrow(run, "place long, bytes long, n long").groupBy("place").agg(F.sum("bytes"), F.sum("n"))
    return {r[0]: (r[1], r[2]) for r in counted.collect()}


def _sampled(keys: DataFrame, total: int, parts: int) -> list[int]:
    """Some keys in order, drawn by size, with the borders of their texts and documents: the first probes. What hot keys hold shows here."""
    share = min(SAMPLED * parts, MOST_SAMPLED) / max(1, total)
    drawn = F.pmod(F.xxhash64(F.lit(3), *_KEY), F.lit(1 << 30)) < F.lit(share * (1 << 30)) * F.col("size")
    out: set[int] = set()
    for r in keys.where(drawn).select(*_KEY).collect():
        key = 0
        for word in r:
            key = (key << 64) + word + (_WORD >> 1)
        out |= {key, key >> 128 << 128, key >> 64 << 64}
    return sorted(out)


class _Splitter:
    """The interval that holds one splitter: its ends with the bytes and rows below each, and the bytes wanted below it."""

    def __init__(self, target: int, slack: float, total: int, rows: int):
        self.target, self.slack = target, slack
        self.low, self.high = (0, 0, 0), (1 << 192, total, rows)

    def chosen(self) -> int | None:
        """The nearer end, if it is near enough or no row lies between."""
        under, over = self.target - self.low[1], self.high[1] - self.target
        if min(under, over) <= self.slack or self.high[0] - self.low[0] <= 1 or self.high[2] - self.low[2] <= 1:
            return self.low[0] if under <= over else self.high[0]
        return None

    def probes(self) -> set[int]:
        """Keys inside the interval: on borders between texts while it spans several, then between documents, then anywhere."""
        lo, hi = self.low[0], self.high[0]
        unit = next((u for u in (1 << 128, 1 << 64) if hi - lo > 2 * u), 1)
        found = (-(-(lo + (hi - lo) * i // (PROBES + 1)) // unit) * unit for i in range(1, PROBES + 1))
        return {p for p in found if lo < p < hi}

    def narrow(self, at: list[int], bytes_below: list[int], rows_below: list[int]) -> None:
        """The part of the interval between counted probes that holds the target."""
        a, b = bisect_right(at, self.low[0]), bisect_left(at, self.high[0])
        k = bisect_right(bytes_below, self.target, a, b)
        if k > a:
            self.low = (at[k - 1], bytes_below[k - 1], rows_below[k - 1])
        if k < b:
            self.high = (at[k], bytes_below[k], rows_below[k])


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, inside: float | None = None, every: int = 1) -> tuple[list[int], int]:
    """parts - 1 ascending 192-bit keys that cut keys (high, low, row, size) into parts of near equal bytes, and the rounds taken.

    Each part's end is off by tolerance of a part's bytes or by one row; of the ends only each
    every-th, the others by `inside`. What is collected is one row for each probe, whatever the input;
    exact counts decide, the sample only says where to look first.
    """
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    slack = lambda j: (tolerance if inside is None or (j + 1) % every == 0 else inside) * total / parts
    state = [_Splitter(total * (j + 1) // parts, slack(j), total, n) for j in range(parts - 1)]
    rounds = 0
    while open_ := [s for s in state if s.chosen() is None]:
        rounds += 1
        at = _sampled(keys, total, parts) if rounds == 1 else sorted(set().union(*(s.probes() for s in open_)))
        got = _count(keys, at)
        bytes_below, rows_below = ([int(v) for v in np.cumsum([got.get(k, (0, 0))[i] for k in range(len(at))])] for i in (0, 1))
        for s in open_:
            s.narrow(at, bytes_below, rows_below)
    return sorted(s.chosen() for s in state), rounds


def shard(docs: DataFrame, shards: int, tolerance: float = TOLERANCE, keep_text: bool = True) -> DataFrame:
    """docs with size, text_crc32, shard and slot: shards of near equal bytes, slots gapless from 0 in key order.

    docs has doc_id and text; a column named like a new one is replaced; without keep_text, text
    stays behind. A null text has no bytes (CRC 0), a null doc_id is one more id. Rows that repeat doc_id and text may lie in several
    shards. An empty table gives no row. A shard's bytes differ from the mean by the tolerance and
    one document at most if docs comes in the same partitions each time, as a scan does; if not,
    rows that repeat a document may be dealt less evenly, but each row has its slot all the same.
    """
    spark = docs.sparkSession
    names = {"size", "text_crc32", "shard", "slot", "_high", "_low", "_row", "_bin"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    keyed = docs.withColumns({
        "_high": F.xxhash64("text"), "_low": F.xxhash64(F.lit(1), "doc_id"), "_row": F.xxhash64(F.lit(2), F.monotonically_increasing_id()),
        "size": size_of("text"), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary")),
    })
    if not keep_text:
        keyed = keyed.drop("text")
    scratch = Scratch(spark)
    keys = scratch.write(keyed.select(*[F.col(f"_{k}").alias(k) for k in _KEY], "size"))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(BINS_PER_SHARD, -(-total // (shards * BIN_BYTES)))
    cuts, _ = splitters(keys, shards * per_shard, tolerance, INSIDE, per_shard)
    scratch.drop(keys)
    at = _split(cuts)

    @F.arrow_udf(T.IntegerType())
    def bin_of(high: pa.Array, low: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(below([high.to_numpy(), low.to_numpy(), row.to_numpy()], at).astype(np.int32))

    place = F.row_number().over(Window.partitionBy("_bin").orderBy("_high", "_low", "_row"))
    # Written before slots are told, so that these follow the rows as they were dealt, whatever a lost task does.
    dealt = scratch.write(keyed.withColumn("_bin", bin_of("_high", "_low", "_row")).withColumn("slot", place.cast("long")).drop("_high", "_low", "_row"))
    whole = dealt.groupBy("_bin").agg(F.count("*").alias("_n")).withColumn("shard", (F.col("_bin") / per_shard).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_bin", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = dealt.join(F.broadcast(starts), "_bin")  # a row a bin
    return out.select(*[c for c in keyed.columns if not c.startswith("_") or c in docs.columns], "shard", (F.col("_start") + F.col("slot") - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents in 24 shards of near equal bytes."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24, keep_text=False)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
