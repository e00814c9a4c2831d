"""A batch of texts as one UTF-8 byte array plus row bounds, and the hashes built on it.

Every operator that leaves the JVM works on these arrays instead of on one
Python string after another. Null texts are empty rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes worked on at a time, so that temporary arrays stay small whatever an Arrow batch holds.
SLICE_BYTES = 1 << 18
#: Bytes of an Arrow batch that an operator takes at once, and that Spark is asked for.
PIECE_BYTES, BATCH_BYTES = 2 << 20, 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string or binary column; row i is bytes[bounds[i]:bounds[i + 1]]."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) for runs of whole rows of about limit bytes; a longer row comes alone."""
    x, bounds = raw(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, n, first + 8192)
        yield first, x[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def runs(flag: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of flagged bytes; none crosses a row's end."""
    if not flag.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, shuts = flag.copy(), flag.copy()
    opens[1:] &= ~flag[:-1]
    shuts[:-1] &= ~flag[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < flag.size)]
    opens[edge] |= flag[edge]
    shuts[edge - 1] |= flag[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base."""
    global _powers
    if _powers.size < n:
        size = max(n, 2 * _powers.size, 256)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def run_hashes(x: np.ndarray, flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run found by runs()."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(flag)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(at.size) - np.repeat(first, length)
    value = (x[at].astype(np.uint64) + _U(1)) * powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, first))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes; the caller drops those that cross a row's end."""
    if h.size < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(h.size - n + 1, np.uint64)
    p = powers(n + 1)
    for k in range(n):
        out += h[k : h.size - n + 1 + k] * p[k + 1]
    return mix(out ^ _U(n))


def ascii_lower(x: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[x]


def latin_lower(x: np.ndarray) -> np.ndarray:
    """ascii_lower, and the capital letters of U+00C0 to U+00DE as well."""
    x = ascii_lower(x)
    if x.size > 1:
        capital = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)) + 1
        x[capital] += 32
    return x


def byte_flags(codes) -> np.ndarray:
    """256 booleans, true at the given byte values."""
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: Not one of space, tab, newline, vertical tab, form feed, return.
VISIBLE = ~byte_flags([0x20, *range(0x09, 0x0E)])
#: Digits, a-z and the bytes of characters beyond ASCII; upper case is lowered first.
WORDLIKE = byte_flags([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about limit bytes, without a copy, so that what is made of a run stays small; nothing of an empty one."""
    step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def append(docs: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the columns fn makes of each Arrow batch, without those named in drop.

    A column of docs whose name clashes with a new one, in any letter case, is replaced.
    """
    gone = {f.name.lower() for f in fields} | {c.lower() for c in drop}
    keep = [f for f in docs.schema.fields if f.name.lower() not in gone]
    schema = T.StructType(keep + fields)
    names = [f.name for f in schema.fields]
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in kept] + fn(piece), names=names)

    return docs.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """For programs, not operators: let Spark cut Arrow batches at BATCH_BYTES, as texts can be long; its own bound is 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column of that name in any letter case, as Spark resolves names."""
    at = next(i for i, c in enumerate(batch.schema.names) if c.lower() == name.lower())
    return batch.column(at)
