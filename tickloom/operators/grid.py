"""Fixed clock grids: the last observation carried forward, without a join.

The grid of an instrument starts one step after its first tick. A point carries the last tick
strictly before it (or at it, if inclusive) and is emitted when the next tick reaches it, so the
rows of a tick are a sequence of steps up to the next tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.operators.flow import KEYS, TIME, along

#: Points of one gap that are made at a time.
CHUNK = 4096


def resample(df: DataFrame, intervals_ms: tuple[int, ...] = (1000,), keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME, flush: Column | None = None, inclusive: bool = False, max_age_ms: int | None = None) -> DataFrame:
    """df's rows on grids: with interval_ms, grid_seq, grid_nanos, delta_nanos and snapshot_age_ms.

    flush, a time in nanoseconds, emits the points after the last tick up to it. max_age_ms leaves
    out points older than that before they are made, so that a long gap costs nothing. Without it a
    gap's points are made CHUNK at a time, so a gap of days holds no more memory than one of minutes.
    """
    t = time[0]
    spaced = runs(df, intervals_ms, keys, time, flush, inclusive, max_age_ms)
    if max_age_ms is None or max_age_ms > CHUNK * min(intervals_ms):
        spaced = spaced.withColumn("_low", F.explode(F.sequence("_low", "_high", F.lit(CHUNK).cast("bigint"))))
        spaced = spaced.withColumn("_high", F.least("_high", F.col("_low") + CHUNK - 1))
    out = spaced.withColumn("grid_seq", F.explode(F.sequence("_low", "_high")))
    out = out.withColumn("grid_nanos", F.col("_first") + F.col("grid_seq") * F.col("delta_nanos"))
    age = F.greatest(F.lit(0), F.col("grid_nanos") - F.col(t)) / float(schema.MS)
    return out.withColumn("snapshot_age_ms", age).drop("_next", "_first", "_last", "_low", "_high")


def runs(df: DataFrame, intervals_ms: tuple[int, ...] = (1000,), keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME, flush: Column | None = None, inclusive: bool = False, max_age_ms: int | None = None) -> DataFrame:
    """df's rows that resample() carries to a grid, with interval_ms, delta_nanos and the first and last of their points (_low, _high)."""
    t = time[0]
    w = along(keys, time)
    whole = Window.partitionBy(*keys)
    after = F.lead(t).over(w)
    if flush is not None:
        after = F.coalesce(after, flush)
    spaced = df.withColumns({"_next": after, "_first": F.min(t).over(whole), "_last": F.lead(t).over(w).isNull()}).where(F.col("_next").isNotNull())
    spaced = spaced.withColumn("interval_ms", F.explode(F.array(*[F.lit(i) for i in intervals_ms]))) if len(intervals_ms) > 1 else spaced.withColumn("interval_ms", F.lit(intervals_ms[0]))
    spaced = spaced.withColumn("delta_nanos", F.col("interval_ms").cast("bigint") * schema.MS)
    steps = "({t} - _first {less}) div delta_nanos"
    low, high = (F.expr(steps.format(t=c, less="- 1" if inclusive else "")) for c in (t, "_next"))
    if inclusive and flush is not None:
        high = F.when(F.col("_last"), F.expr(steps.format(t="_next", less=""))).otherwise(high)
    if max_age_ms is not None:
        high = F.least(high, F.expr(f"({t} - _first + {max_age_ms * schema.MS}) div delta_nanos"))
    return spaced.withColumns({"_low": low + 1, "_high": high}).where("_low <= _high")


def stale(age_ms: Column | str = "snapshot_age_ms", limit_ms: int = schema.STALE_MS) -> Column:
    """Older than the limit, strictly."""
    return (F.col(age_ms) if isinstance(age_ms, str) else age_ms) > limit_ms


def staleness(grid: DataFrame, keys: tuple[str, ...] = KEYS, limit_ms: int = schema.STALE_MS) -> DataFrame:
    """Per instrument and interval: n_points and n_stale."""
    return grid.groupBy(*keys, "interval_ms").agg(F.count("*").alias("n_points"), F.count_if(stale(limit_ms=limit_ms)).alias("n_stale"))
