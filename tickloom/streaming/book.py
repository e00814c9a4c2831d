"""The tick state as Structured Streaming: the last observation carried forward, matured labels, and paced messages.

One state object a token holds the last tick, the first time and the next grid step. Late rows
go by the watermark; those of one micro-batch are put in order before they are applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions import schema

GRID = "instrument_token long, grid_seq long, grid_nanos long, tick_nanos long, seq long, ltp double"
STATE = "first long, step long, tick long, seq long, ltp double"
#: Grid points of one token that are given out at a time, however long its gap.
CHUNK = 100_000
RETURNS = "instrument_token long, grid_nanos long, mid double, " + ", ".join(f"r_{h}s double" for h in schema.HORIZONS_SEC)
#: Time kept of an instrument's past for its forward returns (a fixed value).
RETENTION_SEC = 120


def _millis(df: DataFrame, delay: str) -> int:
    """A delay such as "1 minute" in milliseconds."""
    return df.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + interval {delay})")).first()[0]


def locf(ticks: DataFrame, interval_ms: int, delay: str = "1 minute") -> DataFrame:
    """Grid points of a stream of ticks (instrument_token, mono_nanos, seq, ltp, event_time), as resample() gives them.

    Points come when a later tick arrives. A token whose last event lies behind the watermark by
    more than the delay is dropped from the state; if it comes back, its grid begins anew, where
    the batch form would go on.
    """
    delta = interval_ms * schema.MS
    kept = _millis(ticks, delay)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["mono_nanos", "seq"], kind="stable")
        t, seq, ltp = (rows[c].to_numpy() for c in ("mono_nanos", "seq", "ltp"))
        first, step = int(t[0]), 1
        if state.exists:
            first, step, *last = state.get
            # Rows older than the state could only replace what has been given out.
            new = (t > last[0]) | (t == last[0]) & (seq >= last[1])
            t, seq, ltp = (np.concatenate([[v], x[new]]) for v, x in zip(last, (t, seq, ltp), strict=True))
        end = (int(t[-1]) - first) // delta + 1
        for a in range(step, end, CHUNK):
            steps = np.arange(a, min(a + CHUNK, end), dtype=np.int64)
            at = first + steps * delta
            k = np.searchsorted(t, at, "left") - 1  # the last tick before the point
            yield pd.DataFrame({"instrument_token": key[0], "grid_seq": steps, "grid_nanos": at, "tick_nanos": t[k].astype(np.int64), "seq": seq[k].astype(np.int64), "ltp": ltp[k].astype(float)})
        state.update((first, max(step, end), int(t[-1]), int(seq[-1]), float(ltp[-1])))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["_ms"].max())) + kept)

    marked = ticks.withWatermark("event_time", delay).withColumn("_ms", F.unix_millis("event_time"))
    return marked.groupBy("instrument_token").applyInPandasWithState(update, GRID, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def forward_returns(points: DataFrame, delay: str = "1 minute", retention_sec: int = RETENTION_SEC) -> DataFrame:
    """Forward returns of a stream of grid points (instrument_token, grid_nanos, mid, event_time), given out once they are ripe.

    A point is ripe when its instrument has reached T + 60 s. What is kept of an instrument is its
    points of the last retention_sec, at least those that are not ripe; NULL where a mid is not positive.
    """
    last_ns = max(schema.HORIZONS_SEC) * schema.SECOND
    retention = max(retention_sec * schema.SECOND, last_ns)
    kept = _millis(points, delay)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        t, mid = rows["grid_nanos"].to_numpy(np.int64), rows["mid"].to_numpy(float)
        done = -(1 << 62)
        if state.exists:
            old_t, old_mid, done = state.get
            t, mid = np.concatenate([np.array(old_t, np.int64), t]), np.concatenate([np.array(old_mid, float), mid])
        t, order = np.unique(t, return_index=True)
        mid = mid[order]
        ripe = np.flatnonzero((t > done) & (t + last_ns <= t[-1]))
        out = {"instrument_token": np.full(ripe.size, key[0]), "grid_nanos": t[ripe], "mid": mid[ripe]}
        for h in schema.HORIZONS_SEC:
            there = mid[np.searchsorted(t, t[ripe] + h * schema.SECOND, "right") - 1]
            ok = (mid[ripe] > 0) & (there > 0)
            out[f"r_{h}s"] = np.where(ok, np.log(np.where(ok, there, 1.0) / np.where(ok, mid[ripe], 1.0)), np.nan)
        if ripe.size:
            done = int(t[ripe[-1]])
        stay = t > min(t[-1] - retention, done) if done >= t[0] else t > t[-1] - retention
        stay |= t > done
        state.update((t[stay].tolist(), mid[stay].tolist(), done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["_ms"].max())) + kept)
        yield pd.DataFrame(out)

    marked = points.withWatermark("event_time", delay).withColumn("_ms", F.unix_millis("event_time"))
    out = marked.groupBy("instrument_token").applyInPandasWithState(update, RETURNS, "t array<long>, mid array<double>, done long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c.startswith("r_") else F.col(c) for c in out.columns])


def newest(batch: DataFrame) -> DataFrame:
    """The newest row of each token of a micro-batch: what is shown when frames come faster than they can be drawn."""
    rest = [c for c in batch.columns if c != "instrument_token"]
    return batch.groupBy("instrument_token").agg(F.max_by(F.struct(*rest), F.struct("mono_nanos", "seq")).alias("_r")).select("instrument_token", "_r.*")


def broadcast_messages(stream: DataFrame, sinks: list, checkpoint: str, pace: str | None = "100 milliseconds"):
    """Send each micro-batch's newest rows to every sink; one that fails does not stop the others. Returns the query."""
    def send(batch: DataFrame, epoch: int) -> None:
        shown = newest(batch).persist()
        try:
            for sink in sinks:
                try:
                    sink(shown, epoch)
                except Exception as e:  # the others still get theirs
                    batch.sparkSession.sparkContext._jvm.System.err.println(f"sink failed in epoch {epoch}: {e}")
        finally:
            shown.unpersist()

    writer = stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=pace) if pace else writer.trigger(availableNow=True)).start()
