"""Forward returns on a grid, labels and returns after costs.

A grid has a point at every step between its first and last, so the point at or before
T + tau is the one tau div delta rows on: a lead, not a frame over up to 600 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import schema, scores
from tickloom.operators.flow import KEYS


def forward(df: DataFrame, value: str, horizons_sec: tuple[int, ...], intervals_ms: tuple[int, ...], keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, dict[int, Column]]:
    """df, on the given grids, with a helper column _lead<n> for each number of rows to look ahead, and by
    horizon the value at the last grid point at or before T + horizon."""
    w = Window.partitionBy(*keys, "interval_ms").orderBy("grid_seq")
    ahead = {(h, ms): h * 1000 // ms for h in horizons_sec for ms in intervals_ms}
    df = df.withColumns({f"_lead{n}": F.lead(value, n).over(w) if n else F.col(value) for n in sorted(set(ahead.values()))})
    out: dict[int, Column] = {}
    for (h, ms), n in ahead.items():
        there = F.col(f"_lead{n}")
        if len(intervals_ms) == 1:
            out[h] = there
        else:
            out[h] = F.when(F.col("interval_ms") == ms, there) if h not in out else out[h].when(F.col("interval_ms") == ms, there)
    return df, out


def returns(grid: DataFrame, intervals_ms: tuple[int, ...] = (1000,), mid: str = "mid_price", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """grid with r_1s .. r_60s, log returns of mid; NULL unless the mid is positive and the grid reaches T + 60 s.

    Rows must not have been removed from the grid; a horizon shorter than the step gives 0.
    """
    last = F.max("grid_nanos").over(Window.partitionBy(*keys, "interval_ms"))
    ripe = (F.col(mid) > 0) & (last >= F.col("grid_nanos") + max(schema.HORIZONS_SEC) * schema.SECOND)
    out, there = forward(grid.withColumn("_ripe", ripe), mid, schema.HORIZONS_SEC, intervals_ms, keys)
    log = {f"r_{h}s": F.when(F.col("_ripe") & (there[h] > 0), F.ln(there[h] / F.col(mid))) for h in schema.HORIZONS_SEC}
    return out.withColumns(log).drop("_ripe", *[c for c in out.columns if c.startswith("_lead")])


def labels(df: DataFrame, alpha: float = schema.ALPHA, sigma: float = schema.SIGMA_DELTA) -> DataFrame:
    """df with y_1s .. y_60s: the direction of each return beyond its threshold; 0 where it is undefined."""
    def y(h: int) -> Column:
        theta = scores.threshold(F.col("delta_nanos"), h * schema.SECOND, F.col("spread"), F.col("mid_price"), alpha, sigma)
        return scores.label(F.col(f"r_{h}s"), theta)

    return df.withColumns({f"y_{h}s": y(h) for h in schema.HORIZONS_SEC})


def executable(df: DataFrame, cost: Column | float | None = None, basis: str = "mid") -> DataFrame:
    """df with exec_1s .. exec_60s: buy at the ask, sell at the forward mid, or at its bid side, less costs."""
    cost = scores.fixed_cost() if cost is None else cost
    half = F.col("spread") / 2 if basis == "bid" else F.lit(0.0)
    return df.withColumns({f"exec_{h}s": scores.long_return(F.col("best_ask"), F.col("mid_price") * F.exp(F.col(f"r_{h}s")) - half, cost) for h in schema.HORIZONS_SEC})
