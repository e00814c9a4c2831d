"""What the documents of this field ask for beyond the feature table: rolling windows, filters, segments and comparisons.

All are columns or aggregations of ticks and grid rows; windows share the exchange by instrument.
"""

from __future__ import annotations

from math import e, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import schema, scores
from tickloom.functions.book import ratio
from tickloom.operators.flow import KEYS, TIME, along
from tickloom.operators.grid import stale

#: Seconds of the rolling windows.
WINDOWS_SEC = (1, 5, 10, 30, 60)


def rolling_strength(sided: DataFrame, windows_sec: tuple[int, ...] = WINDOWS_SEC, keys: tuple[str, ...] = KEYS, time: str = TIME[0]) -> DataFrame:
    """sided (ticks with side) with strength_<s>s, the traded imbalance, and intensity_<s>s, trades a second, over the last s seconds.

    Both ends count: rows of the same time belong to each other's windows. 0 without a trade.
    """
    out = {}
    for s in windows_sec:
        w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-s * schema.SECOND, 0)
        of = lambda side: F.sum(F.when(F.col("side") == side, F.col("ltq")).otherwise(0)).over(w)  # noqa: B023, E731
        out[f"strength_{s}s"] = ratio(of("BUY") - of("SELL"), of("BUY") + of("SELL"), 0.0)
        out[f"intensity_{s}s"] = F.sum(F.when(F.col("ltq") > 0, 1).otherwise(0)).over(w) / float(s)
    return sided.withColumns(out)


def normalized_flow(df: DataFrame, flow: str = "l1_ofi") -> Column:
    """Order flow as a share of the quantity at both best levels; 0 without quantity, NULL where the flow is."""
    return F.when(F.col(flow).isNotNull(), ratio(F.col(flow), F.col("qb0") + F.col("qa0"), 0.0))


def quality_flags(ticks: DataFrame, duplicate_ms: int = 5, gap_sec: int = 3, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """ticks with duplicate (the same trade and best quotes within duplicate_ms of the row before), volume_fell
    (cum_volume below the row before) and after_gap (more than gap_sec after it, where order flow begins anew)."""
    w = along(keys, time)
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("ltp", "ltq", "b0", "a0", "qb0", "qa0")]
    wait = F.col(time[0]) - F.lag(time[0]).over(w)
    alike = same[0]
    for s in same[1:]:
        alike = alike & s
    return ticks.withColumns({
        "duplicate": F.coalesce(alike & (wait < duplicate_ms * schema.MS), F.lit(False)),
        "volume_fell": F.coalesce(F.col("cum_volume") < F.lag("cum_volume").over(w), F.lit(False)),
        "after_gap": F.coalesce(wait > gap_sec * schema.SECOND, F.lit(True)),
    })


def fresh_returns(table: DataFrame, intervals_ms: tuple[int, ...], limit_ms: int = schema.STALE_MS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The feature table with r_<h>s NULL where a grid row from T to T + h is stale."""
    old = F.max(stale(limit_ms=limit_ms).cast("int"))
    out = {}
    for h in schema.HORIZONS_SEC:
        spans = None
        for ms in intervals_ms:
            w = Window.partitionBy(*keys, "interval_ms").orderBy("grid_seq").rowsBetween(0, h * 1000 // ms)
            spans = F.when(F.col("interval_ms") == ms, old.over(w)) if spans is None else spans.when(F.col("interval_ms") == ms, old.over(w))
        out[f"_old_{h}"] = spans
    marked = table.withColumns(out)
    return marked.withColumns({f"r_{h}s": F.when(F.col(f"_old_{h}") == 0, F.col(f"r_{h}s")) for h in schema.HORIZONS_SEC}).drop(*out)


def continuous_only(df: DataFrame, ts: Column) -> DataFrame:
    """df without rows of the auctions and of closed hours."""
    return df.where(scores.session_phase(ts) == "CONTINUOUS_TRADING")


def segment(x: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the stretch between ascending cuts that x lies in; a value equal to a cut lies above it. NULL for an undefined x."""
    out = F.when(x.isNull() | F.isnan(x), F.lit(None))
    for cut, name in zip(cuts, names, strict=False):
        out = out.when(x < cut, name)
    return out.otherwise(names[-1])


def confluence(table: DataFrame, a: str, b: str, target: str, width: float) -> DataFrame:
    """The 3 x 3 matrix of two signals' bands (-1, 0, 1): rows and mean target; rows with an undefined signal or target don't count."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(target).isNotNull()
    bands = [scores.band(F.col(c), width).alias(n) for c, n in ((a, "band_a"), (b, "band_b"))]
    return table.where(ok).select(*bands, target).groupBy("band_a", "band_b").agg(F.count("*").alias("n"), F.avg(target).alias("mean_target"))


def decay(ic: DataFrame) -> DataFrame:
    """Of each feature and interval: the absolute correlation by horizon as a share of that at the shortest horizon (NULL where that is 0)."""
    w = Window.partitionBy("interval_ms", "feature").orderBy("horizon")
    first = F.first(F.abs("ic")).over(w)
    return ic.select("interval_ms", "feature", "horizon", F.abs("ic").alias("abs_ic"), F.when(first > 0, F.abs("ic") / first).alias("share"))


def depth_imbalances(ticks: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """ticks with obi_<n>, the imbalance of the n best levels, for each depth."""
    def obi(n: int) -> Column:
        b, a = (sum((F.coalesce(F.col(f"q{s}{i}"), F.lit(0)) for i in range(1, n)), F.coalesce(F.col(f"q{s}0"), F.lit(0))) for s in "ba")
        return ratio(b - a, b + a, 0.0)

    return ticks.withColumns({f"obi_{n}": obi(n) for n in depths})


def realized_sigma(grid: DataFrame, rows: int = 60, mid: str = "mid_price", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """grid with sigma, the standard deviation of the last `rows` steps' log returns; NULL with fewer than two."""
    w = Window.partitionBy(*keys, "interval_ms").orderBy("grid_seq")
    before = F.lag(mid).over(w)
    step = F.when((F.col(mid) > 0) & (before > 0), F.ln(F.col(mid) / before))
    return grid.withColumn("_step", step).withColumn("sigma", F.stddev_samp("_step").over(w.rowsBetween(1 - rows, 0))).drop("_step")


def deflated_sharpe(returns: DataFrame, column: str, n_trials: int, trials_variance: float) -> dict:
    """The probability that a strategy's Sharpe ratio (a return a row) is above what the best of n_trials without skill would show.

    Four moments are aggregated; the formula is the published one of the deflated Sharpe ratio.
    """
    r = returns.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurt")).first()
    if r["n"] < 3 or not r["std"]:
        return {"available": False, "reason": "fewer than three returns, or they don't vary"}
    sharpe, normal = r["mean"] / r["std"], NormalDist()
    gamma = 0.5772156649015329
    best = sqrt(trials_variance) * ((1 - gamma) * normal.inv_cdf(1 - 1 / n_trials) + gamma * normal.inv_cdf(1 - 1 / (n_trials * e))) if n_trials > 1 else 0.0
    spread = 1 - r["skew"] * sharpe + (r["kurt"] + 2) / 4 * sharpe * sharpe  # Spark's kurtosis is the excess over 3
    if spread <= 0:
        return {"available": False, "reason": "the moments leave no variance"}
    return {"available": True, "n": r["n"], "sharpe": sharpe, "expected_best": best, "deflated": normal.cdf((sharpe - best) * sqrt(r["n"] - 1) / sqrt(spread))}
