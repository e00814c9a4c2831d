"""Schemas and constants."""

from __future__ import annotations

from math import exp

from pyspark.sql import types as T

# Fixed values.
INTERVALS_MS = (100, 250, 500, 1000, 2000)
HORIZONS_SEC = (1, 5, 10, 30, 60)
LINEAR_WEIGHTS = (1.0, 0.8, 0.6, 0.4, 0.2)
OFI_UNIFORM_WEIGHTS = (0.2, 0.2, 0.2, 0.2, 0.2)
OFI_EXP_WEIGHTS = (1.0, 0.6065, 0.3678, 0.2231, 0.1353)
EXP_LAMBDA = 0.5
ALPHA, SIGMA_DELTA = 0.5, 0.0004
STALE_MS = 5000
TRADE_VALUE = 100_000.0
NEUTRAL_BAND = 0.15

MS, SECOND = 1_000_000, 1_000_000_000

#: Features whose rank correlation with forward returns is tested (fixed values).
IC_FEATURES = ("l1_obi", "total_obi", "w_obi_lin", "w_obi_exp", "micro_pressure_bps", "ml_microprice", "l1_ofi", "ml_ofi_uniform", "ml_ofi_exp", "trade_strength")
#: Features of the classifiers, in their order (fixed values).
MODEL_FEATURES = ("l1_obi", "total_obi", "w_obi_lin", "w_obi_exp", "microprice", "micro_pressure", "l1_ofi", "ml_ofi_uniform", "ml_ofi_exp", "trade_strength", "rel_spread_bps", "snapshot_age_ms")


def exp_weights(decay: float = EXP_LAMBDA, levels: int = 5) -> tuple[float, ...]:
    """exp(-decay * i) for each level i."""
    return tuple(exp(-decay * i) for i in range(levels))


_LONGS, _INTS, _DOUBLES = (T.ArrayType(t) for t in (T.LongType(), T.IntegerType(), T.DoubleType()))

#: A market snapshot with its depth as arrays, best level first (fixed names).
SNAPSHOT = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("instrument_token", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("client_arrival_nanos", T.LongType()),
    T.StructField("client_arrival_micros", T.LongType()),
    T.StructField("exchange_epoch_secs", T.LongType()),
    T.StructField("ltp", T.DoubleType()),
    T.StructField("ltq", T.LongType()),
    T.StructField("cumulative_volume", T.LongType()),
    T.StructField("day_vwap", T.DoubleType()),
    T.StructField("depth_levels", T.IntegerType()),
    T.StructField("bid_prices", _DOUBLES),
    T.StructField("bid_quantities", _LONGS),
    T.StructField("bid_orders", _INTS),
    T.StructField("ask_prices", _DOUBLES),
    T.StructField("ask_quantities", _LONGS),
    T.StructField("ask_orders", _INTS),
    T.StructField("state_tag", T.StringType()),
])

#: The feature table without its partition columns' path order (fixed names).
FEATURE_COLUMNS = (
    "grid_seq", "grid_nanos", "delta_nanos", "instrument_token", "symbol", "snapshot_age_ms",
    "best_bid", "best_ask", "mid_price", "spread", "rel_spread_bps", "ltp", "cum_volume", "vwap",
    "l1_obi", "total_obi", "w_obi_lin", "w_obi_exp", "microprice", "micro_pressure", "micro_pressure_bps", "ml_microprice",
    "l1_ofi", "ml_ofi_uniform", "ml_ofi_exp", "trade_strength", "buy_pressure", "sell_pressure",
    *(f"{kind}_{h}s" for kind in ("r", "y", "exec") for h in HORIZONS_SEC),
)
