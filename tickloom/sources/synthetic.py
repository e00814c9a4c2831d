"""Synthetic feature tables for tests of research: an imbalance that leads the price, from a seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import schema, scores

# Token, symbol, price.
INSTRUMENTS = ((738561, "RELIANCE", 2500.0), (1333, "HDFCBANK", 1650.0), (1594, "INFY", 1500.0))
TICK = 0.05
_KINDS = {"grid_seq": "long", "grid_nanos": "long", "delta_nanos": "long", "instrument_token": "long", "symbol": "string", "cum_volume": "long"}


def table_schema() -> str:
    kinds = {c: _KINDS.get(c, "int" if c.startswith("y_") else "double") for c in schema.FEATURE_COLUMNS}
    return ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", interval_ms int, date string"


def series(token: int, symbol: str, price: float, interval_ms: int, day: str, rows: int, seed: int) -> pd.DataFrame:
    """One day of one instrument on one grid. The latent imbalance is autoregressive and moves the next prices."""
    rng = np.random.default_rng([seed, token, interval_ms, int(day.replace("-", ""))])
    noise = rng.normal(size=(6, rows))
    latent = np.zeros(rows)
    for i in range(1, rows):
        latent[i] = 0.95 * latent[i - 1] + 0.3 * noise[0, i]
    obi = np.tanh(latent)
    step = 2e-5 * obi + 8e-5 * np.sqrt(interval_ms / 1000) * noise[1]
    mid = np.round(price * np.exp(np.cumsum(np.concatenate([[0.0], step[:-1]]))) / TICK) * TICK
    spread = TICK * rng.integers(1, 4, rows)
    seq = np.arange(1, rows + 1)
    out = {"grid_seq": seq, "grid_nanos": seq * interval_ms * schema.MS, "delta_nanos": np.full(rows, interval_ms * schema.MS), "instrument_token": token, "symbol": symbol, "snapshot_age_ms": rng.uniform(0, interval_ms, rows)}
    out |= {"best_bid": mid - spread / 2, "best_ask": mid + spread / 2, "mid_price": mid, "spread": spread, "rel_spread_bps": spread / mid * 1e4, "ltp": mid, "cum_volume": np.cumsum(rng.integers(1, 100, rows)), "vwap": mid}
    for k, name in enumerate(("l1_obi", "total_obi", "w_obi_lin", "w_obi_exp")):
        out[name] = np.clip(obi + 0.05 * k * noise[2], -1, 1)
    out |= {"microprice": mid + spread / 2 * obi, "micro_pressure": spread / 2 * obi, "micro_pressure_bps": spread / 2 * obi / mid * 1e4, "ml_microprice": mid + spread / 2 * out["w_obi_exp"]}
    for name, scale in (("l1_ofi", 100.0), ("ml_ofi_uniform", 60.0), ("ml_ofi_exp", 80.0)):
        out[name] = scale * (np.diff(latent, prepend=latent[0]) + 0.2 * noise[3])
    strength = np.tanh(0.5 * latent + 0.5 * noise[4])
    out |= {"trade_strength": strength, "buy_pressure": (1 + strength) / 2, "sell_pressure": (1 - strength) / 2}
    cost = scores.fixed_cost()
    for h in schema.HORIZONS_SEC:
        k = max(1, h * 1000 // interval_ms)  # one step ahead at least
        r = np.full(rows, np.nan)
        if k < rows:
            r[: rows - k] = np.log(mid[k:] / mid[: rows - k])
        theta = np.maximum(schema.ALPHA * schema.SIGMA_DELTA * np.sqrt(h * 1000 / interval_ms), spread / (2 * mid))
        out[f"r_{h}s"], out[f"y_{h}s"] = r, np.where(r > theta, 1, np.where(r < -theta, -1, 0))
        out[f"exec_{h}s"] = (mid * np.exp(r) - out["best_ask"]) / out["best_ask"] - cost
    return pd.DataFrame(out)[list(schema.FEATURE_COLUMNS)].assign(interval_ms=interval_ms, date=day)


def table(spark: SparkSession, days: tuple[str, ...] = ("2026-08-25", "2026-08-26", "2026-08-27"), rows: int = 3000, intervals_ms: tuple[int, ...] = schema.INTERVALS_MS, seed: int = 42) -> DataFrame:
    """The feature table of all days, instruments and grids; each series is made by one task from its own seed."""
    keys = spark.createDataFrame([(d, t, s, p, ms) for d in days for t, s, p in INSTRUMENTS for ms in intervals_ms], "date string, token long, symbol string, price double, interval_ms int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf.itertuples(index=False):
                yield series(k.token, k.symbol, k.price, k.interval_ms, k.date, max(1, rows * 1000 // k.interval_ms), seed)

    return keys.repartition(len(days) * len(INSTRUMENTS)).mapInPandas(run, table_schema()).replace(float("nan"), None)
