"""Scores, thresholds, labels, costs and session phases: functions of one row."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.functions.book import clamp, finite, ratio


def threshold(delta_ns: Column, tau_ns: int, spread: Column, mid: Column, alpha: float = schema.ALPHA, sigma: float = schema.SIGMA_DELTA) -> Column:
    """Volatility scaled to the horizon or half the relative spread, whichever is larger; 0 for no time."""
    scaled = max(sigma, 0.0) * alpha * F.sqrt(F.lit(float(tau_ns)) / delta_ns)
    return F.when((delta_ns > 0) & F.lit(tau_ns > 0), F.greatest(scaled, ratio(spread, 2 * mid, 0.0))).otherwise(0.0)


def label(r: Column, theta: Column) -> Column:
    """1 above theta, -1 below -theta, else 0; 0 also where the return is undefined."""
    return F.when(r > theta, 1).when(r < -theta, -1).otherwise(0)


@dataclass(frozen=True)
class CostSchedule:
    name: str
    valid_from: date
    flat: float
    brokerage: float
    stt_sell: float
    exchange: float
    sebi: float
    gst: float
    stamp_buy: float


# Fixed values.
SCHEDULES = (
    CostSchedule("NSE_EQUITY_LEGACY_2023", date(2023, 1, 1), 20.0, 0.0003, 0.00025, 0.0000345, 0.000001, 0.18, 0.00003),
    CostSchedule("NSE_EQUITY_OCT_2024", date(2024, 10, 1), 20.0, 0.0003, 0.00025, 0.0000297, 0.000001, 0.18, 0.00003),
)


def schedules(spark: SparkSession, rows: tuple[CostSchedule, ...] = SCHEDULES) -> DataFrame:
    """The schedules with the day each ends; the first holds from the beginning, the last for good."""
    ends = [*(s.valid_from for s in rows[1:]), None]
    data = [(s.name, None if k == 0 else s.valid_from, e, s.flat, s.brokerage, s.stt_sell, s.exchange, s.sebi, s.gst, s.stamp_buy) for k, (s, e) in enumerate(zip(rows, ends, strict=True))]
    return spark.createDataFrame(data, "schedule string, valid_from date, valid_to date, flat double, brokerage double, stt_sell double, exchange double, sebi double, gst double, stamp_buy double")


def with_schedule(df: DataFrame, day: str, rows: tuple[CostSchedule, ...] = SCHEDULES) -> DataFrame:
    """df with the schedule of each row's day; the last one for a row without a day. The few schedules are broadcast."""
    s = schedules(df.sparkSession, rows)
    d = F.coalesce(F.col(day), F.lit(date(9999, 12, 31)))
    return df.join(F.broadcast(s), (s.valid_from.isNull() | (d >= s.valid_from)) & (s.valid_to.isNull() | (d < s.valid_to)), "left").drop("valid_from", "valid_to")


def round_trip_cost(value: Column, s=F.col) -> Column:
    """Costs of buying and selling for value, as a share of it; 0 without value. s maps a schedule field to a column."""
    brokerage = F.least(s("flat") * 2.0, value * 2.0 * s("brokerage"))
    exchange, sebi = value * 2.0 * s("exchange"), value * 2.0 * s("sebi")
    gst = (brokerage + exchange + sebi) * s("gst")
    fees = brokerage + value * s("stt_sell") + exchange + sebi + gst + value * s("stamp_buy")
    return ratio(fees, value, 0.0)


def fixed_cost(schedule: CostSchedule = SCHEDULES[-1], value: float = schema.TRADE_VALUE) -> float:
    """round_trip_cost of one schedule and value, as a number."""
    brokerage = min(schedule.flat * 2.0, value * 2.0 * schedule.brokerage)
    exchange, sebi = value * 2.0 * schedule.exchange, value * 2.0 * schedule.sebi
    fees = brokerage + value * schedule.stt_sell + exchange + sebi + (brokerage + exchange + sebi) * schedule.gst + value * schedule.stamp_buy
    return fees / value if value > 0 else 0.0


def long_return(ask: Column, forward_bid: Column, cost: Column | float) -> Column:
    """Buy at the ask, sell at the forward bid."""
    return F.when((ask > 0) & (forward_bid > 0), (forward_bid - ask) / ask - cost)


def short_return(bid: Column, forward_ask: Column, cost: Column | float) -> Column:
    """Sell at the bid, buy back at the forward ask."""
    return F.when((bid > 0) & (forward_ask > 0), (bid - forward_ask) / bid - cost)


def baseline_score(w_obi_lin: Column, trade_strength: Column, pressure_bps: Column) -> Column:
    """The score in [-1, 1] that stands in where no model is loaded."""
    parts = 0.35 * clamp(finite(w_obi_lin), 1.0) + 0.35 * clamp(finite(trade_strength), 1.0) + 0.30 * F.tanh(finite(pressure_bps) / 50.0)
    return clamp(parts, 1.0)


def band(score: Column, width: float = schema.NEUTRAL_BAND) -> Column:
    return F.when(score > width, 1).when(score < -width, -1).otherwise(0)


def display_split(score: Column) -> dict[str, Column]:
    """A score as percents of down, neutral and up, and itself in [-100, 100]."""
    size = F.abs(score) * 100.0
    return {
        "down_percent": F.when(score < 0, size).otherwise(0.0),
        "neutral_percent": 100.0 - size,
        "up_percent": F.when(score > 0, size).otherwise(0.0),
        "score_percent": clamp(score * 100.0, 100.0),
    }


def standardize(x: Column, mean: float, std: float) -> Column:
    """(x - mean) / std; an undefined x raises."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("feature is not finite"))).otherwise((x - mean) / std)


#: Minutes of the day, Indian time, at which phases begin (fixed values).
PHASES = ((0, "CLOSED"), (540, "PRE_OPEN_ORDER_ENTRY"), (548, "PRE_OPEN_MATCHING"), (555, "CONTINUOUS_TRADING"), (930, "POST_CLOSE"), (960, "CLOSED"))


def session_phase(ts: Column) -> Column:
    """The phase of a timestamp (session time zone UTC): half-open ranges on weekdays, CLOSED at weekends."""
    local = F.from_utc_timestamp(ts, "Asia/Kolkata")
    minute = F.hour(local) * 60 + F.minute(local)
    out = F.when(ts.isNull(), F.lit(None)).when(F.weekday(local) >= 5, "CLOSED")
    for start, phase in reversed(PHASES):
        out = out.when(minute >= start, phase)
    return out

