"""State along the ticks of an instrument, as windows over one exchange by its keys.

Ties in time are in the order of seq. keys may hold a trade date before the token, so that a
heavy instrument is dealt out by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.functions.book import Book, ratio

KEYS = ("instrument_token",)
TIME = ("mono_nanos", "seq")


def along(keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME):
    return Window.partitionBy(*keys).orderBy(*time)


def trade(book: Book) -> tuple[Column, Column]:
    """Whether a tick has a trade with volume and price, and its side by the quote (NULL between the quotes)."""
    traded = (F.col("ltq") > 0) & (F.col("ltp") > 0)
    return traded, F.when((book.ask[0] > 0) & (F.col("ltp") >= book.ask[0]), "BUY").when((book.bid[0] > 0) & (F.col("ltp") <= book.bid[0]), "SELL")


def aggressor(df: DataFrame, book: Book | None = None, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """df with side: BUY or SELL by the quote, else by the last price move, else as before; UNKNOWN at first.

    A trade without volume or price leaves the state as it was.
    """
    w = along(keys, time)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    traded, quote = trade(book or Book.unrolled())
    out = df.withColumn("_prev", F.last(F.when(traded, F.col("ltp")), ignorenulls=True).over(before))
    tick = F.when(F.col("ltp") > F.col("_prev"), "BUY").when(F.col("ltp") < F.col("_prev"), "SELL")
    out = out.withColumn("_moved", F.when(traded, F.coalesce(quote, tick)))
    held = F.last("_moved", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("side", F.when(traded, F.coalesce(held, F.lit("UNKNOWN")))).drop("_prev", "_moved")


def volumes(df: DataFrame, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """df (with side) with running buy_volume, sell_volume and trade_count; the count takes any trade with volume."""
    w = along(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("ltq")).otherwise(0)).over(w)
    return df.withColumns({"buy_volume": of("BUY"), "sell_volume": of("SELL"), "trade_count": F.sum(F.when(F.col("ltq") > 0, 1).otherwise(0)).over(w)})


def strength() -> dict[str, Column]:
    """trade_strength, buy_pressure and sell_pressure of running volumes."""
    b, s = F.col("buy_volume"), F.col("sell_volume")
    return {"trade_strength": ratio(b - s, b + s, 0.0), "buy_pressure": ratio(b, b + s, 0.5), "sell_pressure": ratio(s, b + s, 0.5)}


def cumulative(df: DataFrame, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """df with cum_volume and vwap, summed in whole cents."""
    w = along(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    volume = F.sum("ltq").over(w)
    value = F.sum(F.round(F.col("ltp") * 100).cast("bigint") * F.col("ltq")).over(w)
    return df.withColumns({"cum_volume": volume, "vwap": ratio(value, volume * 100, F.col("ltp"))})


def order_flow(df: DataFrame, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME, levels: int = 5) -> DataFrame:
    """df with l1_ofi, ml_ofi_uniform and ml_ofi_exp against the row before, and ready, unless df has it already.

    The first row has 0; a row has NULL if it or the row before is not fit for computing.
    """
    w = along(keys, time)
    book = Book.unrolled(levels)
    if "ready" not in df.columns:
        df = df.withColumn("ready", book.ready())
    before = Book.unrolled(levels, lambda c: F.lag(c).over(w))
    first = F.lag(F.lit(True)).over(w).isNull()
    both = F.col("ready") & F.lag("ready").over(w)
    flow = lambda x: F.when(first, 0.0).when(both, x)
    return df.withColumns({n: flow(x) for n, x in between(book, before).items()})


def between(book: Book, before: Book) -> dict[str, Column]:
    """The three order flows from one book to the next, fit for computing or not."""
    return {"l1_ofi": book.ofi(before), "ml_ofi_uniform": book.weighted_ofi(before, schema.OFI_UNIFORM_WEIGHTS), "ml_ofi_exp": book.weighted_ofi(before, schema.OFI_EXP_WEIGHTS)}


def arrival_gaps(df: DataFrame, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """Per instrument: n_gaps, mean_gap, min_gap, max_gap of arrivals in nanoseconds (0 without a gap), n_updates."""
    gap = F.col(time[0]) - F.lag(time[0]).over(along(keys, time))
    out = df.withColumn("_gap", gap).groupBy(*keys).agg(F.count("_gap").alias("n_gaps"), F.avg("_gap").alias("mean_gap"), F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), F.count("*").alias("n_updates"))
    return out.na.fill({"mean_gap": 0.0, "min_gap": 0, "max_gap": 0})


def crossed_duration(df: DataFrame, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """Per instrument: nanoseconds between neighbouring rows that are both crossed."""
    w = along(keys, time)
    df = df.withColumn("_tag", Book.unrolled(2).tag())
    both = (F.col("_tag") == "STATE_CROSSED") & (F.lag("_tag").over(w) == "STATE_CROSSED")
    gap = F.when(both, F.col(time[0]) - F.lag(time[0]).over(w)).otherwise(0)
    return df.withColumn("_gap", gap).groupBy(*keys).agg(F.sum("_gap").alias("crossed_nanos"))


def latest(df: DataFrame, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """The last row of each instrument, by an aggregation that combines before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*time)).alias("_row"), F.count("*").alias("n_updates")).select(*keys, "_row.*", "n_updates")


def tail(df: DataFrame, n: int = 300, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """The last n rows of each instrument whose ltp is defined."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in time])
    return df.where(F.col("ltp").isNotNull() & ~F.isnan("ltp")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def phase_changes(df: DataFrame, phase: str, keys: tuple[str, ...] = KEYS, time: tuple[str, ...] = TIME) -> DataFrame:
    """The rows at which the phase differs from the row before, with phase_before (NULL at first)."""
    df = df.withColumn("phase_before", F.lag(phase).over(along(keys, time)))
    return df.where(F.col("phase_before").isNull() | (F.col(phase) != F.col("phase_before")))
