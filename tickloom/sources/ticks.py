"""Ticks made of an events table: a deterministic book around each event's value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 5
#: Keys that give each day of an instrument a grid, volumes, order flow and targets of its own, and a task of its own.
BY_DAY = ("trade_date", "instrument_token")
_EPOCH = 1_704_067_200_000_000


def ticks(events: DataFrame, bad: bool = False, dense: bool = False, crossed: bool = False, dated: bool = False, pace: int = 5) -> DataFrame:
    """Ticks with the unrolled book b0..b4, qb0.., a0.., qa0.., ob0.., oa0.. in prices of two decimals.

    Time is compressed 18,000 / pace to 1 into mono_nanos; epoch_micros keeps the clock, and with
    dated so does trade_date, the day of the session's time zone. dense folds the tokens into five; bad makes crossed, locked, empty and non-monotonic books of some rows,
    and with crossed two events in five have crossed books.
    """
    e = F.col("event_id")
    base = F.lit(10000) + F.round(F.col("value") * 100).cast("bigint")
    out = events.select(
        (F.col("user_id") % 5 if dense else F.col("user_id")).alias("instrument_token"),
        e.alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("epoch_micros"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("trade_date"),
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("ltq"),
        base.alias("base_c"),
        F.when(F.col("event_type") == "purchase", 25).when(F.col("event_type") == "error", -25).otherwise(0).alias("off"),
    )
    s = F.col("seq")
    cents: dict[str, F.Column] = {}
    for i in range(LEVELS):
        cents[f"b{i}"] = F.col("base_c") - (25 + 10 * i)
        cents[f"a{i}"] = F.col("base_c") + (25 + 10 * i)
    if bad:
        kind = s % 50
        b0, a0, b1 = cents["b0"], cents["a0"], cents["b1"]
        cents["b0"] = F.when(kind == 0, a0).when(kind == 2, F.lit(0)).otherwise(b0)
        cents["a0"] = F.when(kind == 0, b0).when(kind == 1, b0).otherwise(a0)
        cents["b1"] = F.when(kind == 3, b0).otherwise(b1)
        if crossed:
            cents["b0"], cents["a0"] = (F.when(s % 5 < 2, other).otherwise(now) for other, now in ((a0, cents["b0"]), (b0, cents["a0"])))
    qty = {f"q{side}{i}": 100 + ((s * m + i * k + c) % 500) * (5 - i) for side, m, k, c in (("b", 31, 17, 7), ("a", 37, 29, 11)) for i in range(LEVELS)}
    orders = {f"o{side}{i}": (1 + (s + i) % 10).cast("int") for side in "ba" for i in range(LEVELS)}
    return out.select(
        "instrument_token",
        "seq",
        F.expr(f"((epoch_micros - {_EPOCH}) * {pace}) div 18").alias("mono_nanos"),
        "epoch_micros",
        "ltq",
        ((F.col("base_c") + F.col("off")) / 100.0).alias("ltp"),
        *[(c / 100.0).alias(n) for n, c in cents.items()],
        *[c.alias(n) for n, c in (qty | orders).items()],
        *(["trade_date"] if dated else []),
    )


def load(spark: SparkSession, sf_dir: str, **kind: bool | int) -> DataFrame:
    return ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), **kind)


def snapshots(ticks: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Ticks in the snapshot schema: depth as arrays, symbols looked up, TOKEN_<id> where there is none."""
    from tickloom.functions.book import Book

    out = with_symbol(ticks, symbols)
    arrays = {f"{name}_{kind}": F.array(*[F.col(f"{p}{side}{i}") for i in range(LEVELS)]) for name, side in (("bid", "b"), ("ask", "a")) for kind, p in (("prices", ""), ("quantities", "q"), ("orders", "o"))}
    return out.select(
        F.lit("MOCK").alias("source_id"), "instrument_token", "symbol",
        F.col("mono_nanos").alias("client_arrival_nanos"), F.col("epoch_micros").alias("client_arrival_micros"),
        F.expr("epoch_micros div 1000000").alias("exchange_epoch_secs"), "ltp", "ltq",
        F.col("ltq").alias("cumulative_volume"), F.col("ltp").alias("day_vwap"), F.lit(LEVELS).alias("depth_levels"),
        *[c.alias(n) for n, c in arrays.items()], Book.unrolled().tag().alias("state_tag"),
    )


def with_symbol(df: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """df with symbol, from a small table (instrument_token, symbol) or as TOKEN_<id>."""
    default = F.concat(F.lit("TOKEN_"), F.col("instrument_token").cast("string"))
    if symbols is None:
        return df.withColumn("symbol", default)
    named = symbols.select("instrument_token", F.col("symbol").alias("_symbol")).dropDuplicates(["instrument_token"])
    return df.join(named, "instrument_token", "left").withColumn("symbol", F.coalesce("_symbol", default)).drop("_symbol")
