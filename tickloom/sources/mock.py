"""A seeded mock feed: hash expressions of a running number, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tick, half spread, level step, quantity range, orders range.
TICK, HALF_SPREAD, STEP, QUANTITY, ORDERS = 0.05, 0.25, 0.10, 500, 10


def feed(rows: DataFrame, levels: int = 20, token: int | Column = 1001, start: float = 2500.0, seed: int = 42) -> DataFrame:
    """Snapshots for rows with a column value (0, 1, ...): a price that swings around start on a tick of 0.05."""
    n = F.col("value")
    token = token if isinstance(token, Column) else F.lit(token)
    draw = lambda salt, m: F.pmod(F.xxhash64(n, F.lit(salt), F.lit(seed)), F.lit(m))
    walk = F.sin(n / 37.0) * 5 + F.sin(n / 11.0) * 2 + draw(0, 41) / 20.0 - 1.0
    ltp = F.round((F.lit(start) + walk) / TICK) * TICK
    side = lambda sign: F.array(*[F.round(ltp + sign * (HALF_SPREAD + STEP * i), 2) for i in range(levels)])
    quantity = lambda salt: F.array(*[(100 + draw(salt + i, QUANTITY) * (levels - i)).cast("bigint") for i in range(levels)])
    orders = lambda salt: F.array(*[(1 + draw(salt + i, ORDERS)).cast("int") for i in range(levels)])
    return rows.select(
        F.lit("MOCK").alias("source_id"), token.cast("bigint").alias("instrument_token"), F.concat(F.lit("TOKEN_"), token.cast("string")).alias("symbol"),
        (n * 10_000_000).alias("client_arrival_nanos"), (n * 10_000).alias("client_arrival_micros"), F.expr("value div 100").alias("exchange_epoch_secs"),
        F.round(ltp, 2).alias("ltp"), (1 + draw(1, 100)).alias("ltq"), (n * 50).alias("cumulative_volume"), F.round(ltp, 2).alias("day_vwap"), F.lit(levels).alias("depth_levels"),
        side(-1).alias("bid_prices"), quantity(100).alias("bid_quantities"), orders(200).alias("bid_orders"),
        side(1).alias("ask_prices"), quantity(300).alias("ask_quantities"), orders(400).alias("ask_orders"), F.lit("NORMAL").alias("state_tag"),
    )


def batch(spark: SparkSession, n: int, **kind) -> DataFrame:
    return feed(spark.range(n).withColumnRenamed("id", "value"), **kind)


def stream(spark: SparkSession, rows_per_second: int = 100, **kind) -> DataFrame:
    return feed(spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load(), **kind)
