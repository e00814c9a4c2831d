"""Feed payloads as snapshots, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.book import Book
from tickloom.sources.ticks import with_symbol

# Fixed values.
KITE_LENGTH = 184
DHAN_LEVELS = 20
DHAN_SCHEMA = "securityId string, LTP double, LTQ bigint, avgPrice double, volume bigint, exchangeTime bigint, depth struct<buy: array<struct<price: double, quantity: bigint, orders: int>>, sell: array<struct<price: double, quantity: bigint, orders: int>>>"


def unsigned(data: Column, offset: int, size: int) -> Column:
    """A big-endian unsigned number at a byte offset of a binary column."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("bigint")


def signed32(data: Column, offset: int) -> Column:
    u = unsigned(data, offset, 4)
    return F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u)


def kite(packets: DataFrame, symbols: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Snapshots of 184-byte packets (packet, arrival_nanos, arrival_micros): paise as units of a hundred.

    A shorter or missing packet raises, or is skipped if not strict.
    """
    p = F.col("packet")
    long_enough = F.coalesce(F.octet_length(p) >= KITE_LENGTH, F.lit(False))
    if strict:
        packets = packets.withColumn("packet", F.when(long_enough, p).otherwise(F.raise_error(F.lit("packet is shorter than 184 bytes")).cast("binary")))
    else:
        packets = packets.where(long_enough)
    price = lambda at: signed32(p, at) / 100.0
    side = lambda start: {
        "quantities": F.array(*[unsigned(p, start + 12 * i, 4) for i in range(5)]),
        "prices": F.array(*[price(start + 12 * i + 4) for i in range(5)]),
        "orders": F.array(*[unsigned(p, start + 12 * i + 8, 2).cast("int") for i in range(5)]),
    }
    out = packets.select(
        F.lit("ZERODHA").alias("source_id"), unsigned(p, 0, 4).alias("instrument_token"), F.col("arrival_nanos").alias("client_arrival_nanos"), F.col("arrival_micros").alias("client_arrival_micros"),
        unsigned(p, 60, 4).alias("exchange_epoch_secs"), price(4).alias("ltp"), unsigned(p, 8, 4).alias("ltq"), unsigned(p, 16, 4).alias("cumulative_volume"), price(12).alias("day_vwap"), F.lit(5).alias("depth_levels"),
        *[c.alias(f"bid_{k}") for k, c in side(64).items()], *[c.alias(f"ask_{k}") for k, c in side(124).items()],
    )
    return with_symbol(out, symbols).withColumn("state_tag", Book.arrays(5).tag())


def dhan(messages: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Snapshots of JSON messages (json, arrival_nanos, arrival_micros): 20 levels, padded with zeros; missing fields are 0."""
    m = messages.withColumn("m", F.from_json("json", DHAN_SCHEMA))

    def side(name: str, field: str, zero: str) -> Column:
        got = F.coalesce(F.col(f"m.depth.{name}.{field}"), F.expr(f"cast(array() as array<{zero}>)"))
        filled = F.transform(got, lambda v: F.coalesce(v, F.lit(0).cast(zero)))
        return F.slice(F.concat(filled, F.array_repeat(F.lit(0).cast(zero), DHAN_LEVELS)), 1, DHAN_LEVELS)

    zero = lambda c, t: F.coalesce(F.col(f"m.{c}"), F.lit(0).cast(t))
    out = m.select(
        F.lit("DHAN").alias("source_id"), F.coalesce(F.col("m.securityId").cast("bigint"), F.lit(0)).alias("instrument_token"), F.col("arrival_nanos").alias("client_arrival_nanos"), F.col("arrival_micros").alias("client_arrival_micros"),
        zero("exchangeTime", "bigint").alias("exchange_epoch_secs"), zero("LTP", "double").alias("ltp"), zero("LTQ", "bigint").alias("ltq"), zero("volume", "bigint").alias("cumulative_volume"), zero("avgPrice", "double").alias("day_vwap"), F.lit(DHAN_LEVELS).alias("depth_levels"),
        *[side(s, f, t).alias(f"{n}_{k}") for s, n in (("buy", "bid"), ("sell", "ask")) for f, k, t in (("price", "prices", "double"), ("quantity", "quantities", "bigint"), ("orders", "orders", "int"))],
    )
    return with_symbol(out, symbols).withColumn("state_tag", Book.arrays(DHAN_LEVELS).tag())
