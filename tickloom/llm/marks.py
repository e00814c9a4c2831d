"""Rows whose key is one of many ids, told where the rows are: a filter of bounded size instead of a shuffle of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most bits of a filter (32 MB).
MOST_BITS = 1 << 28
#: The column that marked() adds.
MARKED = "_tickloom_marked"


def marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with MARKED: true if key is one of ids (column id), and for few others.

    The hashes of ids, modulo a number of bits, are set bits; blocks of them are broadcast, MOST_BITS
    in all at most. Beyond that more of the others are marked, none less of the ids. A null key is not marked.
    """
    bits = min(MOST_BITS, max(1 << 20, 1 << (16 * ids.count()).bit_length()))
    block = 1 << 15
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    of_block = lambda c: (c - c % block) / block
    blocks = ids.where("id is not null").select(slot("id").alias("slot")).groupBy(of_block(F.col("slot")).cast("long").alias("_tickloom_block")).agg(F.bitmap_construct_agg(F.col("slot") % block).alias("_tickloom_bits"))
    at = F.col("_tickloom_slot") % block
    byte = F.conv(F.hex(F.substring("_tickloom_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.col(key).isNotNull() & (F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1)
    placed = rows.withColumn("_tickloom_slot", slot(key)).withColumn("_tickloom_block", of_block(F.col("_tickloom_slot")).cast("long"))
    return placed.join(F.broadcast(blocks), "_tickloom_block", "left").withColumn(MARKED, F.coalesce(is_set, F.lit(False))).drop("_tickloom_block", "_tickloom_slot", "_tickloom_bits")
