"""Bounded samples of labelled rows: what the classifiers are fitted on.

A row is drawn by a hash of its doc_id and its text, so a sample holds the same rows each time,
rows that repeat both count once, and one doc_id with many texts can't fill it. Which rows reach
the driver is told by their hashes and sizes before any text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.sources.scratch import Scratch

_RANGE = 1 << 30


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of a doc_id as text, modulo parts; null for a null one."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def _hash(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(_RANGE))


def stratified(rows: DataFrame, label: str, per_label: int | dict, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About per_label distinct rows of each label (or as a dict has it by label), the same ones each time; all of a label that has fewer.

    Rows are taken by a hash of keys under a threshold for each label, so nothing is sorted or
    gathered: the thresholds are a table of one row a label, broadcast to the rows. No label is
    left out; a null one teaches nothing. Rows that agree in keys and label are one.
    """
    if isinstance(per_label, dict):
        wanted = F.coalesce(*[F.when(F.col(label) == F.lit(v), F.lit(n)) for v, n in per_label.items()], F.lit(0))
    else:
        wanted = F.lit(per_label)
    share = F.ceil(F.least(F.lit(1.0), wanted / F.col("_n")) * F.lit(_RANGE))
    hashed = rows.where(F.col(label).isNotNull()).withColumn("_hash", _hash(keys))
    # The count of distinct hashes is near enough, and made in one pass.
    below = hashed.groupBy(label).agg(F.approx_count_distinct("_hash", 0.02).alias("_n")).select(F.col(label).alias("_label"), share.alias("_below"))
    taken = hashed.join(F.broadcast(below), (F.col(label) == F.col("_label")) & (F.col("_hash") < F.col("_below")))
    return taken.drop("_label", "_below", "_hash").dropDuplicates([*keys, label])


def labelled(scratch: Scratch, docs: DataFrame, labels: DataFrame, label: str, per_label: dict[int, int], strict: bool) -> DataFrame:
    """doc_id, text and label of about per_label documents of each label (0 or 1, by doc_id), written to the scratch folder.

    A document labelled twice takes the lower label if strict, else the higher. Null labels, ids
    and texts teach nothing. Where a doc_id has many texts, or few documents have their label,
    the rows found are thinned or stay as they are; the sample is never filled up.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min if strict else F.max)(label).alias("label"))
    chosen = F.broadcast(stratified(marked, "label", per_label))
    found = scratch.write(docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label")))
    return stratified(found, "label", per_label, ("doc_id", "text"))


def collected(rows: DataFrame, label: str, keys: tuple[str, ...], most_rows: int | dict, most_bytes: int, of: str = "text") -> list[Row]:
    """Rows in the order of their hashes: of each label most_rows at most, whose column `of` has most_bytes in all at most.

    Hashes and sizes are collected first, a few thousand numbers. A row over most_bytes by itself
    is passed over, as it can't be held; the others are taken in the order of their hashes, whatever their
    lengths, until the next does not fit.
    """
    order = _hash(keys)
    sizes = sorted(tuple(r) for r in rows.select(label, order.alias("h"), F.octet_length(of).alias("n")).collect())
    ends: dict = {}
    for value in {s[0] for s in sizes}:
        held, upto = 0, -1
        own = [s for s in sizes if s[0] == value and s[2] <= most_bytes]
        for _, h, n in own[: most_rows if isinstance(most_rows, int) else most_rows.get(value, 0)]:
            held += n
            if held > most_bytes:
                break
            upto = h
        ends[value] = upto
    if not ends:
        return []
    reach = F.coalesce(*[F.when(F.col(label) == F.lit(v), F.lit(h)) for v, h in ends.items()])
    out = rows.where((F.octet_length(of) <= most_bytes) & (order <= reach)).withColumn("_order", order).collect()
    return sorted(out, key=lambda r: (r["_order"], *(r[k] for k in keys)))
