"""Connected components of a link table, distributed: minima of neighbours, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.scratch import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of each id in links (a, b); written to the scratch folder.

    Each round gives an id the smallest label among its neighbours and itself, then that label's
    own label. It ends when no label falls; repeated links and links of an id to itself do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.write(both.distinct())
    labels = scratch.write(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    weight = lambda t: t.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    before = weight(labels)
    while before is not None:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = scratch.write(low.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component")))
        scratch.drop(labels)
        labels, now = after, weight(after)
        if now == before:
            break
        before = now
    scratch.drop(edges)
    return labels
