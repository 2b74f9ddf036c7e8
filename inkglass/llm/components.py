"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """``id, label`` of every node that has a link; the label is the least node reachable.

    Nodes may be of any type with an order. Each round takes the least label among the
    neighbours and then jumps to the label's own label, so chains halve; it ends when
    nothing changes. A node with many links meets them in a partial aggregation, and in
    joins whose sides are plain exchanges, which adaptive execution splits where they are
    hot. Nulls, self-links and repeated links are passed over; no links give no rows.
    """
    both = links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = stash(both.union(both.select("v", "u")).distinct(), "cc-edges")
    labels = stash(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")), "cc-labels")
    for _ in range(rounds):
        seen = edges.join(labels, F.col("v") == F.col("id")).groupBy(F.col("u").alias("_u")).agg(F.min("label").alias("_near"))
        near = stash(
            labels.join(seen, F.col("id") == F.col("_u")).select("id", F.least("label", "_near").alias("next"), F.col("label").alias("old")), "cc-near"
        )
        over = near.select(F.col("id").alias("_i"), F.col("next").alias("_jump"))
        moved = near.join(over, F.col("next") == F.col("_i")).select("id", F.least("next", "_jump").alias("label"), "old")
        moved = stash(moved, "cc-labels")
        labels = moved.select("id", "label")
        if not moved.filter("label != old").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
