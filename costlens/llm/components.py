"""Connected components of links between whole-numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node that ``links(a, b)`` reach) for each node of a link.

    Each round hooks every node to the smallest label around it and then follows labels to
    their own label, so chains shrink by halves.  Sums are taken where the rows lie
    before they move; a round is written to the shared folder.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # the smallest label next to a node, offered to the node and to the node its label names
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "near").alias("low"))
        offers = step.select("node", "label", "low").unionByName(
            step.where("low < label").select(F.col("label").alias("node"), F.lit(None).cast("long").alias("label"), "low")
        )
        hooked = offers.groupBy("node").agg(F.max("label").alias("old"), F.min("low").alias("low"))
        parent = hooked.select(F.col("node").alias("p"), F.col("low").alias("p_low"))
        jumped = hooked.join(parent, F.col("low") == F.col("p"), "left").select(
            "node", F.least("low", F.coalesce("p_low", "low")).alias("label"), "old"
        )
        labels = stored(jumped, "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
