"""Connected components of a link table, as joins and aggregates only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved


def connected_components(links: DataFrame, *, most_rounds: int = 60, save: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b); label is the least node.

    Each round takes the least label among neighbours and then the label of that
    label, so labels travel over doubling distances.  Every round is written to
    the shared folder; nothing is gathered on the driver but one count.
    """
    both = save(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    labels = save(labels, "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", "near").alias("next"))
        hop = labels.select(F.col("node").alias("hop_node"), F.col("label").alias("hop_label"))
        moved = Observation()
        jumped = step.join(hop, F.col("next") == F.col("hop_node"), "left").select("node", "label", F.least("next", "hop_label").alias("next"))
        jumped = save(jumped.observe(moved, F.count_if(F.col("label") != F.col("next")).alias("n")), "labels")
        labels = jumped.select("node", F.col("next").alias("label"))
        if not moved.get["n"]:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
