"""Connected components of an edge table, for operators that link rows."""

from pyspark.sql import DataFrame, functions as F

from tabia.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b); the label is the component's smallest node.

    Each round takes the smallest label among the neighbours and then jumps to
    that label's label, so the rounds grow with the logarithm of the longest
    path. Minima are combined before the shuffle, a hub is a skewed join key
    against one row, and every round is a written table. Nothing but the number
    of changes reaches the driver.
    """
    both = stored(
        edges.select("a", "b")
        .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b")
        .distinct()
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("low"), F.col("label").alias("old")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = stored(
            lower.join(jump, "low", "left").select(
                "node", F.least("low", F.coalesce("far", "low")).alias("label"), "old"
            )
        )
        moved = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
