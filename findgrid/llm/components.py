"""Connected components of a table of links by least labels and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrid.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component): the least node reachable, for every node of the links (a, b) of longs.

    Every round takes the least label among neighbours, then the label of the label, so long chains halve; each round is
    written once. An empty table gives no rows."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = save(both.filter("a <> b").distinct(), "links")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = save(step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("old <> label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
