"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (``a``, ``b``: long).

    Every round gives each node the smallest label among its neighbours and then the label
    of its label, so chains shorten by half; rounds end when no label changes. Nodes and
    links stay distributed; a round leaves a table with a row per node.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        least = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        moved = written(
            least.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
