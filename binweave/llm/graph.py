"""Connected components of links between nodes, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """Rows (a, b) of longs in; rows (node, label) out, label being the smallest node that
    links reach. Nodes without links to others don't appear.

    Every node takes the least label of its neighbours, then the label of its label, so
    that chains halve; near copies lie close together and end after a few rounds. Minima
    are combined before they are shuffled, and both sides of each join are plain tables,
    so that a hub is never gathered in one task. A written table ends each round's lineage."""
    pair = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    edges = materialise(links.where("a <> b").select(pair.alias("p")).select("p.u", "p.v").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("least"))
        new = labels.join(near, "node").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("moved"))
        new = materialise(new, "moved")
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        labels = materialise(new.select("node", "label").join(new.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label")), "labels")
