"""Connected components of a link table, by contraction; nothing is collected to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import drop_staged, stage


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of ``links`` (a, b); comp is a node of the component, the same for all of it.

    In each round every node points to its least neighbour (or itself) and the links are redrawn between what
    their ends point to.  Ids should be hashes: then a round removes a constant fraction of the nodes whatever
    the shape of the graph, and rounds grow with the logarithm of its size.  An aggregation by node is combined
    map-side, so a node with very many links costs one row per task.
    """
    edges = stage(links.select("a", "b").where("a != b").distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).select(F.col("a").alias("node"), "p"), "point")
        if label is None:
            new = point.withColumnRenamed("p", "comp")
        else:
            new = label.join(point.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        new = stage(new, "label")
        pa, pb = (point.select(F.col("node").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b"))
        after = edges.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        after = stage(after.where("a != b").distinct(), "links")
        for old in (edges, point, *([label] if label is not None else [])):
            drop_staged(old)
        edges, label = after, new
    drop_staged(edges)
    return label if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
