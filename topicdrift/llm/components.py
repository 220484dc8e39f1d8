"""Connected components of links, by labels that shrink along links and through each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicdrift.runtime import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of the links (a, b).

    A round takes the least label of a node and its neighbours, then the label of that label, so
    long chains need about log2 of their length rounds. Every round is a written table; the
    driver sees one number a round. Repeated and reversed links and loops do no harm.
    """
    links = links.select("a", "b")
    edges = stored(links.union(links.select("b", "a")).distinct())
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        lower = stored(lower)
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = stored(lower.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("further", "to")).alias("component")))
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
