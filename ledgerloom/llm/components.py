"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to a row for each node: node, comp (the smallest node reachable).

    Each round points every node at its smallest neighbour, follows the pointers twice,
    and contracts the edges; stars take one or two rounds, a path of n nodes about log n.
    Minima are aggregated before they are shuffled, and all joins are sort-merge joins
    that can be split where a node has very many edges. Rounds are written to the shared
    folder, so that plans stay short and lost executors cost one round at most.
    """
    both = lambda e: e.union(e.select("b", "a")).distinct()
    edges = stage(both(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")), "edges")
    labels = None
    while not edges.isEmpty():
        point = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        for _ in range(2):
            point = stage(point, "points")
            ahead = point.select(F.col("node").alias("to"), F.col("to").alias("ahead"))
            point = point.join(ahead, "to").select("node", F.col("ahead").alias("to"))
        point = stage(point, "points")
        if labels is None:
            labels = point.select("node", F.col("to").alias("comp"))
        else:
            labels = stage(labels.join(point.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        edges = edges.join(point.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = stage(edges.filter("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
