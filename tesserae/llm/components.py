"""Connected components of very large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import cut


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph's edges (a, b): every node that has an edge, with the least node of its component.

    In turn each node hands its least neighbour to its larger ones and to its smaller ones, until every
    component is one star. Neighbourhoods are only ever aggregated (a minimum, combined map-side) and joined
    back, never gathered, so that a node with very many neighbours is no hot group; the number of rounds
    grows with the logarithm of a component's width. Edges from a node to itself give nothing.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())  # a is the larger end
    seen = None
    while True:
        # larger neighbours get the least of a node's whole neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # smaller ones, and the node itself, get the least of them
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        joined = now.join(least, "a")
        now = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # a star for each component is left as it is; two different states do not agree in number and both sums
        was, seen = seen, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("bigint"))).first())
        if seen == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
