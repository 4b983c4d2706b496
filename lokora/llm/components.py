"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node reachable, for every node of ``edges(a, b)``.

    Only minima are aggregated, so that a node with very many edges is combined
    in the map tasks; each step is written to the shared folder.  Edges with a
    null end and loops are ignored.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Large star: hang each larger neighbour on the smallest one.
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: hang a node and its smaller neighbours on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        now = stage(small.distinct(), "edges")
        if now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
