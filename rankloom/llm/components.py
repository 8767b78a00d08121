"""Connected components of a link table, by alternating star contraction.

Each round replaces links by links to smaller neighbours until every node
links to the least node of its component. Rounds are DataFrame joins and
aggregates with a reliable checkpoint each; the driver sees three numbers a
round and never links or components. The links of a hub (the centre of a star
that holds a large part of all links) stay where they are: its least neighbour
is broadcast, as ``join_by_key`` says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, join_by_key


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links(a, b)."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total, before = edges.count(), None
    while total:
        # large star: link larger neighbours to the least of a node's neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        edges = cut(join_by_key(both, least, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        total = edges.count()
        # small star: link a node and its smaller neighbours to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_by_key(edges, least, "a", "n", total)
        edges = cut(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if now == before:
            break
        total, before = now[0], now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
