"""Connected components of a link table, by alternating star contraction.

Each round is a grouped minimum and a join back, so a node with very many links is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import staged


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()


def _towards_minimum(pairs: DataFrame) -> DataFrame:
    """(node, near): every near and node itself are linked to the smallest of them."""
    least = pairs.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
    return pairs.join(least, "node")


def _edges(a: str, b: str):
    return F.greatest(a, b).alias("high"), F.least(a, b).alias("low")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links(a, b)`; component is the smallest node reachable.

    Links with a null end or to itself are left out; repeated links do no harm.  An empty table gives an
    empty table.
    """
    edges = links.where("a != b").select(*_edges("a", "b")).distinct()
    edges = staged(edges, "links")
    mark = _mark(edges)
    while True:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("near"))
        )
        large = _towards_minimum(both).where("near > node and near != least")
        large = large.select(F.col("near").alias("high"), F.col("least").alias("low")).distinct()
        down = large.select(F.col("high").alias("node"), F.col("low").alias("near"))
        small = _towards_minimum(down).select("near", "node", "least")
        small = small.select(F.explode(F.array("near", "node")).alias("high"), F.col("least").alias("low"))
        edges = staged(small.where("high != low").distinct(), "links")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
