"""Connected components of a table of edges, in Spark.

Alternating large-star and small-star steps: each vertex links its larger
neighbours to its smallest, then itself and its smaller ones to the smallest, till
every component is a star around its smallest vertex.  Each round is two joins on
rows of two ids and ends in a written table; nothing is collected but a count and
a checksum.  A vertex of very many edges is a key of thin rows, and its minimum is
taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a, b); the component is its smallest node."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        drop(e)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        drop(large)
        after = _state(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = cut(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop(e)
    return out
