"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and an equi-join, and its result is a table in the
shared storage; nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as decimal(20)))")).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node it is connected with, itself included.

    Loops and repeated or reversed edges are harmless; edges with a null end are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    nodes_only = e.where("ok and u = v").select("u").distinct()
    e = stored(e.where("ok and u <> v").select("u", "v").distinct(), "edges")
    nodes_only = stored(nodes_only, "loops")
    before = _fingerprint(e)
    while True:
        # large star: hang every larger neighbour of a node on the least node around it
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: hang a node and its smaller neighbours on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, e = e, stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(done, large)
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node")).union(nodes_only.select(F.col("u").alias("node"))).distinct()
    lone = roots.join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return stars.union(lone)
