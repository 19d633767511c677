"""Connected components by alternating star steps, each a partial aggregation and a join that Spark can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Cut


def smallest_neighbour(edges: DataFrame) -> DataFrame:
    """u, m: the smallest v of each u. The key is made anew so that a join on it deals both sides out and can split a hot one."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("k"), "m")


def connected_components(edges: DataFrame) -> Cut:
    """node, component (the smallest node that links reach), for each node of an edge.

    edges: columns a and b, longs. Loops, repeated and null edges change nothing. No edge gives an empty table.
    Each round writes its edges to the shared folder and drops the round before; rounds grow with the logarithm of the longest path.
    """
    now = Cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while (found := now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != mark:
        mark = found
        if not found[0]:
            break
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest_neighbour(both).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large star done: each u > v; the small star hangs u's smaller neighbours and u itself on the smallest
        half = Cut(large, "links")
        now.drop()
        least = smallest_neighbour(half.df)
        small = half.df.join(least, half.df.u == least.k).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = Cut(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        half.drop()
    now.df = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return now
