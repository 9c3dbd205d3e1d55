"""Connected components by alternating large and small stars.

Each half round replaces edges by edges to the smallest neighbour, until only stars remain. Every
round is written to the shared folder; the smallest neighbour is found by an aggregate that combines before
the shuffle, and joined with one row a vertex on the right, so a hot vertex is split by the engine at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (hi, lo) with hi > lo."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
        return edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    return joined.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """id, component (the smallest id) of every vertex with an edge to another one. Null ends and self edges are none."""
    e = scratch.write(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{a}` is not null and `{b}` is not null and hi <> lo").distinct(), "cc0")
    mark, k = None, 0
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).collect()[0]
        if (now.n, now.x) == mark or now.n == 0:
            break
        mark, k = (now.n, now.x), k + 1
        half = scratch.write(_star(e, True), f"cc{k}a")
        e = scratch.write(_star(half, False), f"cc{k}")
        scratch.drop(f"cc{k}a", f"cc{k - 1}")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
