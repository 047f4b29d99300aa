"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import release, through_table


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with m, the smallest of a and all its neighbours b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least.withColumn("m", F.least("a", "m")), "a")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; edges are longs (a, b).

    Large-star links the larger neighbours of each node to its smallest, then
    small-star the smaller ones, until the edges stay as they are, which is
    when they form stars.  Minima are combined before they are shuffled, and
    the joins are plain equi-joins, so hubs are split by adaptive execution.
    Each round is written to the shared folder and the one before deleted;
    nothing is collected but a count and a checksum.  Null ends and self-links
    are ignored.
    """
    now = through_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = _to_smallest(large)
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            near.select("a", F.col("m").alias("b"))
        )
        old, now = now, through_table(small.distinct(), "stars")
        release(old)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    out = through_table(found, "components")
    release(now)
    return out
