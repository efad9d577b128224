"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import forget, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the smallest node reached.

    Each round points every node at the smallest neighbour of its neighbours, which takes a number of
    rounds that grows with the logarithm of the component's size. Edges always run from the larger node to
    the smaller, so a hub that is its component's smallest node is never a join key with a partner, and the
    minima are partial aggregates. Rounds are written to the shared folder; nothing goes to the driver
    but a count and a checksum. Null nodes and self links are ignored; an empty table gives an empty table.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    e = written(e.distinct())
    seen = checksum(e)
    while seen[0]:
        least = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = e.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        new = written(small.select("e.*").filter("a != b").distinct())
        forget(e)
        e, now = new, checksum(new)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
