"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouch.session import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: every node of an edge with the smallest node it can reach.

    ``edges`` has two bigint columns.  Alternating large and small stars (Kiveris and
    others, *Connected Components in MapReduce and Beyond*, 2014): every step moves edges
    towards the smallest neighbour, in a number of rounds that grows with the logarithm
    of the largest component.  Neighbourhoods are only ever aggregated, so no group is
    held in one task; written tables on both sides of a join let Spark split a hub.
    Loops, repeated edges and null ends are left out; no edges give no rows.
    """
    a, b = edges.columns[:2]
    a, b = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"
        )
        large = materialize(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(
            moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small"
        )
        before, now, mark = mark, small, _mark(small)
        if mark == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
