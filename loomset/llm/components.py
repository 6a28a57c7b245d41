"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.session import materialise


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row.n, int(row.h or 0)


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u``, ``v``, whole numbers): the smallest
    node that can be reached.

    Every node hands its larger neighbours to its smallest one, then its smaller neighbours, until
    all point at the smallest of their component; the number of rounds grows with the logarithm
    of the longest path. Minima are aggregated before they are shuffled, so a node with many
    neighbours is no load for one task. Each round is written, which cuts the lineage.
    """
    u, v = F.col("u"), F.col("v")
    edges = materialise(
        links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(),
        "links",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        handed = (
            both.filter(v > u)
            .join(least, "u")
            .select(v.alias("u"), F.col("least").alias("v"))
            .filter(u != v)
            .distinct()
        )
        # Now every pair is (larger, smaller).
        lower = handed.groupBy("u").agg(F.min("v").alias("least"))
        edges = materialise(
            handed.join(lower, "u")
            .select(F.explode(F.array(F.struct("u", "least"), F.struct(v.alias("u"), "least"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.least").alias("v"))
            .filter(u != v)
            .distinct(),
            "links",
        )
        after = _signature(edges)
        if after == before:
            break
        before = after
    pointed = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pointed.unionByName(roots.join(pointed, "node", "left_anti"))
