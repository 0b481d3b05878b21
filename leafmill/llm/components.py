"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed

ROWS = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Each round hangs every node's larger neighbours below its smallest neighbour, then its smaller ones, which halves
    paths; it ends when nothing moves.  Each round is checkpointed, no round gathers a node's neighbours in one place.
    Links between a node and itself and null ends are ignored.  Empty links give no rows.  Partitions follow the number
    of links, about ``ROWS`` each: the links are few and small against the rows they stem from."""
    edges = checkpointed(links.where(f"{a} <> {b}").select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, parts = now, 1 + now[0] // ROWS
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("near"))
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("near").alias("v")).coalesce(parts)
        near = large.groupBy("u").agg(F.min("v").alias("near"))
        small = large.join(near, "u").where("v <> near").select(F.col("v").alias("u"), F.col("near").alias("v"))
        edges = checkpointed(small.unionByName(near.select("u", F.col("near").alias("v"))).coalesce(parts).distinct().coalesce(parts))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
