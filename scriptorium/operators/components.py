"""Connected components of an edge table by alternating star contractions.

Each round is two grouped minima and two equi-joins. A hub's neighbours are only
ever aggregated by `min`, never gathered, and every round is written to the shared
folder so a lost executor re-reads one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.session import cut_lineage


def _toward_minimum(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """One star operation: (node, parent) edges re-pointed at the neighbourhood's minimum.

    With `smaller_only` a node re-points its smaller neighbours and itself, otherwise
    its larger neighbours.
    """
    if smaller_only:
        near = edges.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        )
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    lowest = near.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low")
    )
    joined = near.join(lowest, "u")
    if smaller_only:
        moved = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select(F.col("u").alias("a"), F.col("low").alias("b"))
        )
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").distinct()


def _fingerprint(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component), the component named by its smallest node.

    Nodes without an edge do not appear; they are components of their own.
    """
    current = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    before = _fingerprint(current)
    while True:
        grown = _toward_minimum(current, smaller_only=False)
        current = cut_lineage(_toward_minimum(grown, smaller_only=True))
        after = _fingerprint(current)
        if after == before:
            members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
            return members.unionByName(roots).distinct()
        before = after
