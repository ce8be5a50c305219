"""Ranked lists as rows: cuts, fusion, interleaving, quotas.

Ranks are 1-based. Every order ends in a key, so a cut never depends on arrival.
`row_number() <= k` lets the planner cut each partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The fusion constant, the branch cut, the relevance cut-off and the list length.
RRF_OFFSET = 1  # rank from 0 plus 2 is rank from 1 plus 1
PREFETCH = 20
RELEVANCE_CUTOFF = 0.5
TOP_K = 5
SCORE_DIGITS = 9


def top_k(
    scored: DataFrame,
    groups: Sequence[str],
    k: int | None,
    score: str = "score",
    key: str = "row_key",
    rank: str = "rn",
) -> DataFrame:
    """Per group the first `k` rows by score, equal scores by key."""
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(key).asc())
    ranked = scored.withColumn(rank, F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def merge_pools(pools: Sequence[DataFrame]) -> DataFrame:
    """Candidate pools of several collections as one."""
    return reduce(lambda a, b: a.unionByName(b), pools)


def rrf_fuse(
    branches: Sequence[DataFrame], group: str, key: str = "row_key", limit: int | None = None
) -> DataFrame:
    """Reciprocal rank fusion of ranked branches: (group, key, rn) -> (group, key, score, rn)."""
    listed = merge_pools([b.select(group, key, "rn") for b in branches])
    fused = listed.groupBy(group, key).agg(
        F.round(F.sum(1 / (F.col("rn") + RRF_OFFSET)), SCORE_DIGITS).alias("score")
    )
    return top_k(fused, [group], limit, key=key)


def round_robin(
    pools: Sequence[DataFrame], group: str, limit: int | None = None
) -> DataFrame:
    """Pools interleaved rank by rank, longer ones filling the rest."""
    tagged = [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)]
    order = Window.partitionBy(group).orderBy("rn", "pool")
    mixed = merge_pools(tagged).withColumn("place", F.row_number().over(order))
    if limit is not None:
        mixed = mixed.where(F.col("place") <= limit)
    return mixed.withColumn("rn", F.col("place").cast("long")).drop("place", "pool")


def quota_cut(
    ranked: DataFrame,
    group: str,
    kind: str,
    quotas: dict[bool, int | None],
    score: str = "score",
    key: str = "row_key",
) -> DataFrame:
    """Ranked candidates under one quota per kind; a quota of None keeps all of a kind."""
    by_kind = Window.partitionBy(group, kind).orderBy(F.col(score).desc(), F.col(key))
    numbered = ranked.withColumn("in_kind", F.row_number().over(by_kind))
    keep = F.lit(False)
    for value, quota in quotas.items():
        of_kind = F.col(kind) == value
        keep = keep | (of_kind if quota is None else of_kind & (F.col("in_kind") <= quota))
    return top_k(numbered.where(keep).drop("in_kind"), [group], None, score=score, key=key)


def keep_first_above(
    ranked: DataFrame, group: str, min_score: float | None, limit: int | None
) -> DataFrame:
    """The best hit always, the rest at or above the cut-off, then at most `limit`."""
    kept = ranked
    if min_score is not None:
        kept = kept.where((F.col("rn") == 1) | (F.col("score") >= min_score))
    order = Window.partitionBy(group).orderBy("rn")
    again = kept.withColumn("place", F.row_number().over(order))
    if limit is not None:
        again = again.where(F.col("place") <= limit)
    return again.withColumn("rn", F.col("place").cast("long")).drop("place")


def rerank(
    pool: DataFrame,
    group: str,
    scorer: Column,
    rank: str = "rn",
) -> DataFrame:
    """Fusion scores replaced by a relevance score, the whole pool sorted by it.

    The sort is stable: equal scores keep the order they had.
    """
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("was"))
    return (
        pool.withColumn("was", F.col(rank))
        .withColumn("score", F.round(scorer, SCORE_DIGITS))
        .withColumn(rank, F.row_number().over(order).cast("long"))
        .drop("was")
    )
