"""Hybrid search and the whole retrieval, over a table of questions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators import bm25, vector_search
from scriptorium.operators.encoding import lexical_overlap
from scriptorium.operators.filters import payload_filter
from scriptorium.operators.passages import collapse
from scriptorium.operators.ranking import (
    PREFETCH,
    RELEVANCE_CUTOFF,
    TOP_K,
    keep_first_above,
    merge_pools,
    rerank,
    round_robin,
    rrf_fuse,
)

SLIDES, WEB = "slides", "web"


@dataclass(frozen=True)
class Scope:
    """What a search may see. `editions=None` is everything, `[]` is no slides."""

    editions: Sequence[tuple[str, str]] | None = None
    locale: str | None = None
    ingest_source: str | None = None
    ingest_run_id: str | None = None

    def condition(self, collection: str) -> Column:
        """Editions bind slides only, ingest filters bind web pages only."""
        if collection == WEB:
            return payload_filter(
                locale=self.locale,
                ingest_source=self.ingest_source,
                ingest_run_id=self.ingest_run_id,
            )
        return payload_filter(locale=self.locale, scope=self.editions)


def hybrid_search(
    points: DataFrame,
    queries: DataFrame,
    condition: Column | None = None,
    query: str = "question_id",
    text: str = "question",
    key: str = "row_key",
    body: str = "text",
    vector: str = "embedding",
    prefetch: int = PREFETCH,
    limit: int | None = TOP_K,
    exclude_self: bool = False,
) -> DataFrame:
    """Dense and lexical branches under one filter, fused: (query, key, score, rn).

    `points` and `queries` both carry text and vector. The filter sits below each
    branch's cut; word weights are the whole collection's.
    """
    seen = points if condition is None else points.where(condition)
    dense = vector_search.exact_search(
        seen.select(key, vector),
        queries.select(query, vector),
        query,
        key,
        vector,
        prefetch,
        exclude_self,
    )
    lexical = bm25.search_texts(
        points, queries, query, text, key, body, prefetch, condition, exclude_self
    )
    return rrf_fuse([dense, lexical], query, key, limit)


def retrieve(
    points: DataFrame,
    queries: DataFrame,
    scope: Scope = Scope(),
    collections: Sequence[str] = (SLIDES, WEB),
    query: str = "question_id",
    text: str = "question",
    key: str = "row_key",
    body: str = "text",
    scorer: Column | None = None,
    reranked: bool = True,
    collapsed: bool = True,
    min_score: float | None = RELEVANCE_CUTOFF,
    limit: int | None = TOP_K,
) -> DataFrame:
    """Pools per collection, reranked, copies collapsed, cut: (query, key, score, rn).

    Without reranking, pools keep their fusion order and interleave.
    """
    pools = []
    for collection in collections:
        if collection == SLIDES and scope.editions is not None and not scope.editions:
            continue
        held = points.where(F.col("kind") == collection)
        pools.append(
            hybrid_search(
                held, queries, scope.condition(collection), query, text, key, body, limit=PREFETCH
            )
        )
    if not pools:
        return queries.where(F.lit(False)).select(
            query,
            F.lit(None).cast(points.schema[key].dataType).alias(key),
            F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("long").alias("rn"),
        )
    payload = points.drop("embedding")
    if not reranked:
        lists = [collapse(p.join(payload, key), query, key) if collapsed else p for p in pools]
        return round_robin([p.select(query, key, "score", "rn") for p in lists], query, limit)
    asked = queries.select(query, text)
    # Per pool the fusion rank, pools one after another: the order a stable sort starts from.
    numbered = [p.withColumn("rn", F.col("rn") + i * PREFETCH) for i, p in enumerate(pools)]
    pool = merge_pools(numbered).join(payload, key).join(asked, query)
    scored = scorer if scorer is not None else lexical_overlap(F.col(text), F.col(body))
    ranked = rerank(pool, query, scored)
    if collapsed:
        ranked = collapse(ranked, query, key)
    return keep_first_above(ranked, query, min_score, limit).select(query, key, "score", "rn")
