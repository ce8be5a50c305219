"""Prompt material built from ranked hits and earlier turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions.citations import without_brackets
from scriptorium.functions.text import neutralize, quoted, shorten

# Fixed value: how much of an earlier answer the history keeps.
HISTORY_ANSWER_CHARS = 400


def context_block(hits: DataFrame, key: str) -> DataFrame:
    """Per query, its numbered excerpts in rank order: (key, rank, marker, text) -> text.

    A query has at most its top-k hits, so the list per group is bounded by k.
    """
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("marker"), F.lit("\n"),
        quoted(neutralize(F.col("text"))),
    )
    return (
        hits.select(key, "rank", block.alias("block"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
        .select(key, F.array_join(F.col("blocks.block"), "\n\n").alias("context"))
    )


def history_block(turns: DataFrame, key: str) -> DataFrame:
    """Per conversation, its last turns as quoted prose: (key, pos, question, answer)."""
    answer = shorten(without_brackets(F.col("answer")), HISTORY_ANSWER_CHARS)
    exchange = F.concat(
        F.lit("Student: "), F.col("question"), F.lit("\nAssistant: "), answer
    )
    return (
        turns.select(key, "pos", quoted(neutralize(exchange)).alias("block"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("blocks"))
        .select(key, F.array_join(F.col("blocks.block"), "\n\n").alias("history"))
    )
