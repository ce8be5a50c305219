"""Extension points: encoders, pair scorers and judges a user plugs in.

A factory is called once per Python worker, so a model is loaded once and reads
whole Arrow batches. The defaults need no model.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scriptorium.functions.tokens import WORD_PATTERN, words

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
PairScorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
HASH_WIDTH = 64
HASH_HEX_DIGITS = 7


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:HASH_HEX_DIGITS], 16) % HASH_WIDTH


def hashing_encoder() -> Encoder:
    """Unit vectors of hashed word counts: the default encoder."""
    pattern = regex.compile(WORD_PATTERN)

    def one(text: str) -> list[float]:
        vector = [0.0] * HASH_WIDTH
        for word, count in Counter(pattern.findall(text.lower())).items():
            vector[_slot(word)] += count
        length = math.sqrt(sum(x * x for x in vector))
        return [x / length for x in vector] if length else vector

    return lambda texts: [one(t or "") for t in texts]


def encode_batch(
    rows: DataFrame,
    text: str,
    factory: Callable[[], Encoder] = hashing_encoder,
    into: str = "embedding",
) -> DataFrame:
    """`rows` with a vector column, encoded batch by batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for batch in batches:
            yield pd.Series(list(encoder(list(batch))), index=batch.index, dtype=object)

    return rows.withColumn(into, encode(F.col(text)))


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's words the text holds: the default relevance score."""
    asked = F.array_distinct(words(question))
    shared = F.size(F.array_intersect(asked, words(text)))
    return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(F.lit(0.0))


def pair_scorer(factory: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """A relevance score from a user's model: (question, text) -> double."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = factory()
        for question, text in batches:
            yield pd.Series(scorer(list(question), list(text)), index=question.index, dtype=float)

    return score


JUDGEMENT = T.StructType(
    [T.StructField("value", T.DoubleType()), T.StructField("reason", T.StringType())]
)


def judge_scores(
    rows: DataFrame,
    inputs: Sequence[str],
    factory: Callable[[], Callable[[Sequence], float]],
    into: str = "judgement",
) -> DataFrame:
    """Per-row scores that never fail the job: a value, or the reason there is none.

    A judge that raises is `failed`; one that answers with no number is `nan`.
    """

    def verdict(judge, row) -> dict:
        try:
            value = judge(row)
        except Exception:  # noqa: BLE001 - a failing judgement is a counted outcome
            return {"value": None, "reason": "failed"}
        if value is None or math.isnan(value):
            return {"value": None, "reason": "nan"}
        return {"value": float(value), "reason": None}

    @F.pandas_udf(JUDGEMENT)
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = factory()
        for batch in batches:
            given = [verdict(judge, row) for row in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(given, columns=["value", "reason"])

    return rows.withColumn(into, judged(F.struct(*inputs)))


def overlap_scorer() -> PairScorer:
    """The default relevance score as a scorer a user's model would replace."""
    pattern = regex.compile(WORD_PATTERN)

    def one(question: str, text: str) -> float:
        asked = set(pattern.findall(question.lower()))
        return len(asked & set(pattern.findall(text.lower()))) / len(asked) if asked else 0.0

    return lambda questions, texts: [one(q, t) for q, t in zip(questions, texts)]


def length_judge() -> Callable[[Sequence], float]:
    """A stand-in judge over (turn, text): a value, no number, or an exception."""

    def judge(row: Sequence) -> float:
        turn, text = row
        if turn == 3:
            raise ValueError("the judge gave no verdict")
        return math.nan if len(text) % 5 == 0 else (len(text) % 100) / 100

    return judge


def sparse_encode(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Texts as sparse vectors: (key, indices, values), indices ascending.

    A text's entries are bounded by its distinct words.
    """
    slot = F.conv(F.substring(F.md5("term"), 1, HASH_HEX_DIGITS), 16, 10).cast("long")
    return (
        rows.select(key, F.explode(words(F.col(text))).alias("term"))
        .groupBy(key, slot.alias("slot"))
        .agg(F.count("*").alias("tf"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("slot", "tf"))).alias("entries"))
        .select(
            key, F.col("entries.slot").alias("indices"), F.col("entries.tf").alias("values")
        )
    )
