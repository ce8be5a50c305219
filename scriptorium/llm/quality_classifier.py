"""Quality by regularised quadratic discriminant analysis over statistics of a text.

Each text becomes transformed counts (length, word length, variety, repeats, capitals,
symbols, digits, marks and so on; never its labels, language, source or key). Per class
the mean and covariance come from sums of products that Spark adds up over all labelled
training rows; covariances are shrunk toward the pooled one and then toward a sphere.
The score is the logistic of the difference of the two log densities: Mahalanobis
distances through Cholesky factors that are computed once and shipped with the task.

Defined results: a null or empty text has all counts zero and gets its score like any
other; equal texts score alike; rows repeat as they come; with no training row of either
class every score is 0.5, with one class missing it is the other's; labels without a
document, or null, are not used; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.word_arrays import word_hashes
from scriptorium.session import written_once

FEATURES = (
    "words", "word_length", "variety", "repeats", "capitals", "symbols", "digits", "marks", "shouts", "beyond_ascii", "lone",
)
# The fold that is held out, and the score at which a text is called good.
FOLDS, HELD_OUT, GOOD = 4, 2, 0.7
TOWARD_POOLED, TOWARD_SPHERE = 0.1, 0.02
SLICE = 4 << 20  # bytes of text measured at once

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("!")] = 6
_CLASS[128:] = 7
_SPACES = [0x20, *range(0x09, 0x0E)]
_CLASS[_SPACES] = 8


def _sums(of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `of` between neighbouring offsets; empty stretches are 0."""
    out = np.zeros(len(offsets) - 1)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(of, offsets[:-1][full], dtype=np.int64)
    return out


def _measure(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    kinds, own = _CLASS[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    hashes, ends = word_hashes(texts)
    bounds = np.concatenate(([0], ends))
    words = np.diff(bounds).astype(float)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    variety = np.bincount(doc[order], fresh, n) if len(order) else np.zeros(n)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lone_at = np.zeros(len(kinds), bool)
    lone_at[1:-1] = (kinds[1:-1] == 4) & (kinds[:-2] == 8) & (kinds[2:] == 8)
    upper, lower, digit, symbol, mark, shout, beyond, space = (_sums(kinds == k, own) for k in range(1, 9))
    chars = np.maximum(own[1:] - own[:-1] - space, 0.0)
    some = np.maximum(words, 1.0)
    share = lambda a, b: np.log((a + 0.5) / (b - a + 1.5))
    return np.column_stack(
        (
            np.log1p(words),
            np.log1p(chars / some),
            np.log1p(variety) / np.log1p(some),
            np.log1p(100 * _sums(again, bounds) / some),
            share(upper, upper + lower),
            np.log1p(100 * symbol / some),
            np.log1p(100 * digit / some),
            np.log1p(100 * mark / some),
            np.log1p(100 * shout / some),
            share(beyond, np.maximum(chars, beyond)),
            np.log1p(100 * _sums(lone_at, own) / some),
        )
    )


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text, measured in slices of about SLICE bytes."""
    sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(texts).to_pylist()], np.int64)
    parts, at = [], 0
    filled = texts.fill_null("")
    while at < len(texts):
        upto = int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, "right"))
        to = at + max(1, upto)
        parts.append(_measure(filled.slice(at, to - at)))
        at = to
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Standardisation, and per class a mean, an inverse Cholesky factor and a constant."""

    center: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if not self.means:
            return np.full(len(x), self.constants[0])
        z = np.clip((x - self.center) / self.spread, -30, 30)
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From class -> (count, sums, sums of products)."""
    d = len(FEATURES)
    held = {k: v for k, v in sums.items() if v[0] > 0}
    if len(held) < 2:
        only = next(iter(held), None)
        return Discriminant(np.zeros(d), np.ones(d), [], [], [0.5 if only is None else float(only)])
    total = sum(n for n, _, _ in held.values())
    center = sum(s for _, s, _ in held.values()) / total
    spread = np.sqrt(np.maximum(np.diag(sum(p for _, _, p in held.values())) / total - center**2, 1e-12))
    spread = np.where(spread < 1e-5, 1.0, spread)
    means, covariances = [], []
    for k in (0, 1):
        n, s, p = held[k]
        mean = s / n
        means.append((mean - center) / spread)
        covariances.append((p / n - np.outer(mean, mean)) / np.outer(spread, spread))
    pooled = sum(held[k][0] * covariances[k] for k in (0, 1)) / total
    factors, constants = [], []
    for k in (0, 1):
        shrunk = (1 - TOWARD_POOLED) * covariances[k] + TOWARD_POOLED * pooled
        shrunk = (1 - TOWARD_SPHERE) * shrunk + TOWARD_SPHERE * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(math.log(held[k][0] / total) - float(np.log(np.diag(lower)).sum()))
    return Discriminant(center, spread, means, factors, constants)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Class sums over all training rows of (doc_id, x); two rows of numbers reach the driver."""
    d = len(FEATURES)
    told = labels.where("quality in (0, 1) and doc_id is not null").select(
        F.col("doc_id").alias("l_id"), F.col("quality").alias("label")
    )
    x = [F.col("x")[i] for i in range(d)]
    train = measured.where(fold(F.col("doc_id")) != HELD_OUT).join(told, F.col("doc_id") == F.col("l_id"))
    rows = (
        train.groupBy("label")
        .agg(
            F.count("*").alias("n"),
            *(F.sum(x[i]).alias(f"s_{i}") for i in range(d)),
            *(F.sum(x[i] * x[j]).alias(f"p_{i}_{j}") for i in range(d) for j in range(i, d)),
        )
        .collect()
    )
    sums = {}
    for r in rows:
        products = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        sums[r["label"]] = (float(r["n"]), np.array([r[f"s_{i}"] for i in range(d)]), products)
    return discriminant(sums)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(scan, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, x array<double>")


def quality_classifier(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    measured = written_once(measure(docs, key, text), "text-statistics")
    model = fit(measured, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    id_type = measured.schema["doc_id"].dataType.simpleString()
    return measured.mapInArrow(score, f"doc_id {id_type}, score double").select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
