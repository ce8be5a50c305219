"""Language of each text by sparse multinomial logistic regression on character n-grams.

1. A text is its words' letters, lower-cased, with a blank around each word; features are
   runs of one to three of these, hashed to BUCKETS. Document frequencies are counted over
   all rows to learn from. A feature's value is its share of the text's n-grams times its
   inverse document frequency.
2. The model is fitted on a bounded sample: about SAMPLE rows in all, as many of each
   language, those of lowest key hash. FTRL-proximal with its own step for each weight; the
   elastic net sets weights of little use to zero (L1) and shrinks the rest (L2).
3. A fifth of the sample is not trained on; the temperature that makes its probabilities
   likeliest divides all scores.
4. Every text, whole, is scored where it lies: its n-grams' weights are summed.

Memory: a weight for each bucket and language; of the sample, one number a distinct n-gram
of a row. A long text is read SLAB characters at a time.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text
if nothing can be learned (no row with a language and a letter). A null key reads as an
empty string in the checksum. Rows of a null language are predicted, never learned from.
Repeated rows return once each; an empty table gives an empty one; other columns, the
source among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

#: n-gram buckets, and rows of the sample in all
BUCKETS, SAMPLE = 1 << 17, 4000
#: FTRL: step and its offset, elastic net, passes
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 0.01, 4
#: values are shares times this, so that the penalties meet numbers near 1
SCALE = 100.0
#: one row of the sample in CALIBRATED sets the temperature
CALIBRATED = 5
#: rows by checksum: one in PARTS is held out
PARTS, HELD_OUT = 4, 2
#: characters read at once
SLAB = 1 << 20
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The lower-case letter of each code point, a blank for all that is not a letter."""
    if not _FOLD:
        fold = np.full(0x110000, 0x20, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                fold[c] = ord(chr(c).lower()[0])
        _FOLD.append(fold)
    return _FOLD[0]


def _hashed(*codes: np.ndarray) -> np.ndarray:
    """A bucket of each run of letters; runs of one length go by one rule."""
    out = np.full(len(codes[0]), len(codes), np.uint32)
    for c in codes:
        out = (out ^ c) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return (out * np.uint32(0x85EBCA6B)) >> np.uint32(15) & np.uint32(BUCKETS - 1)


def slabs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text) of all n-grams of the texts, about SLAB characters at a time.

    A long text comes in pieces that overlap by what an n-gram reaches beyond its middle.
    """
    part, of, taken = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text), 1), SLAB):
            before, piece = text[max(at - 2, 0) : at], text[at : at + SLAB + 2]
            part.append((before, piece, at + SLAB < len(text)))
            of.append(k)
            taken += len(piece)
            if taken >= SLAB:
                yield _grams(part, of)
                part, of, taken = [], [], 0
    if part:
        yield _grams(part, of)


def _grams(parts: list[tuple[str, str, bool]], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    # each piece counts n-grams by the place of their first letter: own from `begin` to `end`
    texts = [" " + before + piece + " " for before, piece, _ in parts]
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    codes = letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.array(of), sizes)
    owned = np.ones(len(codes), bool)
    for k, (before, piece, more) in enumerate(parts):
        if before or more:
            begin = start[k] + 1 + len(before)
            owned[start[k] : begin] = False
            owned[begin + len(piece) - 2 * more : start[k] + sizes[k]] = False
    # blanks in a row are one
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0x20) | (codes[:-1] != 0x20)
    codes, doc, owned = codes[keep], doc[keep], owned[keep]
    is_letter = codes != 0x20
    buckets, docs = [], []
    one = is_letter & owned
    buckets.append(_hashed(codes[one])), docs.append(doc[one])
    if len(codes) > 1:
        left, right = codes[:-1], codes[1:]
        # a blank before a letter goes with the letter
        first = np.where(is_letter[:-1], owned[:-1], owned[1:])
        two = (is_letter[:-1] | is_letter[1:]) & first
        buckets.append(_hashed(left[two], right[two]))
        docs.append(np.where(is_letter[:-1], doc[:-1], doc[1:])[two])
    if len(codes) > 2:
        three = is_letter[1:-1] & owned[1:-1]
        buckets.append(_hashed(codes[:-2][three], codes[1:-1][three], codes[2:][three]))
        docs.append(doc[1:-1][three])
    return np.concatenate(buckets), np.concatenate(docs)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % PARTS == HELD_OUT


def distinct_per_text(buckets: np.ndarray, docs: np.ndarray, scratch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, distinct buckets) of each text of a slab."""
    order = np.argsort(docs, kind="stable")
    buckets, docs = buckets[order], docs[order]
    at = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    for low, high in zip(at.tolist(), np.append(at[1:], len(docs)).tolist()):
        own, places = buckets[low:high], np.arange(high - low, dtype=np.int32)
        scratch[own] = places  # the last place of a bucket stays
        yield int(docs[low]), own[scratch[own] == places]


def document_frequencies(learned: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows hold each bucket, and how many rows there are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, scratch = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, np.int32)
        for batch in batches:
            rows += batch.num_rows
            seen: dict[int, set] = {}
            texts = batch.column(0).to_pylist()
            for buckets, docs in slabs(texts):
                for k, own in distinct_per_text(buckets, docs, scratch):
                    if len(texts[k]) > SLAB:  # comes in pieces
                        own = np.array(sorted({*own.tolist()} - seen.setdefault(k, set())), np.int64)
                        seen[k].update(own.tolist())
                    held[own] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(held[at], rows))], ["bucket", "n"]
        )

    # as many rows as there are buckets
    sums = learned.select("text").mapInArrow(scan, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    bucket, n = sums["bucket"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)
    held = np.zeros(BUCKETS, np.int64)
    held[bucket[bucket >= 0]] = n[bucket >= 0]
    return held, int(n[bucket < 0].sum())


def sample(learned: DataFrame, rows: int = SAMPLE) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, hash, buckets, shares) of about `rows` rows, as many of each language."""
    counts = learned.groupBy("lang").agg(F.count("*").alias("rows"))
    languages = counts.count()
    if not languages:
        return []
    each = max(rows // languages, 1)
    part = F.pmod(F.col("hash"), F.lit(1 << 30)) / (1 << 30)
    # a row a language, far fewer numbers than the model has
    chosen = learned.join(F.broadcast(counts), "lang").where(part * F.col("rows") < each).select("lang", "hash", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sums: dict[int, np.ndarray] = {k: np.zeros((2, 0)) for k in range(len(texts))}
            for buckets, docs in slabs(texts):
                for k in np.unique(docs).tolist():
                    own, times = np.unique(buckets[docs == k], return_counts=True)
                    if sums[k].shape[1]:
                        own, at = np.unique(np.append(sums[k][0], own), return_inverse=True)
                        times = np.bincount(at, np.append(sums[k][1], times))
                    sums[k] = np.stack((own, times))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([s[0].astype(np.int32) for s in sums.values()], pa.list_(pa.int32())),
                    pa.array([(s[1] / max(s[1].sum(), 1)).astype(np.float32) for s in sums.values()], pa.list_(pa.float32())),
                ],
                ["lang", "hash", "buckets", "shares"],
            )

    found = chosen.mapInArrow(scan, "lang string, hash long, buckets array<int>, shares array<float>").toArrow()
    found = found.sort_by([("hash", "ascending"), ("lang", "ascending")])
    arrays = (
        [r.values.to_numpy() for r in found.column(c).combine_chunks()] if found.num_rows else [] for c in ("buckets", "shares")
    )
    return list(zip(found.column("lang").to_pylist(), found.column("hash").to_pylist(), *arrays))


class Model(NamedTuple):
    """Weights by bucket and language, idf and scale within; `languages` in code-point order."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From each text's summed weights and number of n-grams."""
        return (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for one block of weights: sums of gradients and of their squares."""

    def __init__(self, shape: tuple[int, ...], l1: float, l2: float):
        self.z, self.n, self.l1, self.l2 = np.zeros(shape), np.zeros(shape), l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + self.l2)

    def step(self, at, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / ALPHA * weights
        self.n[at] = more


def fit_rows(rows: list[tuple[str, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model | None:
    """Train on four fifths of the rows, in the order of their hash, and calibrate on the rest."""
    if not rows:
        return None
    languages = sorted({lang for lang, *_ in rows})
    label = {lang: k for k, lang in enumerate(languages)}
    weights, bias = Ftrl((BUCKETS, len(languages)), L1, L2), Ftrl((1, len(languages)), 0.0, L2)
    calibrated = [r for r in rows if r[1] % CALIBRATED == 0]
    for _ in range(PASSES):
        for lang, hash_, at, share in rows:
            if hash_ % CALIBRATED == 0:
                continue
            x, own, base = SCALE * share * idf[at], weights.weights(at), bias.weights(slice(None))
            error = _softmax(x @ own + base[0])
            error[label[lang]] -= 1
            weights.step(at, x[:, None] * error, own)
            bias.step(slice(None), error[None, :], base)
    every = weights.weights(slice(None)) * (SCALE * idf)[:, None]
    base = bias.weights(slice(None))[0]
    raw = np.array([share @ every[at] + base for _, _, at, share in calibrated]).reshape(-1, len(languages))
    truth = np.array([label[r[0]] for r in calibrated], np.int64)
    return Model(languages, every.astype(np.float32), base, temperature(raw, truth))


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor under which the true labels are likeliest; 1 without rows. The loss has one minimum in 1/T."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-300)).sum())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE) -> Model | None:
    """The model of the rows that are not held out and have a language and a letter."""
    learned = docs.where(F.col(lang).isNotNull() & has_letter(F.col(text)) & ~held_out(F.col(key))).select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 40)).alias("hash"),
    )
    chosen = sample(learned, rows)
    if not chosen:
        return None
    held, n = document_frequencies(learned)
    idf = np.where(held > 0, np.log((1 + n) / (1 + held)) + 1, 0.0)
    return fit_rows(chosen, idf)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    own = docs.select(
        F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), has_letter(F.col(text)).alias("known"), F.col(text).cast("string").alias("text")
    )
    if model is None:
        return own.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a bucket and language
    id_type = own.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        columns = [np.ascontiguousarray(c) for c in model.weights.T]
        for batch in batches:
            rows = batch.num_rows
            sums, n = np.zeros((rows, len(columns))), np.zeros(rows)
            for buckets, of in slabs([t or "" for t in batch.column(3).to_pylist()]):
                n += np.bincount(of, minlength=rows)
                for k, weights in enumerate(columns):
                    sums[:, k] += np.bincount(of, weights[buckets], rows)
            p = _softmax(model.logits(sums, n))
            best, known = p.argmax(1), batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())], pa.string()),
                    pa.array(np.where(known, p[np.arange(rows), best], 0.0)),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return own.mapInArrow(scan, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those not held out."""
    return predict(docs, fit(docs, key, text, lang), key, text)
