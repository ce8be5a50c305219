"""An inverted-file index of vectors: coarse lists, residual product codes, exact rerank.

Building: centroids and codebooks are trained on a bounded sample; every vector is given
to its nearest centroid, and what is left of it is cut into parts, each named by the
nearest of a few codewords. The codes, one byte a part, are stored ranged by list, so a
search reads runs of files; the vectors stay where they are.

Searching: a query probes the lists whose centroids are nearest, ranks their points by
their codes, and hands on the best; only those are scored exactly, from the stored
vectors, and ordered. Lists are dealt to tasks by their sizes: small lists share one, a large
one is cut into several. So no task gets more than BLOCK_ROWS codes at once and QUERY_ROWS
queries, however uneven lists are, and no pair is written that is not among a block's best.

Scores are cosines. Rows without a vector are not in the index; a vector of zeros scores 0.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions.vectors import cosine
from scriptorium.operators.ranking import PREFETCH, SCORE_DIGITS, top_k
from scriptorium.session import written_once

#: rows the quantiser is trained on at most, those of lowest key hash
SAMPLE_ROWS = 20_000
#: lists at most: the sample must show every centroid a few rows
ROWS_A_LIST = 8
PARTS, WORDS, ROUNDS = 16, 256, 10
BLOCK_ROWS, SMALL_BLOCK, QUERY_ROWS = 65_536, 512, 4_096
#: share of the lists a query probes; points scored exactly, times k, and their share at most
PROBED, REFINE, SCORED = 0.9, 5, 0.2
#: distances or scores made at a time, and bytes of vectors sent on in one batch
SCORES_AT_ONCE, SENT_AT_ONCE = 4_000_000, 4 << 20


class Quantizer(NamedTuple):
    """Centroids (lists, width), codebooks (parts, words, width of a part)."""

    centroids: np.ndarray
    books: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, books=self.books)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Quantizer:
        held = np.load(io.BytesIO(data))
        return Quantizer(held["centroids"], held["books"])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors; ties go to the lower number."""
        lists = nearest(vectors, self.centroids)
        rest = _parts(vectors - self.centroids[lists], len(self.books))
        codes = [nearest(rest[:, m], book) for m, book in enumerate(self.books)]
        return lists, np.stack(codes, 1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        words = self.books[np.arange(len(self.books)), codes]
        return self.centroids[lists] + words.reshape(len(codes), -1)[:, : self.centroids.shape[1]]

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """(queries, lists): which lists each vector probes."""
        near = vectors @ self.centroids.T
        out = np.zeros(near.shape, bool)
        order = np.argsort(-near, axis=1, kind="stable")[:, :count]
        out[np.arange(len(out))[:, None], order] = True
        return out


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row by Euclidean distance."""
    half = 0.5 * np.einsum("ij,ij->i", centers, centers)
    out = np.empty(len(x), np.int64)
    step = max(1, SCORES_AT_ONCE // len(centers))
    for at in range(0, len(x), step):
        scores = x[at : at + step] @ centers.T
        scores -= half
        out[at : at + step] = np.argmax(scores, axis=1)
    return out


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width of a part); the last part is filled up with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def _unit(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), width)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made


def kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample; an empty center keeps its place."""
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, x[:, d], len(centers)) for d in range(x.shape[1])], 1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers).astype(np.float32)
    return centers


def lists_for(rows: int, sampled: int) -> int:
    """About the root of the rows, and no more than the sample can train."""
    return max(1, min(round(rows**0.5), sampled // ROWS_A_LIST))


def train(points: DataFrame, key: str, vector: str, sample_rows: int = SAMPLE_ROWS, lists: int | None = None) -> Quantizer:
    """Centroids of the sample, and codebooks of what they leave of it."""
    rows = points.count()
    order = [F.xxhash64(key), F.col(key)]
    chosen = points.select(key, vector).orderBy(*order).limit(sample_rows).select(vector).toArrow()
    if not chosen.num_rows:
        return Quantizer(np.zeros((1, 1), np.float32), np.zeros((1, 1, 1), np.float32))
    x = _unit(_chunk(chosen.column(0)))
    centroids = kmeans(x, lists or lists_for(rows, len(x)))
    rest = _parts(x - centroids[nearest(x, centroids)], min(PARTS, x.shape[1]))
    words = min(WORDS, len(x))
    books = np.stack([kmeans(np.ascontiguousarray(rest[:, m]), words, m) for m in range(rest.shape[1])])
    return Quantizer(centroids, books)


class VectorIndex(NamedTuple):
    """A stored index: its folder and its quantiser."""

    path: str
    quantizer: Quantizer

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")


def build(points: DataFrame, path: str, key: str = "row_key", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, lists: int | None = None) -> VectorIndex:
    """Write (list, key, codes) of every row with a vector, ranged by list, and the quantiser beside it."""
    spark = points.sparkSession
    points = points.where(F.col(vector).isNotNull())
    quantizer = train(points, key, vector, sample_rows, lists)
    shared = spark.sparkContext.broadcast(quantizer)  # SAMPLE_ROWS / ROWS_A_LIST centroids at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists, codes = shared.value.encode(_unit(batch.column(1)))
                packed = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists), batch.column(0), packed.cast(pa.binary())], ["list", "point_key", "codes"]
                )

    own = points.select(F.col(key).alias("point_key"), F.col(vector).alias("vector"))
    id_type = own.schema["point_key"].dataType.simpleString()
    coded = own.mapInArrow(encode, f"list long, point_key {id_type}, codes binary")
    # ranged by both: a list that holds a third of all points takes many files
    coded.repartitionByRange("list", "point_key").sortWithinPartitions("list", "point_key").write.parquet(f"{path}/codes")
    spark.createDataFrame([(bytearray(quantizer.to_bytes()),)], "quantizer binary").write.parquet(f"{path}/quantizer")
    return VectorIndex(path, quantizer)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(path, Quantizer.from_bytes(bytes(spark.read.parquet(f"{path}/quantizer").first()[0])))


def spread_queries(
    quantizer: Quantizer, batch: pa.RecordBatch, touches: np.ndarray, wanted: int, sent: int = SENT_AT_ONCE
) -> Iterator[pa.RecordBatch]:
    """(block, query_key, query_vec): each query (query_key, query_vec) once a block that it probes.

    A query goes to nearly all blocks, so queries are taken a few at a time.
    """
    bytes_a_query = touches.shape[1] * (batch.nbytes // batch.num_rows + 8) + 24 * len(touches)
    step = max(1, sent // bytes_a_query)
    for at in range(0, batch.num_rows, step):
        few = batch.slice(at, step)
        met = quantizer.probes(_unit(few.column(1)), wanted).astype(np.float32) @ touches > 0
        row, block = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(block), *few.take(pa.array(row)).columns], ["block", "query_key", "query_vec"])


def list_blocks(sizes: dict[int, int], lists: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(first, count): the blocks each list is dealt to; small neighbours share one."""
    first, count = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    block, held = 0, 0
    for k in range(lists):
        rows = sizes.get(k, 0)
        if held and held + rows > block_rows:
            block, held = block + 1, 0
        first[k], count[k] = block, max(1, -(-rows // block_rows))
        block, held = (block, held + rows) if count[k] == 1 else (block + int(count[k]), 0)
    return first, count


def search(
    index: VectorIndex,
    points: DataFrame,
    queries: DataFrame,
    query: str,
    key: str = "row_key",
    vector: str = "embedding",
    k: int = PREFETCH,
    probed: float = PROBED,
    refine: int = REFINE,
    most: float = SCORED,
    exclude_self: bool = False,
    block_rows: int | None = None,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Top-k points per query: (query, key, score, rn, scored, scanned).

    `points` (key, vector) is the table the index was built of; only its candidates are
    read by key. At most `refine` times k points, and `most` of all unless k is more, are
    scored exactly. `scored` is how many points were scored exactly for the query, `scanned`
    how many were ranked by their codes.
    """
    spark, lists = points.sparkSession, len(index.quantizer.centroids)
    codes = index.codes(spark)
    counted = codes.groupBy("list").count().collect()  # a row a list
    if block_rows is None:
        # several blocks a core even out their sizes; more rows mean more blocks
        cores = spark.sparkContext.defaultParallelism
        block_rows = min(BLOCK_ROWS, max(SMALL_BLOCK, sum(r["count"] for r in counted) // (4 * cores)))
    first, count = list_blocks({r["list"]: r["count"] for r in counted}, lists, block_rows)
    dealt = spark.createDataFrame(
        [(k, int(first[k]), int(count[k])) for k in range(lists)], "list long, first long, count long"
    )
    left = codes.join(F.broadcast(dealt), "list").select(  # a row a list
        (F.col("first") + F.pmod(F.xxhash64("point_key"), F.col("count"))).alias("block"), "list", "point_key", "codes"
    )
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("query_key"), F.col(vector).alias("query_vec"))
    if not counted:
        asked = asked.limit(0)  # nothing was trained
    shared = spark.sparkContext.broadcast((index.quantizer, first, count))
    wanted = max(1, min(lists, round(probed * lists)))
    refined = max(k, min(refine * k, int(most * sum(r["count"] for r in counted))))
    kept = refined + exclude_self
    query_type, key_type = (f.dataType.simpleString() for f in (asked.schema["query_key"], left.schema["point_key"]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer, first, count = shared.value
        touches = np.zeros((len(first), int((first + count).max())), np.float32)
        for x, (low, n) in enumerate(zip(first.tolist(), count.tolist())):
            touches[x, low : low + n] = 1
        for batch in batches:
            if batch.num_rows:
                yield from spread_queries(quantizer, batch, touches, wanted)

    kind = asked.schema["query_vec"].dataType.simpleString()
    right = asked.mapInArrow(spread, f"block long, query_key {query_type}, query_vec {kind}")
    parts = max(1, -(-asked.count() // query_rows))
    right = right.withColumn("part", F.pmod(F.xxhash64("query_key"), F.lit(parts)))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema(
            [("query_key", asked.schema.field("query_key").type), ("point_key", block.schema.field("point_key").type),
             ("rank_score", pa.float64()), ("scanned", pa.int64())]
        )
        if not block.num_rows or not asked.num_rows:
            return schema.empty_table()
        quantizer = shared.value[0]
        block = block.sort_by("point_key")
        raw = _chunk(block.column("codes")).cast(pa.binary(len(quantizer.books)))
        own = np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * len(quantizer.books) :][: len(raw) * len(quantizer.books)]
        list_ = block.column("list").to_numpy()
        stand_in = quantizer.decode(list_, own.reshape(len(raw), -1))
        vectors = _unit(_chunk(asked.column("query_vec")))
        out_q, out_p, out_s, out_n = [], [], [], []
        step = max(1, min(256, SCORES_AT_ONCE // len(list_)))
        for at in range(0, len(vectors), step):
            scores = vectors[at : at + step] @ stand_in.T
            scores[~quantizer.probes(vectors[at : at + step], wanted)[:, list_]] = -np.inf
            for i, row in enumerate(scores):
                scanned = int(np.isfinite(row).sum())
                n = min(kept, scanned)
                near = np.argpartition(-row, n - 1)[:n] if n else np.zeros(0, np.int64)
                out_q.append(np.full(n, at + i))
                out_p.append(near)
                out_s.append(row[near])
                out_n.append(np.where(np.arange(n) == 0, scanned, 0))
        q, p = np.concatenate(out_q), np.concatenate(out_p)
        return pa.table(
            [asked.column("query_key").take(pa.array(q)), block.column("point_key").take(pa.array(p)),
             pa.array(np.concatenate(out_s).astype(np.float64)), pa.array(np.concatenate(out_n))],
            schema=schema,
        )

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    found = found.applyInArrow(best, f"query_key {query_type}, point_key {key_type}, rank_score double, scanned long")
    found = written_once(found, "index-candidates")  # at most `kept` rows a query and block
    scanned = found.groupBy("query_key").agg(F.sum("scanned").alias("scanned"))
    if exclude_self:
        found = found.where("query_key <> point_key")
    ranked = top_k(found.drop("scanned"), ["query_key"], refined, score="rank_score", key="point_key")
    ranked = written_once(ranked.select("query_key", "point_key"), "index-ranked")
    counts = ranked.groupBy("query_key").agg(F.count("*").alias("scored")).join(scanned, "query_key")
    vectors = points.select(F.col(key).alias("point_key"), F.col(vector).alias("point_vec"))
    exact = ranked.join(vectors, "point_key").join(asked.join(counts, "query_key"), "query_key")
    told = exact.select(
        F.col("query_key").alias(query),
        F.col("point_key").alias(key),
        F.round(cosine(F.col("query_vec"), F.col("point_vec")), SCORE_DIGITS).alias("score"),
        "scored",
        "scanned",
    )
    return top_k(told, [query], k, key=key)
