"""Exact and approximate vector search for a table of queries.

Exact search is a blocked matrix product: points and queries are cut into blocks
of bounded size, each pair of blocks is one task group, and a block hands on only
its k best per query. No pair table is ever written and no side is collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from scriptorium.operators.ranking import PREFETCH, SCORE_DIGITS, top_k

BLOCK_ROWS = 32768
SMALL_BLOCK = 512
SCORES_AT_ONCE = 4_000_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    if isinstance(arrays, pa.ChunkedArray):
        arrays = pa.concat_arrays(arrays.chunks)
    width = len(arrays[0])
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrays), width)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def blocks_for(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(rows / block_rows))


def grid(rows: int, queries: int, cores: int, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """(blocks of points, blocks of queries).

    Several pairs of blocks per core even out their sizes. A query is sent, and k rows come back, once a
    block of points, so there are no more of these than memory and the cores ask for.
    """
    of_queries = blocks_for(queries, block_rows)
    return max(blocks_for(rows, block_rows), min(math.ceil(4 * cores / of_queries), blocks_for(rows, SMALL_BLOCK))), of_queries


def _block_best(k: int, exclude_self: bool):
    """Scores one block of points against one block of queries: k best per query."""

    def best(block: pa.Table, asked: pa.Table) -> pa.Table:
        arrow = pa.schema(
            [
                ("query_key", asked.schema.field("query_key").type),
                ("point_key", block.schema.field("point_key").type),
                ("score", pa.float64()),
            ]
        )
        if block.num_rows == 0 or asked.num_rows == 0:
            return arrow.empty_table()
        block = block.sort_by("point_key")
        keys = block.column("point_key").to_numpy()
        names = asked.column("query_key").to_numpy()
        points = _unit(_matrix(block.column("point_vec")))
        queries = _unit(_matrix(asked.column("query_vec")))
        out_q, out_p, out_s = [], [], []
        step = max(1, SCORES_AT_ONCE // len(keys))
        for start in range(0, len(names), step):
            scores = np.round(queries[start : start + step] @ points.T, SCORE_DIGITS)
            for at, (row, name) in enumerate(zip(scores, names[start : start + step]), start):
                if exclude_self:
                    row = np.where(keys == name, -np.inf, row)
                kept = min(k, len(row))
                cut = np.partition(row, len(row) - kept)[len(row) - kept]
                near = np.flatnonzero(row >= cut)
                near = near[np.argsort(-row[near], kind="stable")][:kept]
                near = near[np.isfinite(row[near])]
                out_q.append(np.full(len(near), at))
                out_p.append(near)
                out_s.append(row[near] + 0.0)
        found_q, found_p, found_s = (np.concatenate(out) for out in (out_q, out_p, out_s))
        columns = [asked.column("query_key").take(pa.array(found_q)), block.column("point_key").take(pa.array(found_p)), pa.array(found_s)]
        return pa.table(columns, schema=arrow)

    return best


def _best_per_block(
    left: DataFrame, right: DataFrame, on: list[str], query: str, key: str, k: int, exclude_self: bool
) -> DataFrame:
    """The block kernel over every pair of blocks that share `on`: (query, key, score)."""
    schema = T.StructType(
        [
            T.StructField("query_key", right.schema["query_key"].dataType),
            T.StructField("point_key", left.schema["point_key"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return (
        left.groupBy(*on)
        .cogroup(right.groupBy(*on))
        .applyInArrow(_block_best(k, exclude_self), schema)
        .select(F.col("query_key").alias(query), F.col("point_key").alias(key), "score")
    )


def exact_search(
    points: DataFrame,
    queries: DataFrame,
    query: str,
    key: str = "row_key",
    vector: str = "embedding",
    k: int = PREFETCH,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k points per query by cosine: (query, key, score, rn).

    `queries` has (query, vector), `points` (key, vector). Both are counted to size
    the blocks, so a block's memory does not depend on how large the tables are.
    Filters belong on `points` before the call: they bound what may rank.
    """
    rows = points.count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    n_points, n_queries = grid(rows, queries.count(), cores, block_rows)
    left = points.select(
        F.col(key).alias("point_key"),
        F.col(vector).alias("point_vec"),
        F.pmod(F.xxhash64(key), F.lit(n_points)).alias("pb"),
        F.explode(F.expr(f"sequence(0L, {n_queries - 1}L)")).alias("qb"),
    )
    right = queries.select(
        F.col(query).alias("query_key"),
        F.col(vector).alias("query_vec"),
        F.explode(F.expr(f"sequence(0L, {n_points - 1}L)")).alias("pb"),
        F.pmod(F.xxhash64(query), F.lit(n_queries)).alias("qb"),
    )
    found = _best_per_block(left, right, ["pb", "qb"], query, key, k, exclude_self)
    return top_k(found, [query], k, key=key)


def hyperplane_codes(
    points: DataFrame, vector: str, width: int, tables: int, bits: int, seed: int = 7
) -> DataFrame:
    """Sign codes of random hyperplanes, one per table, for candidate buckets."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, width))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def codes(vectors):
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype=object)
        signs = (np.stack(vectors.to_numpy()).astype(np.float64) @ planes.T) >= 0
        powers = 1 << np.arange(bits, dtype=np.int64)
        packed = signs.reshape(len(signs), tables, bits) @ powers
        return pd.Series(list(packed))

    return points.withColumn("codes", codes(F.col(vector)))


def approximate_search(
    points: DataFrame,
    queries: DataFrame,
    query: str,
    key: str = "row_key",
    vector: str = "embedding",
    width: int = 64,
    k: int = PREFETCH,
    tables: int = 24,
    bits: int = 3,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k among points that share a hyperplane bucket with the query.

    Recall depends on `tables` and `bits` alone, not on the number of rows: more bits are
    less work and lower recall, more tables the reverse; measure with `recall_at_k`. A bucket is
    scored in blocks that hand on k points per query, so no pairs are written; one
    that is hot, its vectors being alike, is cut into more blocks, never left out.
    """

    def coded(rows: DataFrame, name: str, key_as: str, vec_as: str) -> DataFrame:
        codes = hyperplane_codes(rows.select(name, vector), vector, width, tables, bits)
        return codes.select(
            F.col(name).alias(key_as), F.col(vector).alias(vec_as), F.posexplode("codes").alias("table", "code")
        )

    left = coded(points, key, "point_key", "point_vec")
    right = coded(queries, query, "query_key", "query_vec")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("table", "code").agg(F.ceil(F.count("*") / block_rows).alias(name))

    # One row per bucket both sides hold: at most tables x 2^bits of them.
    sizes = blocks(left, "n_pb").join(blocks(right, "n_qb"), ["table", "code"])
    left = left.join(sizes, ["table", "code"]).select(
        "table", "code", "point_key", "point_vec",
        F.pmod(F.xxhash64("point_key"), F.col("n_pb")).alias("pb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_qb") - 1)).alias("qb"),
    )
    right = right.join(sizes, ["table", "code"]).select(
        "table", "code", "query_key", "query_vec",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pb") - 1)).alias("pb"),
        F.pmod(F.xxhash64("query_key"), F.col("n_qb")).alias("qb"),
    )
    found = _best_per_block(
        left, right, ["table", "code", "pb", "qb"], query, key, k, exclude_self
    ).distinct()
    return top_k(found, [query], k, key=key)


def recall_at_k(found: DataFrame, exact: DataFrame, query: str, key: str = "row_key") -> DataFrame:
    """Per query, the share of the exact list the approximate one holds."""
    hit = found.select(query, key).withColumn("hit", F.lit(1))
    return (
        exact.join(hit, [query, key], "left")
        .groupBy(query)
        .agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))
    )
