"""Lexical search: an inverted index as tables, and BM25 over a table of queries.

Two ways to search, both block by block: `search_index` takes the postings of the words
asked for from a stored index, `search_texts` makes them from unindexed text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

from scriptorium.functions.tokens import WORD_PATTERN, words
from scriptorium.operators.ranking import PREFETCH, SCORE_DIGITS, top_k
from scriptorium.session import written_once

# The BM25 parameters.
K1 = 1.2
B = 0.75

# Rows and queries of one scoring block: a task holds the postings of one block of rows, and of
# queries a batch at a time.
BLOCK_ROWS = 32768
BLOCK_QUERIES = 4096
SMALL_BLOCK = 512
# Words of the texts of one block at most: what its postings take does not depend on how long texts are.
BLOCK_WORDS = 4_000_000
# Words of texts that one task counts.
COUNTED_WORDS = 1_000_000


@dataclass(frozen=True)
class Bm25Index:
    """postings (term, row_key, tf, doc_len), terms (term, df, idf), stats (n, avg_len)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def corpus_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: how many texts there are and how long they are on average."""
    length = F.regexp_count(F.col(text), F.lit(WORD_PATTERN))
    return texts.agg(F.count("*").alias("n"), F.avg(length).alias("avg_len"))


def exploded_terms(texts: DataFrame, key: str = "row_key", text: str = "text") -> DataFrame:
    """One row per word of each text, with the text's length in words.

    The outer form of explode: the plain one adds a filter that would run the word
    pattern over every text a second time.
    """
    return (
        texts.select(key, words(F.col(text)).alias("found"))
        .select(key, F.size("found").alias("doc_len"), F.explode_outer("found").alias("term"))
        .where("term is not null")
    )


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(idf_: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def term_weights(postings: DataFrame, n: Column) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.col("df"), n))


def build_index(texts: DataFrame, key: str = "row_key", text: str = "text") -> Bm25Index:
    stats = corpus_stats(texts, text)
    # texts are dealt by their key, their words then counted where they are: a word is no row of a shuffle
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = (
        exploded_terms(texts.select(key, text).repartition(parts, key), key, text)
        .groupBy("term", key, "doc_len")
        .agg(F.count("*").alias("tf"))
    )
    return Bm25Index(postings, term_weights(postings, stats.select("n").scalar()), stats)


def write_index(index: Bm25Index, path: str, partitions: int | None = None) -> None:
    """The index at rest: postings clustered by term so a search reads few row groups.

    Clustering is by range over (term, row key), so a term most texts hold is spread
    over many files instead of filling one task.
    """
    spread = (
        index.postings.repartitionByRange(partitions, "term", "row_key")
        if partitions
        else index.postings.repartitionByRange("term", "row_key")
    )
    spread.sortWithinPartitions("term", "row_key").write.mode("errorifexists").parquet(
        f"{path}/postings"
    )
    index.terms.write.mode("errorifexists").parquet(f"{path}/terms")
    index.stats.write.mode("errorifexists").parquet(f"{path}/stats")


def read_index(spark, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "stats")))


def query_terms(queries: DataFrame, query: str = "question_id", text: str = "question") -> DataFrame:
    return queries.select(query, F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def grid(rows: int, queries: int, cores: int, block_rows: int, block_queries: int) -> tuple[int, int]:
    """(blocks of rows, blocks of queries): rows as memory asks, both as the cores ask.

    Each row is sent once a block of queries and each query once a block of rows. Queries are
    streamed through a task, so their blocks only keep the cores busy where the rows make too few.
    """
    of_rows = max(1, -(-rows // block_rows))
    of_queries = max(1, min(-(-queries // block_queries), -(-4 * cores // of_rows)))
    # Several blocks per core even out their sizes; more rows mean more blocks.
    return max(of_rows, min(-(-4 * cores // of_queries), -(-rows // SMALL_BLOCK))), of_queries


def text_grid(rows: int, avg_len: float, queries: int, cores: int, block_rows: int, block_queries: int) -> tuple[int, int]:
    """(blocks of rows, blocks of queries) where a row sends a posting a word, and a query the few it asks for.

    Rows are cut for the cores before queries are: another block of queries sends all postings again.
    """
    of_words = -(-int(rows * avg_len) // BLOCK_WORDS)
    for_cores = min(2 * cores, -(-rows // SMALL_BLOCK))
    of_rows = max(1, -(-rows // block_rows), of_words, for_cores)
    return of_rows, max(1, min(-(-queries // block_queries), -(-2 * cores // of_rows)))


def search_index(
    index: Bm25Index,
    queries: DataFrame,
    query: str = "question_id",
    text: str = "question",
    key: str = "row_key",
    k: int | None = PREFETCH,
    visible: DataFrame | None = None,
) -> DataFrame:
    """Top-k rows per query from a stored index; `visible` holds the keys a filter lets through."""
    wanted = query_terms(queries, query, text)
    asked_terms = wanted.select("term").distinct()
    postings = index.postings.join(asked_terms, "term", "left_semi")
    if visible is not None:
        postings = postings.join(visible.select(key), key, "left_semi")
    terms = index.terms.join(asked_terms, "term", "left_semi")
    corpus = index.stats.first()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = text_grid(corpus["n"], corpus["avg_len"] or 1.0, queries.count(), cores, BLOCK_ROWS, BLOCK_QUERIES)
    factor = weight(F.lit(1.0), F.col("tf"), F.col("doc_len"), F.lit(corpus["avg_len"] or 1.0))
    priced = postings.select(block_of(key, blocks[0]).alias("pb"), F.col(key).alias("row_key"), "term", factor.alias("factor"))
    asked = wanted.join(terms.select("term", "idf"), "term").select(F.col(query).alias("query_key"), "term", "idf")
    return top_k(score_blocks(priced, asked, blocks, query, key, k), [query], k, key=key)


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


class _Held:
    """Postings of a block as they come: 16 bytes each, beside the words and keys a batch names."""

    def __init__(self):
        self.keys, self.terms, self.factors, self.valid = [], [], [], []

    def add(self, part: pa.RecordBatch) -> None:
        self.keys.append(part.column("row_key").dictionary_encode())
        self.terms.append(part.column("term").dictionary_encode())
        factor = part.column("factor")
        # copies: a slice would keep its whole batch
        self.factors.append(np.array(factor.fill_null(0.0).to_numpy(zero_copy_only=False)))
        self.valid.append(factor.is_valid().to_numpy(zero_copy_only=False))


def _one(batches: list[pa.DictionaryArray]) -> tuple[np.ndarray, pa.Array]:
    """(code, value of each code) of encoded batches; a null is the last code."""
    whole = pa.chunked_array(batches).unify_dictionaries()
    values = whole.chunk(0).dictionary
    nulls = whole.null_count
    codes = np.concatenate([c.indices.fill_null(len(values)).to_numpy(zero_copy_only=False) for c in whole.chunks])
    return codes, pa.concat_arrays([values, pa.nulls(1, values.type)]) if nulls else values


class _Block:
    """The postings of one block of rows, laid out by term: a query adds one slice per word it asks for."""

    def __init__(self, held: _Held, marked: bool):
        codes, self.terms = _one(held.terms)
        row, keys = _one(held.keys)
        factor, valid = np.concatenate(held.factors), np.concatenate(held.valid)
        held.__init__()
        order = pa.compute.sort_indices(keys).to_numpy()
        self.keys = keys.take(pa.array(order))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        row = place[row]
        self.marks = self._by_term(codes[~valid], row[~valid])[1:] if marked else None
        if not valid.all():
            codes, row, factor = codes[valid], row[valid], factor[valid]
        by_term, self.rows, self.start = self._by_term(codes, row)
        self.factor = factor[by_term]
        # a key may stand for several rows that hold a word
        pairs = codes.astype(np.int64) * len(order) + row
        pairs.sort()
        self.repeats = bool((pairs[1:] == pairs[:-1]).any())

    def _by_term(self, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, rows, start): the rows under each term."""
        order = np.argsort(codes, kind="stable")
        return order, row[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.terms)))])

    def best(self, asked: pa.RecordBatch, k: int | None, exclude_self: bool) -> pa.RecordBatch:
        """The k best rows of each query; rows of `asked` come query by query."""
        held = pa.compute.index_in(asked.column("term"), self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        price = asked.column("idf").to_numpy()
        due = asked.column("due").to_numpy(zero_copy_only=False)
        names = asked.column("query_key").dictionary_encode("encode")
        own = pa.compute.index_in(names.dictionary, self.keys).fill_null(-1).to_pylist() if exclude_self else None
        codes = names.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        order = order[held[order] >= 0]
        first = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
        out_q, out_k, out_s = [], [], []
        for i in range(len(names.dictionary)):
            if first[i] == first[i + 1]:
                continue
            scores = np.zeros(len(self.keys))
            for at in order[first[i] : first[i + 1]]:
                span = slice(self.start[held[at]], self.start[held[at] + 1])
                if self.repeats:
                    np.add.at(scores, self.rows[span], price[at] * self.factor[span])
                else:
                    scores[self.rows[span]] += price[at] * self.factor[span]
            scores = np.round(scores, SCORE_DIGITS)
            if self.marks is not None:
                met = np.zeros(len(scores), bool)
                for at in order[first[i] : first[i + 1]]:
                    if due[at]:
                        met[self.marks[0][self.marks[1][held[at]] : self.marks[1][held[at] + 1]]] = True
                scores[~met] = 0.0
            if exclude_self and own[i] >= 0:
                scores[own[i]] = 0.0
            hit = np.flatnonzero(scores > 0)
            if k is not None and len(hit) > k:
                cut = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
                hit = hit[scores[hit] >= cut]
            hit = hit[np.argsort(-scores[hit], kind="stable")][:k]
            out_q.append(np.full(len(hit), i))
            out_k.append(hit)
            out_s.append(scores[hit])
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                names.dictionary.take(pa.array(np.concatenate(out_q or empty))),
                self.keys.take(pa.array(np.concatenate(out_k or empty))),
                pa.array(np.concatenate(out_s or [np.zeros(0)])),
            ],
            ["query_key", "row_key", "score"],
        )


def score_blocks(
    postings: DataFrame, asked: DataFrame, blocks: tuple[int, int], query: str, key: str, k: int | None,
    exclude_self: bool = False, marks: DataFrame | None = None,
) -> DataFrame:
    """(query, key, score): the k best rows of each block for each query.

    `postings` has (pb, row_key, term, factor), `asked` (query_key, term, idf). A block's postings come
    first in its partition and are held; its queries follow and are scored as they come.

    With `marks` (pb, row_key, term) a row ranks for a query only where it is marked under a term
    that the query has with `due` (a further column of `asked`); it is scored over all terms.
    """
    if marks is not None:
        postings = postings.unionByName(marks.withColumn("factor", F.lit(None).cast("double")))
    else:
        asked = asked.withColumn("due", F.lit(True))
    marked = marks is not None
    of_rows, of_queries = blocks
    qb = F.pmod(F.xxhash64("query_key"), F.lit(of_queries))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    kind = {c: d.schema[c].dataType for d, c in ((asked, "query_key"), (postings, "row_key"))}
    left = postings.select(
        "pb", every(of_queries).alias("qb"), F.lit(None).cast(kind["query_key"]).alias("query_key"), "row_key", "term",
        "factor", F.lit(None).cast("double").alias("idf"), F.lit(False).alias("due"),
    )
    right = asked.select(
        every(of_rows).alias("pb"), qb.alias("qb"), "query_key", F.lit(None).cast(kind["row_key"]).alias("row_key"), "term",
        F.lit(None).cast("double").alias("factor"), "idf", "due",
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, rest = None, _Held(), None, None

        def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """A batch cut where another block begins, and postings from queries."""
            place = np.stack([batch.column(i).to_numpy() for i in (0, 1)] + [batch.column("idf").is_valid().to_numpy(zero_copy_only=False)])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if high > low:
                    yield batch.slice(low, high - low)

        for part in (p for b in batches for p in rows(b)):
            if (part.column(0)[0].as_py(), part.column(1)[0].as_py()) != at:
                if block is not None and rest is not None:
                    yield block.best(rest, k, exclude_self)
                at, held, block, rest = (part.column(0)[0].as_py(), part.column(1)[0].as_py()), _Held(), None, None
            if not part.column("idf")[0].is_valid:
                held.add(part)
                continue
            if block is None and not held.keys:
                continue
            if block is None:
                block = _Block(held, marked)
            if rest is not None:
                part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
            # the last query's words may go on in the next batch
            names = part.column("query_key").dictionary_encode("encode").indices.to_numpy()
            last = int(np.flatnonzero(names != names[-1])[-1]) + 1 if (names != names[-1]).any() else 0
            if last:
                yield block.best(part.slice(0, last), k, exclude_self)
            rest = part.slice(last)
        if block is not None and rest is not None:
            yield block.best(rest, k, exclude_self)

    schema = T.StructType(
        [
            T.StructField("query_key", kind["query_key"]),
            T.StructField("row_key", kind["row_key"]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    # a partition a block, so that its size does not depend on how many blocks there are
    dealt = left.unionByName(right).repartition(of_rows * of_queries, "pb", "qb")
    dealt = dealt.sortWithinPartitions("pb", "qb", F.col("idf").isNotNull(), "query_key")
    return dealt.mapInArrow(scan, schema).select(F.col("query_key").alias(query), F.col("row_key").alias(key), "score")


def search_texts(
    texts: DataFrame,
    queries: DataFrame,
    query: str = "question_id",
    text: str = "question",
    key: str = "row_key",
    body: str = "text",
    k: int = PREFETCH,
    condition: Column | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Top-k rows per query straight from a table of texts.

    Only words some query asks for leave the scan; counted, they are dealt to blocks of rows.
    A block scores the queries as they come and hands on k rows per query, so the
    pairs a common word makes are never written. Blocks are sized from row counts.
    Frequencies are the whole corpus's; `condition` decides which rows may rank,
    never what a word weighs.
    """
    corpus = corpus_stats(texts, body).first()
    n, avg_len = corpus["n"], corpus["avg_len"] or 1.0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    blocks = text_grid(n, avg_len, queries.count(), cores, block_rows, block_queries)
    wanted = query_terms(queries, query, text)
    counted = max(cores, -(-int(n * avg_len) // COUNTED_WORDS))
    flagged = texts.withColumn("visible", F.lit(True) if condition is None else condition)
    matches = (
        flagged.select(key, "visible", words(F.col(body)).alias("found"))
        .select(key, "visible", F.size("found").alias("doc_len"), F.explode_outer("found").alias("term"))
        .join(wanted.select("term").distinct(), "term", "left_semi")
        # dealt before they are counted: a split of a file may hold any number of words
        .repartition(counted, key)
        .groupBy(block_of(key, blocks[0]).alias("pb"), key, "doc_len", "term")
        .agg(F.count("*").alias("tf"), F.bool_and("visible").alias("visible"))
    )
    # Their counts and their blocks both read them.
    matches = written_once(matches, "matches")
    terms = (
        matches.groupBy("term")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", idf(F.col("df"), F.lit(n)))
    )
    factor = weight(F.lit(1.0), F.col("tf"), F.col("doc_len"), F.lit(avg_len))
    postings = matches.where("visible").select("pb", F.col(key).alias("row_key"), "term", factor.alias("factor"))
    asked = wanted.join(terms.select("term", "idf"), "term").select(F.col(query).alias("query_key"), "term", "idf")
    return top_k(score_blocks(postings, asked, blocks, query, key, k, exclude_self), [query], k, key=key)
