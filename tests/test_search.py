"""Ranking rules: ties, cuts, blocks, scopes, fusion, interleaving."""

from __future__ import annotations

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import bm25, ranking, retrieval
from scriptorium.operators.filters import in_editions, payload_filter
from scriptorium.operators.vector_search import approximate_search, exact_search, grid as vector_grid, recall_at_k

SCORED = "question_id string, row_key string, score double"


def keys(rows):
    return [r.row_key for r in sorted(rows, key=lambda r: r.rn)]


def test_a_tie_at_the_cut_goes_to_the_lower_key_in_any_order(spark):
    rows = [("q", "c", 0.5), ("q", "a", 0.5), ("q", "b", 0.9), ("q", "d", 0.5)]
    for order in permutations(rows):
        found = ranking.top_k(spark.createDataFrame(list(order), SCORED), ["question_id"], 2)
        assert keys(found.collect()) == ["b", "a"]


def test_mirrored_ranks_tie_and_resolve_by_key(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "question_id string, row_key string, rn long")
    two = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "question_id string, row_key string, rn long")
    for branches in ([one, two], [two, one]):
        found = ranking.rrf_fuse(branches, "question_id").collect()
        assert keys(found) == ["a", "b"]
        assert {r.score for r in found} == {round(1 / 2 + 1 / 3, 9)}


def test_round_robin_interleaves_and_fills(spark):
    schema = "question_id string, row_key string, rn long"
    long = spark.createDataFrame([("q", f"l{i}", i) for i in (1, 2, 3, 4)], schema)
    short = spark.createDataFrame([("q", "s1", 1)], schema)
    assert keys(ranking.round_robin([long, short], "question_id").collect()) == ["l1", "s1", "l2", "l3", "l4"]
    assert keys(ranking.round_robin([long, short], "question_id", 3).collect()) == ["l1", "s1", "l2"]


def test_the_best_hit_stays_below_the_cut_off(spark):
    rows = [("q", "a", 0.3, 1), ("q", "b", 0.2, 2), ("r", "a", 0.9, 1), ("r", "b", 0.6, 2), ("r", "c", 0.4, 3)]
    ranked = spark.createDataFrame(rows, SCORED + ", rn long")
    found = ranking.keep_first_above(ranked, "question_id", 0.5, 5).collect()
    assert sorted((r.question_id, r.row_key) for r in found) == [("q", "a"), ("r", "a"), ("r", "b")]


def test_quotas_are_independent(spark):
    rows = [("q", f"p{i}", float(-i), False) for i in range(5)] + [("q", f"d{i}", float(-9 - i), True) for i in range(3)]
    scored = spark.createDataFrame(rows, SCORED + ", is_pdf boolean")
    found = ranking.quota_cut(scored, "question_id", "is_pdf", {False: 2, True: 1}).collect()
    assert keys(found) == ["p0", "p1", "d0"]


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_exact_search_equals_numpy_across_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8))
    vectors[17] = vectors[3]
    vectors[20] = 0.0
    points = spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(vectors)], "row_key string, embedding array<double>")
    asked = points.select(F.col("row_key").alias("query_id"), "embedding")
    found = exact_search(points, asked, "query_id", k=5, block_rows=block_rows).collect()
    norms = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
    scores = np.round(unit @ unit.T, 9)
    for i in range(60):
        want = sorted(range(60), key=lambda j: (-scores[i, j], j))[:5]
        got = sorted((r for r in found if r.query_id == f"p{i:02d}"), key=lambda r: r.rn)
        assert [r.row_key for r in got] == [f"p{j:02d}" for j in want]


def test_approximate_search_finds_most_of_the_exact_list(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((10, 64)) * 3
    vectors = [centres[i % 10] + rng.standard_normal(64) for i in range(200)]
    points = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "row_key string, embedding array<double>")
    asked = points.select(F.col("row_key").alias("query_id"), "embedding")
    exact = exact_search(points, asked, "query_id", k=10)
    found = approximate_search(points, asked, "query_id", k=10)
    assert recall_at_k(found, exact, "query_id").agg(F.avg("recall")).first()[0] > 0.9


def texts_and_queries(spark, n=80):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(30)]
    texts = [(f"d{i:02d}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20)))) for i in range(n)]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(4))) for i in range(9)]
    return texts, asked


def brute_bm25(texts, question, k):
    docs = {key: text.split() for key, text in texts}
    avg = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for key, found in docs.items():
        total = 0.0
        for term in set(question.split()):
            df = sum(term in d for d in docs.values())
            tf = found.count(term)
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(found) / avg))
        if total:
            scores[key] = round(total, 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("block_rows,block_queries", [(9, 2), (1000, 1000)])
def test_both_lexical_searches_equal_brute_force(spark, block_rows, block_queries):
    texts, asked = texts_and_queries(spark)
    t = spark.createDataFrame(texts, "row_key string, text string")
    q = spark.createDataFrame(asked, "question_id string, question string")
    blocked = bm25.search_texts(t, q, k=7, block_rows=block_rows, block_queries=block_queries).collect()
    indexed = bm25.search_index(bm25.build_index(t), q, k=7).collect()
    for found in (blocked, indexed):
        for name, question in asked:
            got = sorted((r for r in found if r.question_id == name), key=lambda r: r.rn)
            want = brute_bm25(texts, question, 7)
            assert [r.row_key for r in got] == [key for key, _ in want]
            assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_an_index_written_and_read_gives_the_same_hits(spark, tmp_path):
    texts, asked = texts_and_queries(spark)
    t = spark.createDataFrame(texts, "row_key string, text string")
    q = spark.createDataFrame(asked, "question_id string, question string")
    index = bm25.build_index(t)
    bm25.write_index(index, str(tmp_path / "index"))
    again = bm25.read_index(spark, str(tmp_path / "index"))
    assert bm25.search_index(again, q).exceptAll(bm25.search_index(index, q)).isEmpty()


def test_a_filter_hides_rows_without_changing_word_weights(spark):
    texts, asked = texts_and_queries(spark)
    t = spark.createDataFrame([(*r, i % 2 == 0) for i, r in enumerate(texts)], "row_key string, text string, even boolean")
    q = spark.createDataFrame(asked, "question_id string, question string")
    all_ = {(r.question_id, r.row_key): r.score for r in bm25.search_texts(t, q, k=80).collect()}
    seen = bm25.search_texts(t, q, k=80, condition=F.col("even")).collect()
    assert seen and all(all_[(r.question_id, r.row_key)] == r.score for r in seen)
    assert {int(r.row_key[1:]) % 2 for r in seen} == {0}


def test_an_index_search_shuffles_the_words_asked_for_only(spark):
    texts, asked = texts_and_queries(spark)
    t = spark.createDataFrame(texts + [("none", "t1 t2"), ("none", "t1 t3 t3")], "row_key string, text string")
    q = spark.createDataFrame(asked, "question_id string, question string")
    index = bm25.build_index(t)
    pairs = index.postings.join(bm25.query_terms(q), "term").select("question_id", "row_key").distinct()
    found = bm25.search_index(index, q, k=None)
    assert found.select("question_id", "row_key").exceptAll(pairs).isEmpty() and found.count() == pairs.count()
    plan = bm25.search_index(index, q, k=3)._jdf.queryExecution().optimizedPlan().toString()
    scanned = plan[plan.index("MapInArrow") :]
    # below the counting of words stands the join with the words asked for; no (question, row) pair is summed in a join
    assert "LeftSemi" in scanned and "sum(" not in plan


@pytest.mark.parametrize("cores,rows,queries,want", [(12, 30_000_000, 200, (916, 1)), (12, 600_000, 600_000, (19, 3)), (2, 10, 10, (1, 1))])
def test_blocks_grow_with_the_rows_alone(cores, rows, queries, want):
    assert bm25.grid(rows, queries, cores, bm25.BLOCK_ROWS, bm25.BLOCK_QUERIES) == want


def points(spark):
    rows = [("a", "C1", "2020-2021", "en", None, None), ("b", "C2", "2020-2021", "it", None, None), ("w", "site", None, "en", "crawl", "crawl-1")]
    return spark.createDataFrame(rows, "row_key string, course string, academic_year string, locale string, ingest_source string, ingest_run_id string")


def test_no_scope_is_all_and_an_empty_scope_is_nothing(spark):
    p = points(spark)
    assert p.where(payload_filter(scope=None)).count() == 3
    assert p.where(payload_filter(scope=[])).count() == 0
    assert p.where(payload_filter(scope=[("C1", "2020-2021"), ("C2", "2020-2021")])).count() == 2
    assert p.where(payload_filter(scope=[("C1", "2021-2022")])).count() == 0
    assert p.where(payload_filter(locale="en", ingest_source="crawl")).count() == 1
    editions = spark.createDataFrame([("C2", "2020-2021")], "course string, academic_year string")
    assert [r.row_key for r in in_editions(p, editions).collect()] == ["b"]
    assert in_editions(p, editions.where("false")).isEmpty()


def test_retrieve_with_no_slides_in_scope_reads_web_only(spark):
    schema = "row_key string, kind string, text string, url string, content_hash string, fetch_date string, course string, academic_year string, locale string, ingest_source string, ingest_run_id string, embedding array<double>"
    rows = [
        ("s1", "slides", "red blue green", None, None, None, "C1", "2020-2021", "en", None, None, [1.0, 0.0]),
        ("w1", "web", "red blue yellow", "https://h/a", "x", "2026-01-01", "s", None, "en", "crawl", "crawl-1", [1.0, 0.1]),
        ("w2", "web", "red black white", "https://h/b", "y", "2026-01-01", "s", None, "en", "live", "live-1", [0.9, 0.1]),
    ]
    p = spark.createDataFrame(rows, schema)
    q = spark.createDataFrame([("q", "red blue", [1.0, 0.0])], "question_id string, question string, embedding array<double>")
    seen = lambda **scope: {r.row_key for r in retrieval.retrieve(p, q, retrieval.Scope(**scope), min_score=None).collect()}
    assert seen() == {"s1", "w1", "w2"}
    assert seen(editions=[]) == {"w1", "w2"}
    assert seen(editions=[], ingest_source="crawl") == {"w1"}
    assert retrieval.retrieve(p, q, retrieval.Scope(editions=[]), collections=["slides"]).isEmpty()
    plain = retrieval.retrieve(p, q, reranked=False).orderBy("rn").collect()
    assert [r.row_key for r in plain][:2] == ["s1", "w1"]


@pytest.mark.parametrize("rows,queries,want", [(600_000, 600_000, (19, 19)), (100_000, 100_000, (12, 4)), (100_000, 200, (48, 1)), (0, 0, (1, 1))])
def test_many_questions_make_no_more_blocks_of_points_than_memory_and_cores_ask_for(rows, queries, want):
    assert vector_grid(rows, queries, 12) == want


def test_words_are_dealt_to_tasks_before_they_are_counted(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(bm25, "written_once", kept)
    texts = spark.createDataFrame([("a", "red red fox"), ("b", "fox"), ("b", "red hen"), (None, "hen"), ("c", None)], "row_key string, text string")
    asked = spark.createDataFrame([("q", "red fox hen")], "question_id string, question string")
    found = bm25.search_texts(texts, asked).collect()
    assert {r.row_key for r in found} == {"a", "b", None}
    counted, dealt = plans[0].split("Exchange hashpartitioning(row_key", 1)
    assert "partial_count" in counted and "partial_count" not in dealt


def test_long_texts_make_more_blocks_and_no_posting_is_sent_twice():
    # 100 000 texts of 520 words: few rows a block by words, one block of queries
    of_rows, of_queries = bm25.text_grid(100_000, 520.0, 100_000, 6, bm25.BLOCK_ROWS, bm25.BLOCK_QUERIES)
    assert 100_000 * 520 / of_rows <= bm25.BLOCK_WORDS and of_queries == 1
    assert bm25.text_grid(10, 3.0, 10, 2, bm25.BLOCK_ROWS, bm25.BLOCK_QUERIES) == (1, 1)
    assert bm25.text_grid(0, 1.0, 0, 2, bm25.BLOCK_ROWS, bm25.BLOCK_QUERIES) == (1, 1)


def test_a_block_holds_its_postings_without_their_batches():
    import pyarrow as pa

    held = bm25._Held()
    for low in (0, 3):
        keys, terms = ["a", None, "b"], ["x", "y", "x"]
        whole = pa.RecordBatch.from_pydict({"row_key": keys, "term": terms, "factor": [1.0 + low, 2.0, None if low else 3.0]})
        held.add(whole.slice(0, 3))
    assert all(f.base is None for f in held.factors)
    block = bm25._Block(held, True)
    assert block.keys.to_pylist() == ["a", "b", None] and block.terms.to_pylist() == ["x", "y"] and block.repeats
    asked = pa.RecordBatch.from_pydict({"query_key": ["q", "q"], "term": ["x", "y"], "idf": [1.0, 1.0], "due": [True, False]})
    found = block.best(asked, 5, False).to_pydict()
    # only b is marked, under x; it is scored over both words
    assert found == {"query_key": ["q"], "row_key": ["b"], "score": [3.0]}
    assert block.start.tolist() == [0, 3, 5]
