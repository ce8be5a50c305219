"""Indexes at rest: the versioned table, the inverted file of vectors, postings by impact."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import bm25, impact_index, index, table_store, vector_index
from scriptorium.operators.vector_search import exact_search, recall_at_k
from scriptorium.session import scratch_path, written_once

POINT = "point_id string, kind string, url string, ingest_source string, ingest_run_id string, source_file string, course string, academic_year string, source_sha256 string, text string, seq long"


def web(key, url, seq, text="t", run=None, source="crawl"):
    return (key, "web", url, source, run, None, None, None, None, text, seq)


def deck(key, file, seq, text="t", course="C1", year="Y1", sha="s"):
    return (key, "slides", None, "upload", None, file, course, year, sha, text, seq)


POINTS = [web(f"w{i}", f"u{i // 2}", i, run="live-1" if i % 5 == 0 else None, source="live" if i % 5 == 0 else "crawl") for i in range(40)]
POINTS += [deck(f"d{i}", f"f{i // 3}", 100 + i) for i in range(30)]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, POINT)


@pytest.fixture
def store(spark, points):
    made = table_store.Store(spark, scratch_path(spark, "store-test"))
    made.create(points, buckets=16)
    return made


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_operations_equal_those_on_frames(spark, store, points):
    assert same(store.read(), points)
    batch = spark.createDataFrame([web("w3", "u1", 500, "new"), web("v2", "u7", 501), deck("d1", "f0", 502, "new"), web("w9", "elsewhere", 503)], POINT)
    after = store.upsert(batch)
    want = index.upsert_points(points, batch)
    assert same(store.read(), want) and 0 < len(after.rewritten) < 16 and after.rows == want.count()
    again = spark.createDataFrame([web("x1", "u2", 600), deck("x2", "f4", 601)], POINT)
    store.replace(again)
    want = index.replace_versions(want, again)
    assert same(store.read(), want)
    store.delete_run("live-1")
    want = index.delete_run(want, "live-1")
    assert same(store.read(), want)
    seen = spark.createDataFrame([("f0", "C1", "Y1"), ("f2", "C1", "Y1")], "source_file string, course string, academic_year string")
    assert store.sync(seen, failed=True).version == 4
    store.sync(seen)
    want = index.sync_editions(want, seen)
    assert same(store.read(), want)
    store.delete_material("s", "C1", "Y1")
    assert same(store.read(), index.delete_material(want, "s", "C1", "Y1"))
    # every version is still there, and only touched buckets were written
    assert same(store.read(version=1), points)
    assert [r.version for r in store.history().orderBy("version").collect()] == [1, 2, 3, 4, 5, 6]
    first, second = store.manifest(1), store.manifest(2)
    assert all(second.folders[b] == x for b, x in first.folders.items() if b not in second.rewritten)


def test_the_second_of_two_interleaved_writers_is_refused(spark, store):
    base = store.manifest()
    mine, theirs = (spark.createDataFrame([web(k, k, 900)], POINT) for k in ("mine", "theirs"))
    staged = store.stage(mine, base.buckets)
    store.upsert(theirs)
    with pytest.raises(table_store.ConcurrentCommit):
        store.commit(base, "upsert", set(staged), staged, base.schema, base.buckets)
    held = {r.point_id for r in store.read().collect()}
    assert "theirs" in held and "mine" not in held and store.versions() == [1, 2]
    store.upsert(mine)  # started over
    assert {"theirs", "mine"} <= {r.point_id for r in store.read().collect()} and store.versions() == [1, 2, 3]


def test_a_killed_writer_leaves_the_old_version(spark, store, points):
    base = store.manifest()

    def dies(rows):
        def fail(batches):
            for batch in batches:
                yield batch
            raise RuntimeError("lost")

        return rows.mapInArrow(fail, rows.schema)

    with pytest.raises(Exception, match="lost"):
        store.rewrite(base, "upsert", list(base.folders), dies)
    assert store.versions() == [1] and same(store.read(), points)
    # one that dies after its write and before its commit
    store.stage(points.limit(3), base.buckets)
    assert store.versions() == [1] and same(store.read(), points)
    unread = store.unread()  # a failed job may have removed its own
    assert len(unread) in (1, 2)
    assert store.vacuum(keep=1, older_than=3600) == []  # it might yet commit
    assert store.vacuum(keep=1, older_than=0) == unread and store.unread() == [] and same(store.read(), points)


def test_vacuum_keeps_what_kept_versions_read(spark, store, points):
    store.delete_run("live-1")
    store.delete_material("s", "C1", "Y1")
    want = store.read().collect()
    store.vacuum(keep=1, older_than=0)
    assert store.versions() == [3] and sorted(store.read().collect()) == sorted(want)


def test_empty_tables_and_changes(spark, store, points):
    empty = table_store.Store(spark, scratch_path(spark, "store-test"))
    empty.create(points.limit(0))
    assert empty.read().isEmpty() and empty.manifest().rows == 0
    empty.upsert(points)
    assert same(empty.read(), points)
    nothing = store.upsert(points.limit(0))
    assert nothing.rewritten == () and same(store.read(), points)
    store.rewrite(store.manifest(), "clear", list(store.manifest().folders), lambda rows: rows.where("false"))
    assert store.read().isEmpty() and store.read().columns == points.columns


def test_one_changed_point_reads_one_bucket(spark, store, points):
    other = table_store.Store(spark, scratch_path(spark, "store-test"))
    other.create(points.repartition(5), buckets=16)
    assert store.manifest().differing(other.manifest()) == [] and store.compare(other)[0].isEmpty()
    other.upsert(spark.createDataFrame([web("w3", "u1", 3, "changed")], POINT))
    rows, read = store.compare(other)
    assert [tuple(r) for r in rows.collect()] == [("w3", "differs")] and len(read) == 1
    other.upsert(spark.createDataFrame([web("new", "u99", 3)], POINT))
    other.delete_run("live-1")
    rows, read = store.compare(other)
    gone = {r.point_id for r in points.where("ingest_run_id = 'live-1'").collect()}
    assert {tuple(r) for r in rows.collect()} == {("w3", "differs"), ("new", "only right"), *((k, "only left") for k in gone)}
    assert set(read) == {b for b in range(16) if store.manifest().folders.get(b, (0, 0, ""))[2] != other.manifest().folders.get(b, (0, 0, ""))[2]}


# ---- vectors --------------------------------------------------------------------------


def vectors(spark, n, width=16, seed=1, lumps=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    if lumps:
        x = rng.normal(size=(lumps, width))[rng.integers(0, lumps, n)] * 3 + x
    return spark.createDataFrame([(f"r{k:05d}", row.tolist()) for k, row in enumerate(x)], "row_key string, embedding array<double>")


@pytest.mark.parametrize("lumps,probed,recall", [(0, 0.9, 0.9), (20, 0.3, 0.95)])
def test_the_index_finds_nine_tenths_and_scores_few(spark, lumps, probed, recall):
    points = vectors(spark, 3000, lumps=lumps)
    asked = points.where("row_key like '%0'").withColumnRenamed("row_key", "query_id")
    built = vector_index.build(points, scratch_path(spark, "vectors"))
    found = vector_index.search(vector_index.open_index(spark, built.path), points, asked, "query_id", k=10, probed=probed, exclude_self=True).cache()
    exact = exact_search(points, asked, "query_id", k=10, exclude_self=True)
    assert recall_at_k(found, exact, "query_id").agg({"recall": "avg"}).first()[0] >= recall
    most = found.agg({"scored": "max", "scanned": "max"}).first()
    assert most["max(scored)"] <= 50 and most["max(scanned)"] <= (probed + 0.1) * 3000 * (1.5 if lumps else 1)
    # scores are exact, ranks in order
    both = found.join(exact.select("query_id", "row_key", F.col("score").alias("want")), ["query_id", "row_key"])
    assert both.where("abs(score - want) > 1e-8").isEmpty()
    assert found.groupBy("query_id").count().where("count <> 10").isEmpty()


def test_blocks_and_query_parts_change_nothing(spark):
    points = vectors(spark, 900)
    asked = points.limit(70).withColumnRenamed("row_key", "query_id")
    built = vector_index.build(points, scratch_path(spark, "vectors"))
    rows = lambda **more: sorted(tuple(r) for r in vector_index.search(built, points, asked, "query_id", k=5, **more).collect())
    assert rows() == rows(block_rows=40, query_rows=9)


def test_lists_are_dealt_by_size():
    first, count = vector_index.list_blocks({0: 5, 1: 5, 2: 95, 3: 3, 4: 4}, 6, 10)
    assert count.tolist() == [1, 1, 10, 1, 1, 1] and first.tolist() == [0, 0, 1, 11, 11, 11]


def test_vectors_that_are_null_zero_equal_or_none(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 0.0, 0.0]), ("d", None), ("e", [0.0, 1.0, 0.0])]
    points = spark.createDataFrame(rows, "row_key string, embedding array<double>")
    asked = points.withColumnRenamed("row_key", "query_id")
    built = vector_index.build(points, scratch_path(spark, "vectors"))
    found = vector_index.search(built, points, asked, "query_id", k=2, probed=1.0, exclude_self=True).collect()
    assert [(r.row_key, r.score) for r in sorted(found, key=lambda r: r.rn) if r.query_id == "a"] == [("b", 1.0), ("c", 0.0)]
    assert {r.query_id for r in found} == {"a", "b", "c", "e"} and all(r.row_key != "d" for r in found)
    none = points.limit(0)
    built = vector_index.build(none, scratch_path(spark, "vectors"))
    assert vector_index.search(built, none, asked, "query_id").isEmpty()


# ---- postings by impact ---------------------------------------------------------------


def texts(spark, n=700, seed=3):
    """A word in every other text, words of falling frequency, rare words, texts without words."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        own = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 40))]
        rows.append((f"r{k:04d}", " ".join(own + ["the"] * rng.choice((0, 1, 3)) + ([f"rare{k % 90}"] if k % 3 == 0 else []))))
    rows += [("x1", ""), ("x2", None), ("x3", "the the the"), ("x4", "the the the")]
    return spark.createDataFrame(rows, "row_key string, text string")


QUESTIONS = [("q1", "the rare3 w7"), ("q2", "the"), ("q3", "the w1 w2 w3 w1"), ("q4", "rare1 rare2 the the w9"), ("q5", "unknown"), ("q6", "unknown rare81"), ("q7", None)]


@pytest.mark.parametrize("block,k", [(4, 5), (16, 20), (128, 3)])
def test_unread_blocks_change_no_list(spark, block, k):
    rows = texts(spark)
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    built = bm25.build_index(rows)
    stored = impact_index.write(built, scratch_path(spark, "impacts"), block=block)
    found, reads = impact_index.search(impact_index.open_index(spark, stored.path), asked, k=k)
    want = bm25.search_index(built, asked, k=k)
    assert same(found.select("question_id", "row_key", "score", "rn"), want)
    read = {r.question_id: (r.read, r.blocks) for r in reads.collect()}
    assert all(0 < a <= b for a, b in read.values()) and set(read) == {"q1", "q2", "q3", "q4", "q6"}
    if block == 4:  # a word that half the texts hold is hardly read
        assert read["q2"][0] <= read["q2"][1] / 8 and read["q1"][0] < read["q1"][1] / 2
    visible = rows.where("row_key like '%7'")
    found, _ = impact_index.search(stored, asked, k=k, visible=visible)
    assert same(found.select("question_id", "row_key", "score", "rn"), bm25.search_index(built, asked, k=k, visible=visible))


def test_no_level_writes_more_than_the_best_of_each_question(spark, monkeypatch):
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    stored = impact_index.write(bm25.build_index(texts(spark)), scratch_path(spark, "impacts"), block=16)
    kept = []

    def watched(df, name):
        rows = written_once(df, name)
        if name == "impact-scored":
            kept.append(rows.groupBy("question_id").count().agg(F.max("count")).first()[0])
        return rows

    monkeypatch.setattr(impact_index, "written_once", watched)
    impact_index.search(stored, asked, k=3)
    assert kept and max(kept) == 3


def test_levels_hold_every_posting_once_by_impact(spark):
    built = bm25.build_index(texts(spark))
    stored = impact_index.write(built, scratch_path(spark, "impacts"), block=8)
    keys = stored.blocks.select("term", F.explode("keys").alias("row_key"))
    assert same(keys, built.postings.select("term", "row_key"))
    assert stored.blocks.where("size(keys) > 8").isEmpty()
    tops = {}
    for r in stored.blocks.select("term", "block", "top", "level").orderBy("term", "block").collect():
        assert r.top <= tops.get(r.term, r.top) and r.level == (0 if r.block == 0 else int(np.log2(r.block)) + 1)
        tops[r.term] = r.top


def test_an_empty_index_and_no_questions(spark):
    rows = texts(spark).limit(0)
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    stored = impact_index.write(bm25.build_index(rows), scratch_path(spark, "impacts"))
    found, reads = impact_index.search(stored, asked)
    assert found.isEmpty() and reads.isEmpty()
    stored = impact_index.write(bm25.build_index(texts(spark, 50)), scratch_path(spark, "impacts"))
    assert impact_index.search(stored, asked.limit(0))[0].isEmpty()


def test_queries_are_sent_to_their_blocks_a_few_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    quantizer = vector_index.Quantizer(x[:20], np.zeros((4, 1, 4), np.float32))
    touches = np.eye(20, 10, dtype=np.float32) + np.eye(20, 10, -10, dtype=np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(list(x), pa.list_(pa.float32()))], ["query_key", "query_vec"])
    sent = list(vector_index.spread_queries(quantizer, batch, touches, 5, 20_000))
    assert len(sent) > 1 and max(b.nbytes for b in sent) <= 20_000
    met = quantizer.probes(vector_index._unit(batch.column(1)), 5).astype(np.float32) @ touches > 0
    got = [(q, b) for s in sent for b, q in zip(s.column(0).to_pylist(), s.column(1).to_pylist())]
    assert got == [(int(q), int(b)) for q, b in zip(*np.nonzero(met))]


def test_words_are_counted_where_their_texts_were_dealt(spark):
    plan = bm25.build_index(texts(spark, 50)).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_a_level_takes_the_rows_of_its_blocks_only(spark, monkeypatch):
    built = bm25.build_index(texts(spark))
    stored = impact_index.write(built, scratch_path(spark, "impacts"), block=4)
    asked = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    rows, score = [], impact_index.score_blocks

    def watched(postings, *a, **b):
        rows.append(postings.select("row_key").distinct().count())
        return score(postings, *a, **b)

    monkeypatch.setattr(impact_index, "score_blocks", watched)
    found, _ = impact_index.search(stored, asked, k=5)
    assert same(found.select("question_id", "row_key", "score", "rn"), bm25.search_index(built, asked, k=5))
    # before, all rows with a word asked for
    assert len(rows) > 2 and max(rows[:2]) < 100


def test_runs_of_a_term_in_several_pieces_are_cut_at_its_own_places(spark):
    rows = [("t", p, s, 1.0 - p / 10 - s / 100, [f"k{p}{s + i}" for i in range(n)], [1.0 - p / 10 - (s + i) / 100 for i in range(n)]) for p, s, n in ((0, 0, 3), (1, 0, 4), (1, 4, 2), (2, 0, 1))]
    rows += [("a", 0, 0, 0.5, ["x", "y"], None), ("u", 2, 0, 0.5, ["z", None], [0.5, 0.4])]
    runs = spark.createDataFrame(rows, "term string, piece int, start long, top double, keys array<string>, impacts array<double>")
    got = {(r.term, r.block): (round(r.top, 6), sorted(r["keys"], key=str)) for r in impact_index._cut(runs, 4).collect()}
    assert got == {
        ("a", 0): (0.5, ["x", "y"]),
        ("t", 0): (1.0, ["k00", "k01", "k02", "k10"]),
        ("t", 1): (0.89, ["k11", "k12", "k13", "k14"]),
        ("t", 2): (0.85, ["k15", "k20"]),
        ("u", 0): (0.5, [None, "z"]),
    }


@pytest.mark.parametrize("name,change", [("upsert_points", table_store.Store.upsert), ("replace_versions", table_store.Store.replace)])
def test_points_a_batch_does_not_name_are_not_shuffled(spark, monkeypatch, name, change):
    many = spark.createDataFrame([web(f"p{i}", f"page{i}", i) for i in range(300)] + [deck(f"q{i}", f"file{i}", 900 + i) for i in range(300)], POINT)
    batch = spark.createDataFrame([web("p3", "page3", 2000, "new"), web("n", "page7", 2001), deck("m", "file9", 2002), web("w", "page8", 2003, source="live")], POINT)
    whole, sent = getattr(index, name), []
    want = whole(many, batch)
    monkeypatch.setattr(index, name, lambda rows, *a, **b: sent.append(rows.count()) or whole(rows, *a, **b))
    made = table_store.Store(spark, scratch_path(spark, "store-test"))
    made.create(many, buckets=2)
    change(made, batch)
    assert same(made.read(), want) and len(sent) == 1 and sent[0] < 20


def test_keeping_the_last_where_rows_lie_equals_keeping_the_last(spark):
    rows = spark.createDataFrame([(k % 90 if k % 10 else None, k, f"v{k}") for k in range(120)], "id int, seq long, v string")
    assert same(index.keep_last_where_they_lie(rows, "id", "seq"), index.keep_last(rows, "id", "seq"))
    one = spark.range(50).select(F.col("id"), F.col("id").alias("seq"))
    kept = index.split_by_keys(one, "id", index.repeated_keys(one, "id"))
    assert kept[0].isEmpty() and kept[1].count() == 50 and "Exchange" not in kept[1]._jdf.queryExecution().executedPlan().toString()
