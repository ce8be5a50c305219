"""Sources, index maintenance, catalogue, conversations, evaluation: hand-made cases."""

from __future__ import annotations

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from scriptorium.functions import html, ids, text as tx, urls
from scriptorium.operators import catalogue as cat, conversations as conv, encoding, evaluation as ev, index, links
from scriptorium.sources import files, jsonl, ledger

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("target", T.StringType())])
POINT = "point_id string, kind string, url string, ingest_source string, ingest_run_id string, source_file string, course string, academic_year string, source_sha256 string, text string, seq long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strict_reads_fill_defaults_and_refuse_damage(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2, "target": "web"}\n')
    rows = jsonl.read_strict(spark, str(good), ROW, ["id"], {"target": F.lit("slides")}).collect()
    assert [(r.id, r.target) for r in rows] == [("a", "slides"), ("b", "web")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a", "n": 1}\n{"id": "b", \n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        jsonl.read_strict(spark, str(bad), ROW).collect()
    missing = tmp_path / "missing.jsonl"
    missing.write_text('{"n": 1}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        jsonl.read_strict(spark, str(missing), ROW, ["id"]).collect()


def test_a_truncated_ledger_loses_one_line(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n{"id": "a", "n": 2}\n{"id": "a", "n": 3}\n{"id": "b", "n": ')
    good, bad = jsonl.read_tolerant(spark, str(path), ROW, ["id", "n"])
    assert (good.count(), bad.count()) == (3, 1)
    assert [r.n for r in ledger.latest_by_url(good, "id", "n").collect()] == [3]


def test_a_frozen_table_is_written_once_and_refused_when_changed(spark, tmp_path):
    path = str(tmp_path / "frozen")
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    identity = jsonl.write_frozen(rows, path).first().asDict()
    assert jsonl.read_frozen(spark, path, identity).count() == 10
    with pytest.raises(PySparkException):
        jsonl.write_frozen(rows, path)
    spark.range(1).withColumn("x", F.col("id")).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        jsonl.read_frozen(spark, path, identity)


def test_a_batch_is_admitted_whole_or_not_at_all(spark):
    rows = [
        ("x", 1, 1, "a.pdf", "s1", 10, 1, True), ("x", 1, 2, "b.pdf", "s2", 10, 1, False),
        ("y", 2, 3, "a.pdf", "s3", 10, 1, True), ("y", 2, 4, "b.pdf", "s4", 10, 1, True), ("y", 2, 5, "c.pdf", "s3", 10, 1, True),
        ("z", 3, 6, "a.pdf", "s5", 10, 1, True), ("z", 3, 7, "a.pdf", "s6", 10, 1, True), ("z", 3, 8, "d.pdf", "s7", 10, 1, True),
    ]
    uploads = spark.createDataFrame(rows, "batch string, edition long, file_id long, name string, sha256 string, bytes long, pages long, signed boolean")
    held = spark.createDataFrame([(2, "s4"), (1, "s3")], "edition long, sha256 string")
    verdicts = {r.file_id: r.verdict for r in files.batch_admission(uploads, held).collect()}
    assert verdicts == {
        1: "held back", 2: "no signature", 3: "queued", 4: "skipped", 5: "skipped",
        6: "repeated name", 7: "repeated name", 8: "held back",
    }


def test_a_folder_lists_by_suffix_whatever_its_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.PDF", "sub/b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.directory_scan(spark, str(tmp_path), ".pdf").collect()
    assert sorted(r.name for r in found) == ["a.PDF", "b.pdf"]


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def web(pid, url, source, run, seq, text="t"):
    return (pid, "web", url, source, run, "f", "s", None, "h", text, seq)


def slide(pid, file, course, year, seq, sha="h"):
    return (pid, "slides", None, None, None, file, course, year, sha, "t", seq)


def test_upsert_twice_equals_once_and_the_last_write_wins(spark):
    table = points(spark, [web("a", "u", "crawl", "c1", 1), web("b", "u", "crawl", "c1", 2)])
    batch = points(spark, [web("b", "u", "crawl", "c2", 3, "new"), web("b", "u", "crawl", "c2", 4, "newer")])
    once = index.upsert_points(table, batch)
    twice = index.upsert_points(once, batch)
    assert {r.point_id: r.text for r in once.collect()} == {"a": "t", "b": "newer"}
    assert ev.symmetric_difference(once, twice).isEmpty()


def test_replacement_keeps_crawled_and_live_copies_apart(spark):
    table = points(spark, [
        web("a1", "u", "crawl", "c1", 1), web("a2", "u", "crawl", "c1", 2), web("l1", "u", "live", "l1", 3),
        slide("s1", "f1", "C", "2020-2021", 4), slide("s2", "f2", "C", "2020-2021", 5), slide("s3", "f1", "C", "2021-2022", 6),
    ])
    batch = points(spark, [web("a1", "u", "crawl", "c2", 7), slide("s9", "f1", "C", "2020-2021", 8)])
    left = {r.point_id for r in index.replace_versions(table, batch).collect()}
    assert left == {"a1", "l1", "s9", "s2", "s3"}


def test_sync_drops_files_that_left_a_seen_edition_only(spark):
    table = points(spark, [
        slide("s1", "f1", "C", "2020-2021", 1), slide("s2", "f2", "C", "2020-2021", 2), slide("s3", "f9", "C", "2021-2022", 3), web("w", "u", "crawl", "c", 4),
    ])
    seen = spark.createDataFrame([("f1", "C", "2020-2021")], "source_file string, course string, academic_year string")
    assert {r.point_id for r in index.sync_editions(table, seen).collect()} == {"s1", "s3", "w"}
    assert index.sync_editions(table, seen, failed=True).count() == 4


def test_rolling_back_a_crawl_run_deletes_nothing(spark):
    table = points(spark, [web("a", "u", "crawl", "r1", 1), web("b", "u", "live", "r2", 2), slide("s", "f", "C", "y", 3)])
    assert index.delete_run(table, "r1").count() == 3
    assert {r.point_id for r in index.delete_run(table, "r2").collect()} == {"a", "s"}


def test_diff_join_matches_null_keys(spark):
    schema = "url string, ingest_source string, points long"
    a = spark.createDataFrame([(None, None, 3), ("u", "crawl", 1), ("v", "crawl", 1)], schema)
    b = spark.createDataFrame([(None, None, 3), ("u", "crawl", 2), ("w", "live", 1)], schema)
    got = {(r.url, r.verdict) for r in index.diff_join(a, b, index.WEB_KEY, "points").collect()}
    assert got == {(None, "equal"), ("u", "differs"), ("v", "only left"), ("w", "only right")}


EDITION = "course long, academic_year string, teaching_starts date"


def states(spark, rows, day):
    editions = spark.createDataFrame(rows, "course long, academic_year string, s string").select(
        "course", "academic_year", F.to_date("s").alias("teaching_starts")
    )
    marked = cat.edition_states(cat.on_days(editions, [day]))
    return {r.academic_year: r.state for r in marked.collect()}


@pytest.mark.parametrize("day,want", [
    ("2025-09-14", {"2024-2025": "current", "2025-2026": "upcoming"}),
    ("2025-09-15", {"2024-2025": "past", "2025-2026": "current"}),
    ("2025-09-16", {"2024-2025": "past", "2025-2026": "current"}),
    ("2024-08-31", {"2024-2025": "upcoming", "2025-2026": "upcoming"}),
    ("2024-09-01", {"2024-2025": "current", "2025-2026": "upcoming"}),
])
def test_edition_states_around_a_start(spark, day, want):
    assert states(spark, [(1, "2024-2025", None), (1, "2025-2026", "2025-09-15")], day) == want


def test_permissions_of_roles_on_past_editions(spark):
    rows = [(1, 1, "y", True, False, True, False, True), (2, 1, "y", False, True, True, False, True), (3, 1, "y", True, True, True, False, True), (4, 1, "y", False, False, True, True, True), (5, 1, "y", True, True, False, True, False)]
    scopes = spark.createDataFrame(rows, "user_id long, course long, academic_year string, as_teacher boolean, as_secretariat boolean, past boolean, superuser boolean, active boolean")
    held = {}
    for r in cat.permissions_on(scopes).collect():
        held.setdefault(r.user_id, set()).add(r.permission)
    everything = set(cat.EDITION_PERMISSIONS)
    assert held == {1: everything - {"edition.assign_teacher"}, 2: everything, 3: everything, 4: everything}


def test_threads_with_a_missing_parent_and_a_cycle(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("m", "gone"), ("n", "m"), ("x", "z"), ("y", "x"), ("z", "y")]
    messages = spark.createDataFrame(rows, "id string, parent_id string")
    leaves = spark.createDataFrame([("c",), ("n",), ("z",)], "leaf string")
    found = conv.thread_paths(leaves, messages).collect()
    paths = {}
    for r in found:
        paths.setdefault((r.leaf, r.status), []).append((r.depth, r.id))
    assert sorted(paths[("c", "complete")]) == [(0, "a"), (1, "b"), (2, "c")]
    assert sorted(paths[("n", "missing parent")]) == [(0, "m"), (1, "n")]
    assert {i for _, i in paths[("z", "cycle")]} == {"x", "y", "z"}


def test_failures_are_counted_and_never_averaged(spark):
    rows = [("m", "en", v) for v in ("0.5", "1.0", "nan", "failed", "refused")] + [("m", "it", "failed")]
    scores = spark.createDataFrame(rows, "metric string, locale string, value string")
    got = {r.group: r for r in ev.by_locale(scores, ev.metric_summary(F.col("value")), ["metric"]).collect()}
    assert (got["en"]["mean"], got["en"]["scored"], got["en"]["nan"], got["en"]["failed"], got["en"]["refused"]) == (0.75, 2, 1, 1, 1)
    assert got["it"]["mean"] is None and got["all"]["failed"] == 2


def test_retrieval_summary_of_known_ranks(spark):
    ranks = spark.createDataFrame([(1,), (2,), (4,), (10,), (None,)], "rank long")
    row = ranks.agg(*ev.retrieval_summary(F.col("rank"))).first()
    assert (row.hit_1, row.hit_3, row.hit_5, row.hit_10) == (1, 2, 3, 4)
    assert row.mrr_10 == pytest.approx((1 + 0.5 + 0.25 + 0.1) / 5)


def test_a_judge_that_raises_is_a_counted_failure(spark):
    rows = spark.createDataFrame([(1, "abcd"), (3, "abcd"), (1, "abcde")], "turn long, text string")
    found = encoding.judge_scores(rows, ["turn", "text"], encoding.length_judge).collect()
    assert [(r.judgement.value, r.judgement.reason) for r in found] == [(0.04, None), (None, "failed"), (None, "nan")]


def test_crawl_order_stops_at_the_cap(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 0)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "page long")
    visited, left = links.crawl_order(edges, seeds, max_pages=4)
    assert {(r.page, r.hop, r.referrer) for r in visited.collect()} == {(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 1)}
    assert left == 1


def test_point_ids_equal_the_standard_library(spark):
    import uuid

    for name in ("C1:2020-2021:ab:text:0001", "é"):
        assert one(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_links_are_absolute_named_once_and_leave_the_page(spark):
    page = '<a href="/b#x">First <b>name</b></a><a href="b">again</a><a href="#top">top</a><a href="mailto:x@y">mail</a><a href="https://o/p">other</a>'
    assert html.links_of("https://h/a", page) == [("https://h/b", "First name"), ("https://o/p", "other")]


def test_visible_text_leaves_out_chrome(spark):
    page = "<body><nav>menu</nav><p>Hello <b>there</b></p><script>x()</script><footer>end</footer></body>"
    assert html.visible_text_of(page) == "Hello there"


def test_tag_look_alikes_are_defused_and_the_rest_kept(spark):
    df = spark.createDataFrame([("a <quoted> b",), ("x ＜/quo­ted> n²",), ("price < quoted price",)], "t string")
    got = [r.c for r in df.select(tx.neutralize("t").alias("c")).collect()]
    assert got[0] == "a (quoted> b"
    assert "＜" not in got[1] and got[1].endswith("n²")
    assert got[2] == "price < quoted price"


def test_inert_urls_are_ascii_and_stable(spark):
    first = one(spark, urls.inert_url(F.lit("https://h/a b[1]?q=è%20")))
    assert first == "https://h/a%20b%5B1%5D?q=%C3%A8%20"
    assert one(spark, urls.inert_url(F.lit(first))) == first


@pytest.mark.parametrize("url,year", [
    ("https://h/guide-2020-21.pdf", 2021), ("https://h/2017-2018/", 2018), ("https://h/2016_2017", 2017), ("https://h/23_24", 2024),
    ("https://h/2022_11_07", 2022), ("https://h/2025", 2025), ("https://h/B271-23-23", None), ("https://h/2024/x", None),
])
def test_edition_years(spark, url, year):
    assert one(spark, urls.edition_year(F.lit(url))) == year


@pytest.mark.parametrize("tag,want", [("it-IT", "it"), (" EN_us ", "en"), ("english", None), ("", None), ("nap", "nap")])
def test_primary_subtags(spark, tag, want):
    assert one(spark, tx.primary_subtag(F.lit(tag))) == want


@pytest.mark.parametrize("text,want", [("the cat and the dog", "en"), ("il gatto e la casa per sempre", "it"), ("这是一个测试 ok", "zh"), ("", "en")])
def test_locales(spark, text, want):
    assert one(spark, tx.detect_locale(F.lit(text))) == want


def test_generators_follow_the_column_rules(spark):
    from scriptorium.functions import text as tx
    from scriptorium.operators.table_functions import register_table_functions

    register_table_functions(spark)
    text = "one didat-\ntici two three"
    rows = spark.sql("SELECT shingle FROM shingles(:text)", {"text": text}).collect()
    listed = spark.createDataFrame([(text,)], "text string").select(tx.shingles(F.col("text")).alias("s")).first().s
    assert sorted(r.shingle for r in rows) == sorted(listed)
    answer = "see (Excerpt 4, 2), 【Excerpt 5】 `[9]` and [3], Excerpt 3"
    rows = spark.sql("SELECT number FROM citation_refs(:answer)", {"answer": answer}).collect()
    assert [r.number for r in rows] == [4, 2, 5, 3]


def test_lists_of_references_are_whole(spark):
    from scriptorium.functions import citations as cite

    rows = [
        ("a", "see (Excerpt 1, 2) and 【Excerpt 3 和 1】.", [1, 2, 3], ["[m]"], "see and."),
        ("b", "see (Excerpt 9, 2), (Excerpt 2) [m1] x", [1, 2], ["[m]", "[m1]"], "see (Excerpt 9, 2), x"),
        ("c", " two  words here [1]. ", None, None, "two  words here [1]."),
    ]
    frame = spark.createDataFrame(rows, "id string, answer string, numbers array<long>, markers array<string>, want string")
    out = frame.select("want", cite.strip_citations(F.col("answer"), F.col("numbers"), F.col("markers")).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]
    found = frame.select(cite.referenced_numbers(F.col("answer"), F.coalesce(F.size("numbers"), F.lit(0))).alias("n")).collect()
    assert [sorted(r.n) for r in found] == [[1, 2, 3], [2], []]


def test_as_of_by_merging_equals_plain_python(spark):
    """One key holds half of both sides; null keys and times, ties, repeated rows, no rows."""
    from scriptorium.operators import asof

    rng = random.Random(6)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    time = lambda: rng.choice([*range(200), None])
    asks = [(key(), time(), k % 150, "clash") for k in range(400)]
    asks += asks[:40]
    given = [(key(), time(), f"v{k % 90}") for k in range(300)]
    left = spark.createDataFrame(asks, "k string, at int, n int, best string")
    right = spark.createDataFrame(given, "k string, since int, value string")
    found = asof.as_of(left.repartition(3), right, ["k"], "at", "since", F.struct("since", "value"))

    def best(k, at):
        own = [(s, x) for key, s, x in given if key == k and s is not None and at is not None and s <= at] if k else []
        return max(own, default=None)

    want = sorted((k, at, n, c, best(k, at)) for k, at, n, c in asks if k and at is not None)
    got = [(*r[:4], tuple(r.found) if r.found else None) for r in found.collect()]
    assert sorted(x for x in got if x[0] and x[1] is not None) == want and len(got) == len(asks)
    assert all(x[4] is None for x in got if x[0] is None or x[1] is None)
    assert asof.as_of(left.limit(0), right, ["k"], "at", "since", F.struct("since")).isEmpty()
    assert asof.as_of(left, right.limit(0), ["k"], "at", "since", F.struct("since")).where("found is not null").isEmpty()


def test_scope_by_intervals_equals_every_rule_tried(spark):
    """Nested, equal and empty prefixes, many rules on one host, paths of any letters."""
    from scriptorium.operators import scope_intervals

    rng = random.Random(9)
    part = lambda: "/" + "/".join(rng.choice(["a", "ab", "b", "é", "z\U0010ffff", "日"]) for _ in range(rng.randrange(1, 5)))
    rules = [(k, rng.choice(["hot.org", "hot.org", "x.net"]), part()[: rng.randrange(0, 9)], f"s{k % 7}") for k in range(150)]
    rng.shuffle(rules)
    rules += [(500, None, "/", "s"), (501, "y.net", None, "s")]
    pages = [(k, rng.choice(["https://hot.org", "http://HOT.org:80", "https://x.net", "https://none.de", "ftp://hot.org"]) + part() + rng.choice(["", "?q=/a", "#b"])) for k in range(400)]
    pages += [(900, None), (901, ""), (902, "https://hot.org")]
    p = spark.createDataFrame(pages, "page_id int, url string").repartition(3)
    r = spark.createDataFrame(rules, "rule_order int, host string, path_prefix string, section string")
    got, want = (sorted(map(tuple, f(p, r, "page_id").collect())) for f in (scope_intervals.in_scope, urls.in_scope))
    assert got == want and any(x[2] is not None for x in got) and any(x[2] is None for x in got)


def test_a_second_ingest_is_made_once(spark, tmp_path, monkeypatch):
    from scriptorium.plans import corpus_queries

    rows = [(i, f"line {i}\nmore of {i}", "en", "site", 10) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(corpus_queries.Store, "replace", lambda store, batch: made.append(batch) or store.manifest())
    corpus_queries.x14_store(spark, str(tmp_path))
    # every step of the change reads it from files of its own, not from the documents
    assert made[0].count() == 6 and all("/batch-" in f for f in made[0].inputFiles())
