"""Streams against their batch twins, late and repeated entries, deliveries made twice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from scriptorium.operators import tasks
from scriptorium.session import scratch_path
from scriptorium.streaming import ingest, lifecycle, windows
from scriptorium.streaming.replay import Replay, read_stream, rocksdb_state, run_batches, run_to_table, write_in_order

START = dt.datetime(2026, 1, 1)
ENTRY = "task string, kind string, event_id long, ts timestamp, event string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def replay(spark, rows, schema, slices=4):
    frame = spark.createDataFrame(rows, schema)
    return read_stream(spark, write_in_order(frame, slices=slices), frame.schema), frame


def test_tasks_close_or_run_out_of_lease(spark):
    rows = [
        ("a", "question", 1, at(0), "queued"), ("a", "question", 2, at(5), "taken"), ("a", "question", 3, at(9), "end"),
        ("b", "question", 4, at(10), "queued"), ("b", "question", 5, at(12), "taken"),
        ("c", "upload", 6, at(20), "queued"), ("c", "upload", 7, at(30), "parsing"), ("c", "upload", 8, at(40), "failed"),
        ("z", "question", 9, at(9000), "queued"), ("z", "question", 10, at(9001), "end"), ("y", "question", 11, at(20000), "queued"),
    ]
    stream, frame = replay(spark, rows, ENTRY)
    with rocksdb_state(spark):
        found = {r.task: r for r in run_to_table(lifecycle.task_lifecycles(stream, late="1 minute")).collect()}
    assert {k: (r.outcome, r.entries, r.steps) for k, r in found.items()} == {
        "a": ("answered", 3, 1), "b": ("lost", 2, 1), "c": ("failed", 3, 1), "z": ("answered", 2, 0),
    }
    batch = {r.task: r for r in tasks.task_rows(frame).collect()}
    for name in ("a", "c", "z"):
        assert (found[name].began, found[name].last, found[name].outcome) == (batch[name].began, batch[name].last, batch[name].outcome)


def test_admission_under_a_cap(spark):
    rows = [
        ("t", "a", 1, at(0), "queued"), ("t", "b", 2, at(1), "queued"), ("t", "c", 3, at(2), "queued"),
        ("t", "a", 4, at(3), "end"), ("t", "d", 5, at(4), "queued"), ("t", "e", 6, at(500), "queued"),
    ]
    stream, _ = replay(spark, rows, "tenant string, task string, event_id long, ts timestamp, event string", 2)
    with rocksdb_state(spark):
        found = run_to_table(lifecycle.admissions(stream, cap=2, lease=60)).collect()
    assert {r.task: r.verdict for r in found} == {"a": "admitted", "b": "admitted", "c": "refused", "d": "admitted", "e": "admitted"}


def test_closed_rate_windows_equal_the_batch(spark):
    rows = [("u", at(i * 37)) for i in range(200)] + [("w", at(i * 91)) for i in range(80)]
    stream, frame = replay(spark, rows, "user string, ts timestamp")
    got = run_to_table(windows.rate_windows(stream, "user", "5 minutes", 4))
    horizon = max(t for _, t in rows) - dt.timedelta(minutes=10)
    want = tasks.rate_windows(frame, "user", "5 minutes", 4).where(F.col("window_start") + F.expr("interval 5 minutes") <= F.lit(horizon))
    assert want.count() > 10
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_late_entry_past_the_watermark_is_dropped(spark):
    path = scratch_path(spark, "late")
    schema = "user string, ts timestamp"
    # The watermark a batch drops late entries by is the one its predecessor began with.
    for chunk in ([("u", at(0))], [("u", at(7200))], [("u", at(7300))], [("u", at(1))], [("u", at(20000))]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, Replay(path, 1), spark.createDataFrame([], schema).schema)
    got = run_to_table(windows.rate_windows(stream, "user", "5 minutes", 4)).collect()
    assert sorted((r.window_start, r.events) for r in got) == [(at(0), 1), (at(7200), 2)]


def test_session_leases_equal_the_batch(spark):
    rows = [("a", "question", i, at(s), "step") for i, s in enumerate([0, 10, 20, 400, 410, 5000, 9000])]
    stream, frame = replay(spark, rows, ENTRY)
    got = run_to_table(windows.session_leases(stream, "120 seconds"))
    want = tasks.lease_breaks(frame, 120).select("task", "began", "ended", "entries").where(F.col("ended") <= F.lit(at(9000 - 720)))
    assert want.count() == 3
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def page(seq, url, digest, text, relevant=True):
    return (seq, url, "live", digest, relevant, True, text)


def test_live_ingest_twice_is_once(spark):
    path = scratch_path(spark, "live")
    each = ingest.ingest_batch(path)
    batches = [
        [page(1, "u", "h1", "one\n\ntwo"), page(2, "v", "h2", "three"), page(3, "x", "h9", "junk", relevant=False)],
        [page(4, "u", "h1", "one\n\ntwo"), page(5, "v", "h3", "four\nfive")],
    ]
    frames = [spark.createDataFrame(b, ingest.FETCH) for b in batches]
    for number, frame in enumerate(frames):
        each(frame, number)
    each(frames[1], 1)
    actions = {(r.batch, r.url): r.action for r in spark.read.parquet(f"{path}/ledger").collect()}
    assert actions == {
        (0, "u"): "first fetch", (0, "v"): "first fetch", (0, "x"): "ephemeral", (1, "u"): "unchanged", (1, "v"): "content changed",
    }
    held = ingest.current_points(spark.read.parquet(f"{path}/points"))
    assert sorted((r.url, r.text) for r in held.collect()) == [("u", "one"), ("u", "two"), ("v", "five"), ("v", "four")]
    ingest.compact(spark, path, f"{path}-base", 1)
    assert spark.read.parquet(f"{path}-base/points").count() == 4


def test_a_tail_keeps_the_newest_once_and_resumes_after_an_id(spark):
    path = scratch_path(spark, "tail")
    rows = [(i, at(i)) for i in range(50)]
    stream, _ = replay(spark, rows, "event_id long, ts timestamp")
    once = stream.unionByName(stream).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    run_batches(once.drop("ts"), ingest.tail_batch(path, 10))
    assert [r.event_id for r in ingest.read_after(spark, path, 44).collect()] == [45, 46, 47, 48, 49]
    assert ingest.read_after(spark, path, -1).count() == 10


def test_a_page_that_turns_empty_leaves_the_index(spark):
    path = scratch_path(spark, "live")
    each = ingest.ingest_batch(path)
    batches = [[page(1, "u", "h1", "one\ntwo"), page(2, "v", "h2", "three")], [page(3, "u", "h3", " \n ")], [page(4, "u", "h4", "five")]]
    seen = []
    for number, rows in enumerate(batches):
        each(spark.createDataFrame(rows, ingest.FETCH), number)
        held = ingest.current_points(spark.read.parquet(f"{path}/points"))
        seen.append(sorted((r.url, r.text) for r in held.collect()))
    assert seen == [[("u", "one"), ("u", "two"), ("v", "three")], [("v", "three")], [("u", "five"), ("v", "three")]]


def test_what_a_stream_is_made_of_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = spark.range(100).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    replay = write_in_order(made.mapInArrow(count, made.schema), slices=4)
    assert spark.read.parquet(replay.path).count() == 100 and seen.value == 100


def test_a_lone_row_in_a_slice_does_not_set_the_files_of_others(spark):
    rows = spark.range(4001).select(
        F.col("id"), F.timestamp_seconds(F.when(F.col("id") == 4000, 800).otherwise(F.col("id") % 90)).cast("timestamp_ntz").alias("ts")
    )
    replay = write_in_order(rows, slices=8, rows_per_file=500)
    assert replay.files_per_trigger == 8 and spark.read.parquet(replay.path).count() == 4001


def test_tasks_of_one_bucket_share_the_messages_of_its_state(spark):
    class Handle:
        def __init__(self):
            self.value, self.calls, self.timers = None, 0, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

        def registerTimer(self, ms):
            self.calls += 1
            self.timers.append(ms)

        def getCurrentWatermarkInMs(self):
            return self.now

    from pyspark.sql import Row

    entry = lambda task, n, s, event: Row(task=task, kind="question", event_id=n, at=s * 1_000_000, event=event)
    handle, fold = Handle(), lifecycle.TaskLifecycle(question_lease=10)
    fold.init(handle)
    rows = [entry(f"t{k}", k, 100 + k, "queued") for k in range(50)] + [entry("t3", 99, 200, "end")]
    assert [(r.task, r.outcome, r.entries) for r in fold.handleInputRows((0,), iter(rows), handle)] == [("t3", "answered", 2)]
    assert handle.calls == 3 and handle.timers == [110_000]
    # a late entry of a closed task changes nothing, one of an open task moves its lease
    assert not list(fold.handleInputRows((0,), iter([entry("t3", 98, 150, "step"), entry("t0", 97, 300, "step")]), handle))
    handle.now = 110_000
    assert not list(fold.handleExpiredTimer((0,), handle, None)) and handle.timers == [110_000, 111_000]
    handle.now = 120_000
    assert {r.task for r in fold.handleExpiredTimer((0,), handle, None)} == {f"t{k}" for k in range(1, 11)} - {"t3"}
    handle.now = 1_000_000
    out = list(fold.handleExpiredTimer((0,), handle, None))
    assert len(out) == 40 and {r.outcome for r in out} == {"lost"} and handle.value is None
