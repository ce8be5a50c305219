"""Registered queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators.table_functions import register_table_functions
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.scalar_queries import LINKS_SQL
from scriptorium.plans.task_queries import STAMP_SQL, TASK_SQL, stamp
from scriptorium.session import scratch_path
from scriptorium.streaming import ingest, lifecycle, windows
from scriptorium.streaming.replay import (
    read_stream,
    rocksdb_state,
    run_batches,
    run_to_table,
    write_in_order,
)

# partitions of the streams' state in these queries; a stream keeps what it starts with
STATE_PARTITIONS = 8


def activity_stream(spark, sf, extra=()):
    rows = v.activity(spark, sf).select(
        "task", "kind", "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event", *extra
    )
    return read_stream(spark, write_in_order(rows), rows.schema)


@query("t01_live_ledger_ingest")
def t01(spark, sf):
    """Fetched pages as a stream: what became of each, and the points the index ends with."""
    s = F.col("seq")
    rows = (
        v.registry(spark, sf)
        .join(v.table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.col("html").alias("text")), "seq")
        .select(
            "seq", "url", "ingest_source", "content_hash",
            (s % 13 != 0).alias("relevant"), (s % 17 != 0).alias("complete"), "text",
            F.timestamp_seconds(s * 60).cast("timestamp_ntz").alias("ts"),
        )
    )
    path = scratch_path(spark, "live")
    stream = read_stream(spark, write_in_order(rows), rows.schema)
    run_batches(stream.drop("ts"), ingest.ingest_batch(path))
    ledger = spark.read.parquet(f"{path}/ledger")
    log = spark.read.parquet(f"{path}/points")
    planned = ledger.groupBy("action").agg(F.count("*").alias("rows"))
    held = ingest.current_points(log).agg(F.lit("points held").alias("action"), F.count("*").alias("rows"))
    return planned.unionByName(held)


CLOSED_SQL = f"""SELECT task, kind, {STAMP_SQL.format('began')} AS began, {STAMP_SQL.format('last')} AS last, entries, steps, outcome FROM {TASK_SQL}
    WHERE outcome NOT IN ('lost', 'running')"""


@query("t02_task_lifecycle_stream", CLOSED_SQL)
def t02_stream(spark, sf):
    """Tasks folded by a stateful stream; the closed ones equal the batch twin's."""
    with rocksdb_state(spark, STATE_PARTITIONS):
        rows = run_to_table(
            lifecycle.task_lifecycles(
                activity_stream(spark, sf), late="2 days", question_lease=86400, upload_lease=86400
            )
        )
    closed = rows.where("outcome not in ('lost', 'interrupted')")
    return closed.select(
        "task", "kind", stamp("began").alias("began"), stamp("last").alias("last"), "entries", "steps", "outcome"
    )


@query(
    "t03_session_lease_stream",
    f"""SELECT task, {STAMP_SQL.format('min(ts)')} AS began, {STAMP_SQL.format('max(ts)')} AS ended, count(*) AS entries FROM (
        SELECT task, ts, sum(b) OVER (PARTITION BY task ORDER BY ts, event_id) AS part FROM (
            SELECT task, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY task ORDER BY ts, event_id)) >= 14400000000 THEN 1 ELSE 0 END AS b FROM v_activity))
        GROUP BY task, part HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def t03_stream(spark, sf):
    """Task sessions broken by four silent hours, emitted once the watermark passes them."""
    with rocksdb_state(spark, STATE_PARTITIONS):
        rows = run_to_table(windows.session_leases(activity_stream(spark, sf), "4 hours"))
    return rows.select("task", stamp("began").alias("began"), stamp("ended").alias("ended"), "entries")


@query("t04_admission_stream")
def t04_stream(spark, sf):
    """Questions and uploads admitted under a cap per user: verdicts and the highest load."""
    entries = activity_stream(spark, sf).withColumn("tenant", F.col("user_id").cast("string"))
    with rocksdb_state(spark, STATE_PARTITIONS):
        rows = run_to_table(lifecycle.admissions(entries, lease=6 * 3600))
    return rows.groupBy("tenant", "verdict").agg(
        F.count("*").alias("tasks"), F.max("running").alias("most_running")
    )


@query(
    "t05_rate_window_stream",
    """SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, greatest(count(*) - 4, 0) AS refused FROM events
       GROUP BY 1, 2, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def t05_stream(spark, sf):
    """The rate windows of a stream, as far as its watermark has closed them."""
    rows = v.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = read_stream(spark, write_in_order(rows), rows.schema)
    with rocksdb_state(spark, STATE_PARTITIONS):
        found = run_to_table(windows.rate_windows(stream, "user_id", "1 hour", 4))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def counted_windows(spark, sf):
    """Events in order of arrival, of which every fiftieth comes three days late, through counted windows."""
    sent = F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("interval 3 days")).otherwise(F.col("ts"))
    rows = v.table(spark, sf, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), sent.cast("timestamp").alias("sent")
    )
    held = windows.CountedWindows(spark, scratch_path(spark, "windows"), "user_id", "1 hour", 4)
    run_batches(read_stream(spark, write_in_order(rows, "sent"), rows.schema), held.add)
    return held


@query("t05_rate_window_accounted", "SELECT user_id, count(*) AS sent, true AS some_late FROM events GROUP BY 1")
def t05_accounted(spark, sf):
    """Per caller the events kept in windows and those counted as late: together what was sent."""
    rows = counted_windows(spark, sf).totals()
    some = rows.agg((F.sum("late") > 0).alias("some_late"))  # one row
    return rows.select("user_id", (F.col("kept") + F.col("late")).alias("sent")).join(F.broadcast(some))


@query("t05_rate_window_late")
def t05_late(spark, sf):
    """The windows of a stream with late events, and how many came after each had closed."""
    rows = counted_windows(spark, sf).windows()
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("t06_retained_tail", "SELECT event_id, task, event FROM v_activity ORDER BY event_id DESC LIMIT 2000")
def t06(spark, sf):
    """The newest entries a stream keeps, each id once though every entry is sent twice."""
    path = scratch_path(spark, "tail")
    entries = activity_stream(spark, sf).select("event_id", "task", "event", "ts")
    twice = entries.unionByName(entries)
    once = twice.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    with rocksdb_state(spark, STATE_PARTITIONS):
        run_batches(once.drop("ts"), ingest.tail_batch(path, 2000))
    return ingest.read_after(spark, path, -1).select("event_id", "task", "event")


@query(
    "t07_activity_projection_stream",
    """SELECT event_id, task, event, COALESCE(CASE WHEN event IN ('queued', 'refused') AND user_id % 4 <> 0 THEN left(repeat('question ' || user_id || ' ', 30), 200) END, 'none') AS question
       FROM v_activity WHERE NOT (event = 'step' AND event_id % 4 = 0)""",
)
def t07_stream(spark, sf):
    from scriptorium.plans.task_queries import full_entries

    rows = full_entries(spark, sf).withColumn(
        "ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz")
    )
    stream = read_stream(spark, write_in_order(rows), rows.schema)
    found = run_to_table(windows.activity_rows(stream))
    return found.select("event_id", "task", "event", F.coalesce("question", F.lit("none")).alias("question"))


@query(
    "t08_time_to_first_stream",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM (
        SELECT ts, event, event_id % 900 AS ms FROM v_activity WHERE event IN ('step', 'start')) GROUP BY date_trunc('day', ts), 2
       HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""",
)
def t08_stream(spark, sf):
    """Step latencies per day on a stream, as far as its watermark has closed the days."""
    rows = (
        v.activity(spark, sf)
        .where("event in ('step', 'start')")
        .select(F.col("ts").cast("timestamp").alias("ts"), "event", (F.col("event_id") % 900).alias("ms"))
    )
    stream = read_stream(spark, write_in_order(rows), rows.schema)
    with rocksdb_state(spark, STATE_PARTITIONS):
        found = run_to_table(windows.latency_windows(stream, "1 day", accuracy=1_000_000))
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event", "n", "p50", "p95")


@query(
    "e05_table_functions",
    f"SELECT page_id, pos, dst, anchor FROM ({LINKS_SQL})",
)
def e05(spark, sf):
    """The link generator called from SQL, once per page."""
    register_table_functions(spark)
    pages = v.table(spark, sf, "pages")
    return spark.sql(
        "SELECT p.page_id, CAST(l.pos AS BIGINT) AS pos, l.dst, l.anchor FROM {pages} p, LATERAL page_links(p.url, p.html) l",
        pages=pages,
    )


@query(
    "e05_shingle_table",
    r"""SELECT conv_id, turn, count(*) AS shingles FROM (SELECT conv_id, turn, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) END)
        FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations)) GROUP BY 1, 2""",
)
def e05_shingles(spark, sf):
    register_table_functions(spark)
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return spark.sql(
        "SELECT c.conv_id, c.turn, count(*) AS shingles FROM {rows} c, LATERAL shingles(c.text) s GROUP BY c.conv_id, c.turn",
        rows=rows,
    )


@query(
    "e05_citation_refs",
    """SELECT DISTINCT answer_id, CAST(n AS INTEGER) AS number FROM (
        SELECT answer_id, unnest(list_concat([turn % 4, 9], CASE conv_id % 8 WHEN 0 THEN [2] WHEN 4 THEN [1, 2] WHEN 5 THEN [9, 2] WHEN 6 THEN [1, 2] WHEN 7 THEN [2, 3] ELSE [] END)) AS n
        FROM v_answers)""",
)
def e05_citations(spark, sf):
    """Every number an answer refers to, by the generator called from SQL."""
    register_table_functions(spark)
    return spark.sql(
        "SELECT a.answer_id, r.number FROM {rows} a, LATERAL citation_refs(a.answer) r", rows=v.answers(spark, sf)
    )
