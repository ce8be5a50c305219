"""Registered queries of task streams, each the batch twin of a streaming job."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import sketches, tasks
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.views import text_of
from scriptorium.session import written_once


def stamp(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "w08_recent_tasks",
    """SELECT task, event_id, event FROM v_activity WHERE task IN (SELECT task FROM v_activity GROUP BY task ORDER BY max(struct_pack(ts := ts, e := event_id)) DESC, task LIMIT 20)""",
)
def w08(spark, sf):
    return tasks.recent_tasks(v.activity(spark, sf)).select("task", "event_id", "event")


DURATION_SQL = """(SELECT *, CAST(floor((epoch_us(lead(ts) OVER (PARTITION BY task ORDER BY ts, event_id)) - epoch_us(ts)) / 1000) AS BIGINT) AS ms FROM v_activity)"""


@query(
    "w09_step_durations",
    f"SELECT kind, event, count(*) AS entries, count(ms) AS timed, CAST(COALESCE(sum(ms), 0) AS BIGINT) AS total_ms, COALESCE(max(ms), 0) AS longest_ms FROM {DURATION_SQL} GROUP BY 1, 2",
)
def w09(spark, sf):
    timed = tasks.step_durations(v.activity(spark, sf))
    return timed.groupBy("kind", "event").agg(
        F.count("*").alias("entries"),
        F.count("ms").alias("timed"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"),
        F.coalesce(F.max("ms"), F.lit(0)).alias("longest_ms"),
    )


TASK_SQL = """(SELECT task, kind, min(ts) AS began, max(ts) AS last, count(*) AS entries,
    count(*) FILTER (event NOT IN ('queued', 'end', 'error', 'ready', 'failed')) AS steps,
    COALESCE(max(CASE event WHEN 'end' THEN 'answered' WHEN 'error' THEN 'error' WHEN 'ready' THEN 'ready' WHEN 'failed' THEN 'failed' END),
             CASE WHEN kind = 'question' THEN 'lost' ELSE 'running' END) AS outcome FROM v_activity GROUP BY task, kind)"""


@query(
    "t02_task_lifecycle",
    f"SELECT task, kind, {STAMP_SQL.format('began')} AS began, {STAMP_SQL.format('last')} AS last, entries, steps, outcome FROM {TASK_SQL}",
)
def t02(spark, sf):
    rows = tasks.task_rows(v.activity(spark, sf))
    return rows.select("task", "kind", stamp("began").alias("began"), stamp("last").alias("last"), "entries", "steps", "outcome")


@query(
    "o03_task_order",
    f"""SELECT task, outcome = 'running' AS running, coalesce({STAMP_SQL.format("CASE WHEN outcome = 'running' THEN began END")}, '') AS since, {STAMP_SQL.format('last')} AS last FROM {TASK_SQL}
        ORDER BY 2 DESC, 3 DESC, 4 DESC, 1""",
)
def o03_tasks(spark, sf):
    """All tasks in the page's order: running newest first, then finished."""
    listed = tasks.listed_tasks(tasks.task_rows(v.activity(spark, sf)))
    return listed.select("task", "running", F.coalesce(stamp("since"), F.lit("")).alias("since"), stamp("last").alias("last"))


@query(
    "t03_lease_state",
    f"""SELECT task, kind, CASE WHEN closed THEN 'done' WHEN kind = 'upload' AND idle > 1800 THEN 'interrupted' WHEN kind = 'question' AND entries = 1 AND idle > 120 THEN 'untaken'
        WHEN kind = 'question' AND entries > 1 AND idle > 30 THEN 'dead' ELSE 'running' END AS state FROM (
        SELECT task, kind, count(*) AS entries, bool_or(event IN ('end', 'error', 'ready', 'failed')) AS closed,
               (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1000000.0 AS idle FROM v_activity GROUP BY 1, 2)""",
)
def t03(spark, sf):
    now = v.table(spark, sf, "events").select(F.max("ts")).scalar()
    return tasks.lease_state(v.activity(spark, sf), now)


@query(
    "t03_lease_breaks",
    f"""SELECT task, {STAMP_SQL.format('min(ts)')} AS began, {STAMP_SQL.format('max(ts)')} AS ended, count(*) AS entries FROM (
        SELECT task, ts, sum(b) OVER (PARTITION BY task ORDER BY ts, event_id) AS part FROM (
            SELECT task, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY task ORDER BY ts, event_id)) >= 14400000000 THEN 1 ELSE 0 END AS b FROM v_activity))
        GROUP BY task, part""",
)
def t03_breaks(spark, sf):
    """Unbroken runs of each task's entries, broken by four silent hours."""
    rows = tasks.lease_breaks(v.activity(spark, sf), 4 * 3600)
    return rows.select("task", stamp("began").alias("began"), stamp("ended").alias("ended"), "entries")


LOAD_SQL = f"""(SELECT tenant, day, ts, change, sum(n * change) OVER (PARTITION BY tenant, day ORDER BY ts, change ROWS UNBOUNDED PRECEDING) AS running FROM (
    SELECT tenant, day, ts, change, count(*) AS n FROM (
        SELECT kind AS tenant, strftime(began, '%Y-%m-%d') AS day, began AS ts, 1 AS change FROM {TASK_SQL}
        UNION ALL SELECT kind, strftime(began, '%Y-%m-%d'), last, -1 FROM {TASK_SQL}) GROUP BY 1, 2, 3, 4))"""


@query(
    "t04_concurrency_vs_cap",
    f"SELECT tenant, day, count(*) AS changes, CAST(max(running) AS BIGINT) AS peak, count(*) FILTER (running > 4) AS over_cap FROM {LOAD_SQL} GROUP BY 1, 2",
)
def t04(spark, sf):
    """Concurrent tasks per kind and day against the cap."""
    rows = tasks.task_rows(v.activity(spark, sf)).select(
        F.col("kind").alias("tenant"), F.date_format("began", "yyyy-MM-dd").alias("day"), "began", "last"
    )
    load = tasks.concurrency(rows, "tenant")
    return load.groupBy("tenant", "day").agg(
        F.count("*").alias("changes"),
        F.max("running").alias("peak"),
        F.count_if(F.col("over_cap") > 0).alias("over_cap"),
    )


@query(
    "t05_rate_window",
    """SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, greatest(count(*) - 4, 0) AS refused FROM events GROUP BY 1, 2""",
)
def t05(spark, sf):
    """Events per caller and hour against a limit of four."""
    rows = tasks.rate_windows(v.table(spark, sf, "events"), "user_id", "1 hour", 4)
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "t05_rate_window_sliding",
    """SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, greatest(count(*) - 4, 0) AS refused FROM (
        SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2""",
)
def t05_sliding(spark, sf):
    rows = tasks.rate_windows(v.table(spark, sf, "events"), "user_id", "1 hour", 4, "30 minutes")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def full_entries(spark, sf):
    """Activity entries with the fields an answer's events carry."""
    e = F.col("event_id")
    rows = v.activity(spark, sf)
    return rows.select(
        "event_id",
        "kind",
        "task",
        F.when((F.col("event") == "step") & (e % 4 == 0), "token").otherwise(F.col("event")).alias("event"),
        F.repeat(text_of("question ", F.col("user_id"), " "), F.lit(30)).alias("question"),
        F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("conversation_id"),
        (e % 900).alias("ms"),
        (e % 6).alias("found"),
        text_of("code-", e % 3).alias("code"),
        text_of("f", F.col("user_id"), ".pdf").alias("file"),
        (e % 40).alias("chunks"),
    )


@query(
    "t07_activity_projection",
    """SELECT event_id, kind, task, event, COALESCE(CASE WHEN event IN ('queued', 'refused') AND user_id % 4 <> 0 THEN left(repeat('question ' || user_id || ' ', 30), 200) END, 'none') AS question,
        CASE WHEN event = 'step' THEN event_id % 900 ELSE -1 END AS ms, CASE WHEN event = 'start' THEN event_id % 6 ELSE -1 END AS found,
        CASE WHEN event IN ('error', 'failed') THEN 'code-' || (event_id % 3) ELSE 'none' END AS code,
        CASE WHEN kind = 'upload' AND event = 'queued' THEN 'f' || user_id || '.pdf' ELSE 'none' END AS file,
        CASE WHEN event = 'indexing' THEN event_id % 40 ELSE -1 END AS chunks FROM v_activity WHERE NOT (event = 'step' AND event_id % 4 = 0)""",
)
def t07(spark, sf):
    rows = tasks.activity_rows(full_entries(spark, sf))
    texts, counts = ["question", "code", "file"], ["ms", "found", "chunks"]
    return rows.select(
        "event_id",
        "kind",
        "task",
        "event",
        *[F.coalesce(c, F.lit("none")).alias(c) for c in texts],
        *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in counts],
    )


@query(
    "t08_time_to_first",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM {DURATION_SQL} WHERE ms IS NOT NULL GROUP BY 1, 2""",
)
def t08(spark, sf):
    """Latency percentiles per day and step."""
    timed = tasks.step_durations(v.activity(spark, sf))
    rows = tasks.latency_windows(timed, "1 day", accuracy=1_000_000)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event", "n", "p50", "p95")


@query(
    "t08_sketch_rollup",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event, count(*) AS n, count(DISTINCT task) AS ids, true AS within
        FROM {DURATION_SQL} WHERE ms IS NOT NULL GROUP BY 1, 2""",
)
def t08_sketches(spark, sf):
    """Days of step latencies and tasks rolled up from sketches of hours: exact counts, and whether all estimates keep their bounds."""
    timed = tasks.step_durations(v.activity(spark, sf))
    fine = written_once(sketches.hourly(timed, ["event"], "ts", "ms", "task"), "hourly")
    days = sketches.rolled_up(fine, ["event"], "1 day")
    rows = sketches.checked(timed, days, ["event"], "ts", "ms", "task", "1 day", [0.5, 0.95])
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event", "n", "ids", "within")
