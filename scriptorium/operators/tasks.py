"""Task streams in batch form: lifecycles, step times, leases, load, rates.

Each is the twin a streaming job is checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How many tasks are shown, and leases and caps in seconds and places.
RECENT_TASKS = 20
QUEUED_LEASE = 120
RUNNING_LEASE = 30
STALLED_AFTER = 30 * 60
CAP = 4
QUESTION_CHARS = 200
FINAL_EVENTS = ("end", "stopped", "error", "refused", "ready", "failed")


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def outcome_of(event: Column) -> Column:
    """The outcome a closing event gives a task, null for any other event."""
    return F.when(event == "end", "answered").when(event.isin(*FINAL_EVENTS), event)


def recent_tasks(entries: DataFrame, tasks: int = RECENT_TASKS) -> DataFrame:
    """All entries of the tasks with the latest entries, whole."""
    latest = (
        entries.groupBy("task")
        .agg(F.max(F.struct("ts", "event_id")).alias("at"))
        .orderBy(F.col("at").desc(), F.col("task"))
        .limit(tasks)
    )
    return entries.join(latest.select("task"), "task", "left_semi")


def task_rows(entries: DataFrame) -> DataFrame:
    """One row per task: (task, kind, began, last, entries, steps, outcome).

    An aggregate, so a task of any length is folded where its entries are. A question
    under way with no closing event is lost, an upload is still running.
    """
    at = F.struct("ts", "event_id")
    closing = outcome_of(F.col("event"))
    return (
        entries.groupBy("task", "kind")
        .agg(
            F.min("ts").alias("began"),
            F.max("ts").alias("last"),
            F.count("*").alias("entries"),
            F.count_if(~F.col("event").isin("queued", *FINAL_EVENTS)).alias("steps"),
            F.max_by(closing, F.when(closing.isNotNull(), at)).alias("closing"),
        )
        .withColumn(
            "outcome",
            F.coalesce("closing", F.when(F.col("kind") == "question", "lost").otherwise("running")),
        )
        .drop("closing")
    )


def step_durations(entries: DataFrame) -> DataFrame:
    """Each entry with the time until its task's next one, null for the last."""
    order = Window.partitionBy("task").orderBy("ts", "event_id")
    after = F.lead("ts").over(order)
    return entries.withColumn("ms", F.floor(micros(F.col("ts"), after) / 1000).cast("long"))


def listed_tasks(tasks: DataFrame) -> DataFrame:
    """All tasks as the page lists them: running newest first, then last over first.

    A range-partitioned sort with the keys as columns; no task numbers all the others.
    """
    running = F.col("outcome") == "running"
    keyed = tasks.withColumn("running", running).withColumn("since", F.when(running, F.col("began")))
    return keyed.orderBy(
        F.col("running").desc(), F.col("since").desc_nulls_last(), F.col("last").desc(), F.col("task").asc()
    )


def lease_state(entries: DataFrame, now: Column) -> DataFrame:
    """Per task, whether its lease held until `now`: done, running, untaken, dead, interrupted.

    A queued task is untaken after its queue lease, a taken question dead after the
    running lease, an upload interrupted after the stall limit.
    """
    folded = entries.groupBy("task", "kind").agg(
        F.max("ts").alias("last"),
        F.count("*").alias("entries"),
        F.bool_or(outcome_of(F.col("event")).isNotNull()).alias("closed"),
    )
    idle = micros(F.col("last"), now) / 1_000_000
    state = (
        F.when(F.col("closed"), "done")
        .when((F.col("kind") == "upload") & (idle > STALLED_AFTER), "interrupted")
        .when((F.col("kind") == "question") & (F.col("entries") == 1) & (idle > QUEUED_LEASE), "untaken")
        .when((F.col("kind") == "question") & (F.col("entries") > 1) & (idle > RUNNING_LEASE), "dead")
        .otherwise("running")
    )
    return folded.select("task", "kind", state.alias("state"))


def lease_breaks(entries: DataFrame, gap_seconds: int) -> DataFrame:
    """Runs of a task's entries with no pause above the gap: (task, part, began, ended, entries).

    A pause above the lease means the holder was dead in between; the batch twin of a
    session window.
    """
    order = Window.partitionBy("task").orderBy("ts", "event_id")
    pause = micros(F.lag("ts").over(order), F.col("ts")) / 1_000_000
    broken = F.when(pause >= gap_seconds, 1).otherwise(0)
    return (
        entries.withColumn("broken", F.coalesce(broken, F.lit(0)))
        .withColumn("part", F.sum("broken").over(order))
        .groupBy("task", "part")
        .agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("entries"))
    )


def concurrency(tasks: DataFrame, tenant: str, cap: int = CAP) -> DataFrame:
    """Load over event time per tenant and day: (tenant, day, ts, change, running, over_cap).

    Starts count +1 and ends -1; at one instant ends free their places first. The
    running sum is taken in two steps, over a day's minutes and inside each minute,
    so a tenant with any traffic is as many tasks as it has minutes.
    """
    edges = tasks.select(
        tenant,
        "day",
        F.explode(
            F.array(
                F.struct(F.col("began").alias("ts"), F.lit(1).alias("change")),
                F.struct(F.col("last").alias("ts"), F.lit(-1).alias("change")),
            )
        ).alias("edge"),
    ).select(tenant, "day", "edge.ts", "edge.change", F.date_trunc("minute", "edge.ts").alias("minute"))
    changes = edges.groupBy(tenant, "day", "minute", "ts", "change").agg(F.count("*").alias("n"))
    moved = F.sum(F.col("n") * F.col("change"))
    earlier = (
        Window.partitionBy(tenant, "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        changes.groupBy(tenant, "day", "minute")
        .agg(moved.alias("net"))
        .select(tenant, "day", "minute", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("carried"))
    )
    inside = (
        Window.partitionBy(tenant, "day", "minute")
        .orderBy("ts", "change")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        changes.withColumn("within", moved.over(inside))
        .join(carried, [tenant, "day", "minute"])
        .withColumn("running", F.col("carried") + F.col("within"))
        .withColumn("over_cap", F.greatest(F.col("running") - cap, F.lit(0)))
        .drop("minute", "within", "carried")
    )


def rate_windows(events: DataFrame, caller: str, width: str, limit: int, slide: str | None = None) -> DataFrame:
    """Events per caller and window against a limit: (caller, window_start, events, refused)."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(caller, frame.alias("w")).agg(F.count("*").alias("events")).select(
        caller,
        F.col("w.start").alias("window_start"),
        "events",
        F.greatest(F.col("events") - limit, F.lit(0)).alias("refused"),
    )


def activity_rows(entries: DataFrame) -> DataFrame:
    """Answer events as activity rows: tokens dropped, a visitor's question nulled, text cut.

    Stateless, so the same on a stream. `entries`: event_id, kind, task, event,
    question, conversation_id, ms, found, code, file, chunks.
    """
    event = F.col("event")
    signed_in = F.col("conversation_id").isNotNull()
    return entries.where(event != "token").select(
        "event_id",
        "kind",
        "task",
        "event",
        F.when(signed_in & event.isin("queued", "refused"), F.left("question", F.lit(QUESTION_CHARS))).alias("question"),
        F.when(event == "step", F.col("ms")).alias("ms"),
        F.when(event == "start", F.col("found")).alias("found"),
        F.when(event.isin("error", "failed"), F.col("code")).alias("code"),
        F.when((F.col("kind") == "upload") & (event == "queued"), F.col("file")).alias("file"),
        F.when(event == "indexing", F.col("chunks")).alias("chunks"),
    )


def latency_windows(steps: DataFrame, width: str, accuracy: int = 10000) -> DataFrame:
    """Latency per window and step: (window_start, event, n, p50, p95)."""
    return (
        steps.where("ms is not null")
        .groupBy(F.window("ts", width).alias("w"), "event")
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("ms", 0.5, accuracy).alias("p50"),
            F.percentile_approx("ms", 0.95, accuracy).alias("p95"),
        )
        .select(F.col("w.start").alias("window_start"), "event", "n", "p50", "p95")
    )
