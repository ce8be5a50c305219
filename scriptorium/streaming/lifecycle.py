"""Stateful task streams: lifecycles with leases, and admission under a cap."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators.tasks import CAP, FINAL_EVENTS, RUNNING_LEASE, STALLED_AFTER

# times are microseconds since 1970 inside the processors
TASK_ROW = "task string, kind string, began long, last long, entries long, steps long, outcome string"
TASK_FOLD = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("began", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("entries", T.LongType()),
        T.StructField("steps", T.LongType()),
        T.StructField("outcome", T.StringType()),
    ]
)
FOLD = T.StructType([T.StructField("tasks", T.ArrayType(TASK_FOLD)), T.StructField("timer", T.LongType())])
# A state's calls are messages to the JVM: tasks share one by their hash, so these grow with buckets, not with tasks.
BUCKETS = 2048
NOT_STEPS = ("queued", *FINAL_EVENTS)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """Rows by (at, event_id), nulls last."""
    return sorted(rows, key=lambda r: (r.at is None, r.at or 0, r.event_id is None, r.event_id or 0))


class TaskLifecycle(StatefulProcessor):
    """Folds a task's entries into one row, emitted when it closes or its lease runs out.

    State is one value a bucket, with a small entry per open task. A closed task stays as a tombstone until
    the watermark passes its lease, so a late entry does not open it again. A bucket has a timer for the first of
    its leases; where that has moved on, it is set anew.
    """

    def __init__(self, question_lease: int = RUNNING_LEASE, upload_lease: int = STALLED_AFTER):
        self.leases = {"question": question_lease, "upload": upload_lease}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", FOLD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        folds, timer = self._held()
        by_task: dict[str | None, list[Row]] = {}
        for row in rows:
            by_task.setdefault(row.task, []).append(row)
        out, first = [], timer
        for task, own in by_task.items():
            kind, began, last, entries, steps, outcome = folds.get(task) or (None, None, None, 0, 0, None)
            if outcome is not None:
                continue
            for row in _in_order(own):
                kind = kind or row.kind
                began = row.at if began is None else min(began, row.at)
                last = row.at if last is None else max(last, row.at)
                entries += 1
                if row.event not in NOT_STEPS:
                    steps += 1
                if row.event in FINAL_EVENTS:
                    outcome = "answered" if row.event == "end" else row.event
            folds[task] = (kind, began, last, entries, steps, outcome)
            due = self._due(kind, last)
            first = due if first is None else min(first, due)
            if outcome is not None:
                out.append(self._row(task, kind, began, last, entries, steps, outcome))
        if first != timer:
            self.handle.registerTimer(first)
        self._keep(folds, first)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        folds, timer = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        if timer is None or timer > now:  # one that an earlier lease has replaced
            return iter(())
        out, left, first = [], {}, None
        for task, held in folds.items():
            kind, began, last, entries, steps, outcome = held
            due = self._due(kind, last)
            if due > now:
                left[task] = held
                first = due if first is None else min(first, due)
            elif outcome is None:
                name = "lost" if kind == "question" else "interrupted"
                out.append(self._row(task, kind, began, last, entries, steps, name))
        if first is not None:
            self.handle.registerTimer(first)
        self._keep(left, first)
        return iter(out)

    def _held(self) -> tuple[dict, int | None]:
        """(fold of each task, the timer set last)."""
        held = self.fold.get()
        return ({}, None) if held is None else ({task: tuple(fold) for task, *fold in held[0]}, held[1])

    def _keep(self, folds: dict, timer: int | None) -> None:
        if folds:
            self.fold.update(([(task, *fold) for task, fold in folds.items()], timer))
        else:
            self.fold.clear()

    def _due(self, kind: str, last: int) -> int:
        """Milliseconds from which the task's lease has run out."""
        return last // 1000 + self.leases[kind] * 1000

    @staticmethod
    def _row(task, kind, began, last, entries, steps, outcome) -> Row:
        return Row(task=task, kind=kind, began=began, last=last, entries=entries, steps=steps, outcome=outcome)

    def close(self) -> None:
        pass


def task_lifecycles(
    entries: DataFrame,
    late: str = "1 hour",
    question_lease: int = RUNNING_LEASE,
    upload_lease: int = STALLED_AFTER,
    buckets: int = BUCKETS,
) -> DataFrame:
    """A stream of entries (task, kind, event_id, ts, event) -> a stream of task rows.

    `buckets` stays as it is for a stream's life.
    """
    rows = (
        entries.withWatermark("ts", late)
        .select("task", "kind", "event_id", "event", "ts", F.unix_micros("ts").alias("at"))
        .withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets)))
        .groupBy("bucket")
        .transformWithState(
            statefulProcessor=TaskLifecycle(question_lease, upload_lease),
            outputStructType=T.StructType.fromDDL(TASK_ROW),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    times = {c: F.timestamp_micros(c) for c in ("began", "last")}
    return rows.withColumns(times)


ADMISSION_ROW = "tenant string, task string, ts long, verdict string, running long"


class Admission(StatefulProcessor):
    """Admits a tenant's tasks while places are free: an end or a run-out lease frees one.

    State is at most `cap` leases per tenant, whatever the tenant's traffic. Within a trigger a
    tenant's rows go by (ts, event_id); there is no watermark, so a row that comes in a
    later trigger is taken then, at its own time, and changes no verdict already given.
    """

    def __init__(self, cap: int = CAP, lease: int = RUNNING_LEASE):
        self.cap, self.lease = cap, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState(
            "places",
            T.StructType([T.StructField("task", T.StringType())]),
            T.StructType([T.StructField("until", T.LongType())]),
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.places.iterator()}
        until = dict(held)
        out = []
        for row in _in_order(rows):
            now = row.at
            for task in [task for task, end in until.items() if end <= now]:
                del until[task]
            if row.event == "queued":
                verdict = "admitted" if len(until) < self.cap else "refused"
                if verdict == "admitted":
                    until[row.task] = now + self.lease * 1_000_000
                out.append(Row(tenant=key[0], task=row.task, ts=now, verdict=verdict, running=len(until)))
            elif row.event in FINAL_EVENTS:
                until.pop(row.task, None)
            elif row.task in until:
                until[row.task] = now + self.lease * 1_000_000
        for task in held.keys() - until.keys():
            self.places.removeKey((task,))
        for task, end in until.items():
            if held.get(task) != end:
                self.places.updateValue((task,), (end,))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def admissions(entries: DataFrame, cap: int = CAP, lease: int = RUNNING_LEASE) -> DataFrame:
    """A stream of entries with a `tenant` -> one verdict per queued task.

    The cap is one tenant's, so tenants run apart; within one, places are handed out
    in order by definition.
    """
    rows = (
        entries.select("tenant", "task", "event_id", "event", F.unix_micros("ts").alias("at"))
        .groupBy("tenant")
        .transformWithState(
            statefulProcessor=Admission(cap, lease),
            outputStructType=T.StructType.fromDDL(ADMISSION_ROW),
            outputMode="Append",
            timeMode="None",
        )
    )
    return rows.withColumn("ts", F.timestamp_micros("ts"))
