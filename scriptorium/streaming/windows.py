"""Windowed and stateless streams; each shares its rule with its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.operators import tasks


def rate_windows(
    events: DataFrame, caller: str, width: str, limit: int, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Events per caller and window on a stream; a window is emitted once it is closed."""
    return tasks.rate_windows(events.withWatermark("ts", late), caller, width, limit, slide)


def session_leases(entries: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Unbroken runs of each task's entries: sessions that end after a silent gap."""
    return (
        entries.withWatermark("ts", late)
        .groupBy("task", F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("entries"))
        .select("task", "began", "ended", "entries")
    )


def latency_windows(steps: DataFrame, width: str, late: str = "1 hour", accuracy: int = 10000) -> DataFrame:
    """Latency percentiles per window and step, on a stream of timed steps."""
    return tasks.latency_windows(steps.withWatermark("ts", late), width, accuracy)


def activity_rows(entries: DataFrame) -> DataFrame:
    return tasks.activity_rows(entries)


def closed_before(rows: DataFrame, end: Column, watermark: Column) -> DataFrame:
    """The rows of a batch twin that a stream has emitted when its watermark is `watermark`."""
    return rows.where(end <= watermark)


class CountedWindows:
    """Events per caller and window, where late ones are counted and not just dropped.

    A micro-batch becomes one folder of partial sums by (caller, window, late). The watermark
    of a batch is the greatest event time of all batches before it, less `late`; an event
    whose window has ended by then is late. A batch reads lower numbers and writes its own, so
    delivered again it changes nothing; sums are made before the shuffle, so a busy caller
    is a few rows. Every event is in one sum: kept and late ones together are what was sent.
    """

    def __init__(self, spark: SparkSession, path: str, caller: str, width: str, limit: int, late: str = "10 minutes"):
        self.spark, self.path, self.caller, self.width, self.limit, self.late = spark, path, caller, width, limit, late

    def _parts(self, before: int | None = None) -> DataFrame | None:
        if before == 0:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/n_batch=*")
        return rows if before is None else rows.where(F.col("n_batch") < before)

    def _watermark(self, before: int | None = None):
        parts = self._parts(before)
        last = None if parts is None else parts.agg(F.unix_micros(F.max("last"))).first()[0]
        return F.timestamp_micros(F.lit(last).cast("long")) - F.expr(f"interval {self.late}")

    def add(self, rows: DataFrame, number: int) -> None:
        """One micro-batch, by its number: the function a stream's `foreachBatch` takes."""
        is_late = F.coalesce(F.col("w.end") <= self._watermark(number), F.lit(False))
        placed = rows.select(self.caller, "ts", F.window("ts", self.width).alias("w"))
        sums = placed.groupBy(self.caller, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), is_late.alias("late"))
        sums.agg(F.count("*").alias("n"), F.max("ts").alias("last")).write.mode("overwrite").parquet(f"{self.path}/n_batch={number}")

    def totals(self) -> DataFrame:
        """(caller, kept, late) over all batches."""
        kept, late = (F.coalesce(F.sum(F.when(F.col("late") == x, F.col("n"))), F.lit(0)) for x in (False, True))
        return self._parts().groupBy(self.caller).agg(kept.alias("kept"), late.alias("late"))

    def windows(self) -> DataFrame:
        """(caller, window_start, events, refused, late) of the windows the last watermark has closed."""
        kept, late = (F.coalesce(F.sum(F.when(F.col("late") == x, F.col("n"))), F.lit(0)) for x in (False, True))
        closed = self._parts().where(F.col("window_end") <= self._watermark())
        summed = closed.groupBy(self.caller, "window_start").agg(kept.alias("events"), late.alias("late"))
        return summed.select(
            self.caller, "window_start", "events", F.greatest(F.col("events") - self.limit, F.lit(0)).alias("refused"), "late"
        )
