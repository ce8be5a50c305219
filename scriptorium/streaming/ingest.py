"""Live ingest and retained tails: micro-batches into tables, safe to deliver twice.

A batch writes only folders that carry its number, and reads only lower numbers, so
delivering it again rewrites the same folders with the same rows. The index is kept
as a log of batches and read through `current_points`; a write costs its batch, not
the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scriptorium.operators.index import WEB_KEY, incremental_plan, keep_last
from scriptorium.sources.ledger import latest_by_url

FETCH = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("ingest_source", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("relevant", T.BooleanType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)
LEDGER = T.StructType(
    [*FETCH.fields[:4], T.StructField("action", T.StringType()), T.StructField("batch", T.LongType())]
)
POINTS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("ingest_source", T.StringType()),
        T.StructField("point_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)


def _before(spark: SparkSession, path: str, schema: T.StructType, batch: int) -> DataFrame:
    """Rows of the batches before `batch`; empty when there are none yet.

    `batch` is a partition column, so later folders are never listed into the scan.
    """
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(
        F.col("batch") < batch
    )


def current_points(log: DataFrame) -> DataFrame:
    """The index a log of batches amounts to: per (url, source) its latest batch's points.

    A batch that leaves a page without points logs it with a null id, so the points
    before it are not current.
    """
    newest = log.groupBy(*WEB_KEY).agg(F.max("batch").alias("batch"))
    return log.join(newest, [*WEB_KEY, "batch"], "left_semi").where("point_id is not null")


def compact(spark: SparkSession, path: str, into: str, upto: int) -> None:
    """The current index as one base batch in a new folder, which readers switch to."""
    log = _before(spark, f"{path}/points", POINTS, upto + 1)
    current_points(log).withColumn("batch", F.lit(upto).cast("long")).write.mode(
        "errorifexists"
    ).partitionBy("batch").parquet(f"{into}/points")


def paragraphs(pages: DataFrame) -> DataFrame:
    """Default splitter: a point per non-blank line of a page."""
    return pages.select(*WEB_KEY, F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).where(
        F.col("text").rlike(r"\S")
    ).select(
        *WEB_KEY,
        F.md5(F.concat_ws("|", "url", "ingest_source", F.col("i").cast("string"), "text")).alias("point_id"),
        "text",
    )


def ingest_batch(path: str, split: Callable[[DataFrame], DataFrame] = paragraphs):
    """The micro-batch function: plan, index what changed, append to the ledger."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = _before(spark, f"{path}/ledger", LEDGER, number)
        log = _before(spark, f"{path}/points", POINTS, number)
        fetched = keep_last(batch, "url", "seq")
        # only what the batch's addresses have in the ledger and the log is grouped
        asked = fetched.select("url").distinct()
        known = latest_by_url(ledger.where("action <> 'ephemeral'").join(asked, "url", "left_semi")).select(
            "url", F.col("content_hash").alias("known_hash")
        )
        counts = current_points(log.join(asked, "url", "left_semi")).groupBy(*WEB_KEY).agg(F.count("*").alias("points"))
        plan = incremental_plan(
            fetched, known, counts, carry=["seq", "content_hash", "text"]
        ).persist()
        try:
            kept = plan.where(~F.col("action").isin("unchanged", "ephemeral"))
            points = kept.select(*WEB_KEY).distinct().join(split(kept), WEB_KEY, "left")
            points.select(*WEB_KEY, "point_id", "text").write.mode("overwrite").parquet(f"{path}/points/batch={number}")
            plan.select("seq", "url", "ingest_source", "content_hash", "action").write.mode(
                "overwrite"
            ).parquet(f"{path}/ledger/batch={number}")
        finally:
            plan.unpersist()

    return each


def tail_batch(path: str, keep: int, id_: str = "event_id"):
    """The micro-batch function of a retained tail: the newest `keep` entries so far."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema.add("batch", T.LongType()) if "batch" not in batch.columns else batch.schema
        held = _before(spark, path, schema, number).where(F.col("batch") == number - 1).drop("batch")
        merged = held.unionByName(batch).dropDuplicates([id_])
        merged.orderBy(F.col(id_).desc()).limit(keep).write.mode("overwrite").parquet(
            f"{path}/batch={number}"
        )

    return each


def read_after(spark: SparkSession, path: str, after: int, id_: str = "event_id") -> DataFrame:
    """Entries of the newest tail that follow an id, oldest first."""
    tail = spark.read.option("basePath", path).parquet(path)
    newest = tail.select(F.max("batch")).scalar()
    return tail.where((F.col("batch") == newest) & (F.col(id_) > after)).drop("batch").orderBy(id_)
