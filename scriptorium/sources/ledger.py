"""The fetch ledger: latest rows, snapshots, provenance of a snapshot's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_by_url(ledger: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The last row of each address, by a partial aggregate rather than a sort."""
    others = [c for c in ledger.columns if c != key]
    return (
        ledger.groupBy(key)
        .agg(F.max_by(F.struct(*others), F.col(order)).alias("row"))
        .select(key, "row.*")
        .select(*ledger.columns)
    )


def write_snapshot(pages: DataFrame, path: str) -> DataFrame:
    """Pages of one or more runs, written once, with their manifest.

    A run's folder is written by no one else, and the write refuses to touch an
    existing one.
    """
    pages.write.mode("errorifexists").partitionBy("ingest_run_id").parquet(f"{path}/pages")
    manifest = pages.groupBy("ingest_run_id").agg(
        F.count("*").alias("pages"),
        F.countDistinct("url").alias("urls"),
        F.min("fetch_date").alias("first_fetch"),
        F.max("fetch_date").alias("last_fetch"),
    )
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return pages.sparkSession.read.parquet(f"{path}/manifest")


def manifest_provenance(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each page of a manifest with its latest ledger row; no row is a failure to count."""
    rows = latest_by_url(ledger).select(
        "url", "seq", "section", "ingest_source", "ingest_run_id", "fetch_date"
    )
    return manifest.join(rows, "url", "left").withColumns(
        {
            "status": F.when(F.col("seq").isNotNull(), "parsed").otherwise("no ledger row"),
            "section": F.coalesce("section", F.lit("web")),
        }
    )
