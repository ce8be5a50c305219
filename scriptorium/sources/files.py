"""Folders as tables: listings, sidecars, batch admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The limits of an upload.
MAX_BYTES = 50 * 1024 * 1024
MAX_PAGES = 300
SIDECAR_SUFFIX = ".meta.json"
DOCUMENT_SUFFIX = ".json"


def directory_scan(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Files below `root` whose name ends in `suffix`, whatever its case: (path, name, bytes).

    Only the listing is read, never the contents.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    return listed.select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.col("length").alias("bytes"),
    ).where(F.endswith(F.lower("name"), F.lit(suffix.lower())))


def sidecar_pairing(paths: DataFrame) -> DataFrame:
    """Each document path with whether its sidecar is there, and sidecars on their own.

    (stem, status): paired, no sidecar, no document.
    """
    is_sidecar = F.endswith("path", F.lit(SIDECAR_SUFFIX))
    stem = F.regexp_replace("path", r"(\.meta)?\.json$", "")
    return (
        paths.where(F.endswith("path", F.lit(DOCUMENT_SUFFIX)))
        .groupBy(stem.alias("stem"))
        .agg(
            F.bool_or(~is_sidecar).alias("document"),
            F.bool_or(is_sidecar).alias("sidecar"),
        )
        .select(
            "stem",
            F.when(F.col("document") & F.col("sidecar"), "paired")
            .when(F.col("document"), "no sidecar")
            .otherwise("no document")
            .alias("status"),
        )
    )


def batch_admission(uploads: DataFrame, held: DataFrame) -> DataFrame:
    """One verdict per file of each batch: (batch, file, verdict).

    A batch is admitted whole or not at all: one refused file, or one name given
    twice, holds back the others. Bytes an edition has already are skipped.
    `uploads`: batch, edition, file_id, name, sha256, bytes, pages, signed.
    """
    refusal = (
        F.when(F.col("bytes") > MAX_BYTES, "oversize")
        .when(~F.col("signed"), "no signature")
        .when(F.col("pages") > MAX_PAGES, "too many pages")
    )
    judged = uploads.withColumn("refusal", refusal)
    twice = (
        judged.groupBy("batch", "name").agg(F.count("*").alias("n")).where("n > 1")
    ).select("batch", "name", F.lit(True).alias("repeated"))
    marked = judged.join(twice, ["batch", "name"], "left").withColumn(
        "refusal", F.coalesce("refusal", F.when(F.col("repeated"), "repeated name"))
    )
    blocked = (
        marked.where("refusal is not null").select("batch").distinct().withColumn("held_back", F.lit(True))
    )
    known = held.select("edition", "sha256").distinct().withColumn("known", F.lit(True))
    # The same bytes twice in one batch are one material: the first name takes the place.
    first = marked.groupBy("batch", "edition", "sha256").agg(F.min("name").alias("first_name"))
    verdict = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("held_back"), "held back")
        .when(F.col("known") | (F.col("name") != F.col("first_name")), "skipped")
        .otherwise("queued")
    )
    return (
        marked.join(first, ["batch", "edition", "sha256"])
        .join(blocked, "batch", "left")
        .join(known, ["edition", "sha256"], "left")
        .select("batch", "file_id", "name", verdict.alias("verdict"))
    )
