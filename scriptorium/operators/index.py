"""Maintenance of an index table: upserts, replacement, sync, deletes, plans, manifests.

Points are rows; a write is a new table derived from the old one. Each operation
names the keys it touches, so on a partitioned table only those partitions are
rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators.key_filter import split_by_keys

# Fixed value: how many facet values are listed.
FACET_LIMIT = 1000
WEB_KEY = ["url", "ingest_source"]
SLIDES_KEY = ["source_file", "course", "academic_year"]


def facet_counts(points: DataFrame, *keys: str, limit: int = FACET_LIMIT) -> DataFrame:
    """Points per value, the most frequent first."""
    return (
        points.groupBy(*keys)
        .agg(F.count("*").alias("points"))
        .orderBy(F.col("points").desc(), *keys)
        .limit(limit)
    )


def version_counts(points: DataFrame) -> DataFrame:
    """Points per (url, ingest_source); nulls are one group."""
    return points.groupBy(*WEB_KEY).agg(F.count("*").alias("points"))


def keep_last(points: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest `order` per key, without sorting any group."""
    others = [c for c in points.columns if c != key]
    return (
        points.groupBy(key)
        .agg(F.max_by(F.struct(*others), F.col(order)).alias("row"))
        .select(key, "row.*")
        .select(*points.columns)
    )


def repeated_keys(points: DataFrame, key: str) -> DataFrame:
    """Keys that two rows or more have, in a column `key`."""
    return points.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")


def keep_last_where_they_lie(points: DataFrame, key: str, order: str) -> DataFrame:
    """As `keep_last`, for tables in files: only the rows of repeated keys, and a few more, are shuffled."""
    repeated, single = split_by_keys(points, key, repeated_keys(points, key))
    return single.unionByName(keep_last(repeated, key, order))


def upsert_points(
    points: DataFrame, batch: DataFrame, key: str = "point_id", order: str = "seq"
) -> DataFrame:
    """The table after a batch: the last write of an id wins, old rows keep the rest."""
    latest = keep_last(batch, key, order)
    kept = points.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*points.columns))


def _without_predecessors(
    points: DataFrame, batch: DataFrame, on: list[str], id_: str
) -> DataFrame:
    """Points minus those of a source the batch wrote again, unless the batch wrote them."""
    sources = batch.select(*on).distinct().withColumn("touched", F.lit(True))
    written = batch.select(id_).distinct().withColumn("fresh", F.lit(True))
    return (
        points.join(sources, on, "left")
        .join(written, id_, "left")
        .where(F.col("touched").isNull() | F.col("fresh").isNotNull())
        .select(*points.columns)
    )


def replace_versions(
    points: DataFrame, batch: DataFrame, key: str = "point_id", order: str = "seq"
) -> DataFrame:
    """Upsert, then drop what the batch supersedes.

    Web pages are replaced per (url, ingest_source), so crawled and live copies never
    touch each other; decks per (file, course, year).
    """
    after = upsert_points(points, batch, key, order)
    web = _without_predecessors(
        after.where("kind = 'web'"), batch.where("kind = 'web'"), WEB_KEY, key
    )
    slides = _without_predecessors(
        after.where("kind = 'slides'"), batch.where("kind = 'slides'"), SLIDES_KEY, key
    )
    return web.unionByName(slides)


def _source(kind: Column) -> Column:
    """A number for what replaces a point: its page and way of ingest, or its file and edition."""
    return F.when(kind == "web", F.xxhash64(F.lit("web"), *WEB_KEY)).otherwise(F.xxhash64(F.lit("slides"), *SLIDES_KEY))


def upsert_where_they_lie(points: DataFrame, batch: DataFrame, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """(points the batch does not name, as they lie; what `upsert_points` makes of the others)."""
    named, rest = split_by_keys(points, key, batch.select(F.col(key).alias("key")))
    return rest, upsert_points(named, batch, key)


def replace_where_they_lie(points: DataFrame, batch: DataFrame, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """(points whose id and source the batch does not name, as they lie; what `replace_versions` makes of the others)."""
    named, rest = split_by_keys(points, key, batch.select(F.col(key).alias("key")))
    of_source, rest = split_by_keys(rest, _source(F.col("kind")), batch.select(_source(F.col("kind")).alias("key")))
    return rest.where("kind in ('web', 'slides')"), replace_versions(named.unionByName(of_source), batch, key)


def repeated_files(seen: DataFrame) -> DataFrame:
    """Files a run lists twice for one edition: an error before anything is dropped."""
    return (
        seen.groupBy(*SLIDES_KEY).agg(F.count("*").alias("listed")).where("listed > 1")
    )


def sync_editions(points: DataFrame, seen: DataFrame, failed: bool = False) -> DataFrame:
    """Points minus those of files that left an edition seen in a full directory run.

    `seen`: (source_file, course, academic_year). Nothing is dropped when a file failed.
    """
    if failed:
        return points
    editions = seen.select("course", "academic_year").distinct().withColumn("full", F.lit(True))
    files = seen.select(*SLIDES_KEY).distinct().withColumn("present", F.lit(True))
    return (
        points.join(editions, ["course", "academic_year"], "left")
        .join(files, SLIDES_KEY, "left")
        .where(F.col("full").isNull() | F.col("present").isNotNull())
        .select(*points.columns)
    )


def of_material(sha256: str, course: str, year: str) -> Column:
    """Whether a point is of one deck of one edition."""
    return (
        F.col("source_sha256").eqNullSafe(sha256)
        & F.col("course").eqNullSafe(course)
        & F.col("academic_year").eqNullSafe(year)
    )


def of_run(run_id: str) -> Column:
    """Whether a point is of one live run; a crawl run's id names none."""
    return F.col("ingest_run_id").eqNullSafe(run_id) & F.col("ingest_source").eqNullSafe("live")


def delete_material(points: DataFrame, sha256: str, course: str, year: str) -> DataFrame:
    """Points without one deck of one edition."""
    return points.where(~of_material(sha256, course, year))


def delete_run(points: DataFrame, run_id: str) -> DataFrame:
    """Points without one live run; a crawl run's id rolls nothing back."""
    return points.where(~of_run(run_id))


def incremental_plan(
    fetched: DataFrame, latest: DataFrame, counts: DataFrame, carry: Sequence[str] = ()
) -> DataFrame:
    """What to do with each fetched page: (url, ingest_source, action), and columns to carry.

    `fetched`: url, ingest_source, content_hash, relevant, complete; `latest`: url,
    known_hash; `counts`: url, ingest_source, points. A page is skipped only when its
    hash is known and the index still holds its points.
    """
    held = F.coalesce(F.col("points"), F.lit(0)) > 0
    known = F.col("known_hash").isNotNull()
    same = F.col("known_hash") == F.col("content_hash")
    action = (
        F.when(~(F.col("relevant") & F.col("complete")), "ephemeral")
        .when(~known, "first fetch")
        .when(~same, "content changed")
        .when(~held, "reindexed after rollback")
        .otherwise("unchanged")
    )
    return (
        fetched.join(latest.select("url", "known_hash"), "url", "left")
        .join(counts.select(*WEB_KEY, "points"), WEB_KEY, "left")
        .select("url", "ingest_source", *carry, action.alias("action"))
    )


def diff_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two keyed tables side by side: (keys, left_value, right_value, verdict).

    Keys may be null and a null key matches a null key. Rows come back typed so that
    the tables shuffle once each, on the keys.
    """
    shared = [k for k in keys]
    a = left.select(*shared, F.struct(F.col(value).alias("v")).alias("left_side"))
    b = right.select(*shared, F.struct(F.col(value).alias("v")).alias("right_side"))
    a = a.select([F.col(k).alias(f"l_{k}") for k in shared] + ["left_side"])
    b = b.select([F.col(k).alias(f"r_{k}") for k in shared] + ["right_side"])
    condition = F.lit(True)
    for k in shared:
        condition = condition & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    verdict = (
        F.when(F.col("right_side").isNull(), "only left")
        .when(F.col("left_side").isNull(), "only right")
        .when(F.col("left_side.v").eqNullSafe(F.col("right_side.v")), "equal")
        .otherwise("differs")
    )
    chosen = [
        F.when(F.col("left_side").isNotNull(), F.col(f"l_{k}")).otherwise(F.col(f"r_{k}")).alias(k)
        for k in shared
    ]
    return a.join(b, condition, "full_outer").select(
        *chosen,
        F.col("left_side.v").alias("left_value"),
        F.col("right_side.v").alias("right_value"),
        verdict.alias("verdict"),
    )


def fingerprint(rows: DataFrame) -> DataFrame:
    """Order-independent identity of a table: row count and the sum of row hashes."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(
            F.sum(F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")),
            F.lit(0).cast("decimal(38,0)"),
        )
        .cast("string")
        .alias("digest"),
    )


def version_manifest(points: DataFrame) -> DataFrame:
    """Points per version pair with a digest of their ids, to freeze and to compare."""
    number: Column = F.conv(F.substring(F.md5("point_id"), 1, 12), 16, 10).cast("decimal(38,0)")
    return points.groupBy(*WEB_KEY).agg(
        F.count("*").alias("points"), F.sum(number).cast("string").alias("digest")
    )
