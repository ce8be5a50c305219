"""Samples for labelled sets: page texts regrouped, strata with quotas, cycles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Usable page lengths and the cycle of question languages.
MIN_PAGE_CHARS = 300
MAX_PAGE_CHARS = 4000
LOCALE_CYCLE = ("it", "en", "zh", "it", "en")
EXCLUDED = ("awstats.",)
SALTS = 64


def page_regroup(chunks: DataFrame) -> DataFrame:
    """Web chunks back to page texts: (url, section, text), cut at the page limit.

    A chunk takes at least one character with its line break, so only an address's
    first MAX_PAGE_CHARS chunks can show. They are picked in two steps, per salt and
    then per address, so an address with any number of chunks fills no task.
    """
    web = chunks.where("kind = 'web' and url is not null").select(
        "url",
        F.coalesce("section", F.lit("web")).alias("section"),
        "row_key",
        "text",
        F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).alias("salt"),
    )
    salted = Window.partitionBy("url", "section", "salt").orderBy("row_key")
    order = Window.partitionBy("url", "section").orderBy("row_key")
    near = (
        web.withColumn("place", F.row_number().over(salted))
        .where(F.col("place") <= MAX_PAGE_CHARS)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= MAX_PAGE_CHARS)
    )
    before = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        near.withColumn("before", F.coalesce(before, F.lit(0)))
        .where(F.col("before") < MAX_PAGE_CHARS)
        .groupBy("url", "section")
        .agg(F.array_sort(F.collect_list(F.struct("row_key", "text"))).alias("parts"))
        .select(
            "url",
            "section",
            F.left(F.array_join(F.col("parts.text"), "\n"), F.lit(MAX_PAGE_CHARS)).alias("text"),
        )
    )


def seeded(seed: int, key: str):
    """A draw order fixed by the seed and the key alone."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key)), 256)


def stratified_sample(
    pages: DataFrame, quota: Mapping[str, int], seed: int, key: str = "url", stratum: str = "section"
) -> DataFrame:
    """Up to a quota of usable pages per stratum, the same for a seed in any order of rows."""
    usable = F.length("text") >= MIN_PAGE_CHARS
    for pattern in EXCLUDED:
        usable = usable & ~F.contains(F.col(key), F.lit(pattern))
    wanted = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    draw = Window.partitionBy(stratum).orderBy("draw", key)
    return (
        pages.where(usable)
        .where(F.col(stratum).isin(*quota))
        .withColumn("draw", seeded(seed, key))
        .withColumn("place", F.row_number().over(draw))
        .where(F.col("place") <= max(quota.values()))
        .where(F.col("place") <= F.try_element_at(wanted, F.col(stratum)))
        .withColumn("place", F.col("place").cast("long"))
        .drop("draw")
    )


def short_strata(pages: DataFrame, quota: Mapping[str, int], stratum: str = "section") -> DataFrame:
    """Strata with fewer usable pages than their quota: (section, usable, wanted)."""
    usable = pages.where(F.length("text") >= MIN_PAGE_CHARS)
    wanted = F.create_map(*[F.lit(x) for pair in quota.items() for x in pair])
    return (
        usable.where(F.col(stratum).isin(*quota))
        .groupBy(stratum)
        .agg(F.count("*").alias("usable"))
        .withColumn("wanted", F.try_element_at(wanted, F.col(stratum)))
        .where("usable < wanted")
    )


def sample_with_minimum(
    candidates: DataFrame, total: int, minimum: int, kind: str, seed: int, key: str = "url"
) -> DataFrame:
    """`total` candidates of which at least `minimum` of one kind, where there are that many.

    Two top-k cuts: the minimum of the kind, then the rest of the other kind.
    """
    drawn = candidates.withColumn("draw", seeded(seed, key))
    special = drawn.where(F.col(kind)).orderBy("draw", key).limit(minimum)
    rest = drawn.where(~F.col(kind)).orderBy("draw", key).limit(total)
    place = Window.orderBy(F.col(kind).desc(), "draw", key)
    both = special.unionByName(rest).withColumn("place", F.row_number().over(place))
    return both.where(F.col("place") <= total).drop("draw", "place")


def locale_cycle(
    rows: DataFrame, order: Sequence[str], cycle: Sequence[str] = LOCALE_CYCLE, prefix: str = "c"
) -> DataFrame:
    """A sample's n-th row gets the n-th language of the cycle and the id `c00n`, longer where n is.

    A sample is a quota's worth of rows, small by construction.
    """
    place = F.row_number().over(Window.orderBy(*order))
    languages = F.array(*[F.lit(x) for x in cycle])
    return (
        rows.withColumn("n", place)
        .withColumn("locale", F.element_at(languages, (F.col("n") - 1) % len(cycle) + 1))
        .withColumn("id", F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 3, "0"), F.substring(F.col("n").cast("string"), 4, 20)))
        .drop("n")
    )
