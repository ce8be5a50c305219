"""Address functions: parts, scope, content class, edition years, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.tokens import let

# What an address is split by.
HOST_PATTERN = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH_PATTERN = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)"
SCHEME_PATTERN = r"(?i)^https?://"
# Characters an address may keep as they are.
SAFE_CHARACTER_PATTERN = r"^[A-Za-z0-9_.~/:?#@!$&'()*+,;=%-]$"
# Extensions never followed.
SKIPPED_EXTENSIONS = (".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".rtf", ".odt", ".zip")
# How a file name writes an edition.
YEAR_PATTERN = r"(?<!\d)(20\d{2})(?!\d)"
LONG_RANGE_PATTERN = r"(?<!\d)20(\d{2})[-_]20(\d{2})(?!\d)"
SHORT_RANGE_PATTERN = r"(?<!\d)(?:20)?(\d{2})[-_](\d{2})(?!\d)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_PATTERN, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH_PATTERN, 1)


def is_http(url: Column) -> Column:
    return url.rlike(SCHEME_PATTERN)


def in_scope(pages: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Each row with the first rule that covers it, null when none does.

    `rules`: (rule_order, host, path_prefix, section). The join is an equi-join on
    the host; the planner broadcasts the rules when they are small and splits a
    hot host otherwise.
    """
    parted = pages.select(
        key,
        url,
        F.when(is_http(F.col(url)), host_of(F.col(url))).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    matched = parted.join(
        rules.withColumnRenamed("host", "rule_host"),
        (F.col("host") == F.col("rule_host")) & F.startswith(F.col("path"), F.col("path_prefix")),
    )
    first = matched.groupBy(key).agg(
        F.min(F.struct("rule_order", "path_prefix", "section")).alias("rule")
    )
    return pages.select(key, url).join(first, key, "left").select(
        key,
        url,
        F.col("rule.rule_order").alias("rule_order"),
        F.col("rule.path_prefix").alias("path_prefix"),
        F.col("rule.section").alias("section"),
    )


def is_pdf(url: Column, content_type: Column) -> Column:
    return F.contains(content_type, F.lit("pdf")) | F.endswith(F.lower(url), F.lit(".pdf"))


def has_skipped_extension(url: Column) -> Column:
    low = F.lower(path_of(url))
    hit = F.lit(False)
    for extension in SKIPPED_EXTENSIONS:
        hit = hit | F.endswith(low, F.lit(extension))
    return hit


def content_class(url: Column, content_type: Column) -> Column:
    """pdf, skipped (an office file), unsupported (other binary) or html."""
    binary = F.startswith(content_type, F.lit("application/")) & ~F.contains(
        content_type, F.lit("html")
    )
    return (
        F.when(has_skipped_extension(url), "skipped")
        .when(is_pdf(url, content_type), "pdf")
        .when(binary, "unsupported")
        .otherwise("html")
    )


def sitemap_urls(xml: Column) -> Column:
    """Every address a sitemap lists, read leniently."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>(.*?)</loc>"), 1)
    return F.filter(F.transform(found, lambda u: F.btrim(u)), lambda u: u != "")


def inert_url(url: Column) -> Column:
    """Percent-encodes every character an address may not hold; `%` is kept."""
    return F.array_join(
        F.transform(
            F.split(url, ""),
            lambda c: F.when(c.rlike(SAFE_CHARACTER_PATTERN), c).otherwise(
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )


def last_segment(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)/*$", 1)


def edition_year(url: Column) -> Column:
    """The newest year the last segment names; a range counts when its years follow."""
    raw = last_segment(url)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)

    def ranges(segment: Column, pattern: str) -> Column:
        pairs = F.arrays_zip(
            F.regexp_extract_all(segment, F.lit(pattern), 1).alias("a"),
            F.regexp_extract_all(segment, F.lit(pattern), 2).alias("b"),
        )
        follows = F.filter(
            pairs,
            lambda p: p["b"].cast("int") == (p["a"].cast("int") + 1) % 100,
        )
        return F.transform(follows, lambda p: p["b"].cast("int") + 2000)

    def newest(segment: Column) -> Column:
        plain = F.transform(
            F.regexp_extract_all(segment, F.lit(YEAR_PATTERN), 1), lambda y: y.cast("int")
        )
        return F.array_max(
            F.concat(
                plain,
                ranges(segment, LONG_RANGE_PATTERN),
                ranges(segment, SHORT_RANGE_PATTERN),
            )
        )

    return let(decoded, newest)


def ranking_text(anchor: Column, url: Column) -> Column:
    """What a link is scored on: its anchor and path, a PDF's file name once more."""
    path = path_of(url)
    file_name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(
        is_pdf(url, F.lit("")), F.concat_ws(" ", anchor, file_name, path)
    ).otherwise(F.concat_ws(" ", anchor, path))


def bare_host(url: Column) -> Column:
    """The host a reader recognises, without `www.`."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", host).otherwise(url)


def source_title(heading: Column, kind: Column, url: Column, source_file: Column) -> Column:
    """First heading, else host and path, else the file."""
    path = path_of(url)
    page = F.concat(bare_host(url), F.when(path == "/", "").otherwise(path))
    return F.coalesce(
        F.nullif(F.trim(heading), F.lit("")),
        F.when((kind == "web") & url.isNotNull(), page),
        source_file,
    )


def source_marker(
    kind: Column, url: Column, fetch_date: Column, source_file: Column, page: Column
) -> Column:
    """`[url · date]` for a web page, `[file p.N]` for a slide deck."""
    web = F.concat(
        F.lit("["),
        inert_url(url),
        F.coalesce(F.concat(F.lit(" · "), fetch_date), F.lit("")),
        F.lit("]"),
    )
    slide = F.concat(F.lit("["), source_file, F.lit(" p."), page.cast("string"), F.lit("]"))
    return F.when((kind == "web") & url.isNotNull(), web).otherwise(slide)
