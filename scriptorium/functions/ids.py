"""Identifiers: edition keys, chunk ids, point ids, digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

# The key formats of the data model.
ACADEMIC_YEAR_PATTERN = r"^(\d{4})-(\d{4})$"
COURSE_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
SHA_PREFIX = 16
INDEX_DIGITS = 4
ARTIFACT_PREFIX = 16


def edition_key(value: Column) -> Column:
    """`CODE:YEAR` as a struct (course, academic_year), null when it is not one."""
    parts = F.split(value, ":", -1)
    course, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    valid = (
        (F.size(parts) == 2)
        & course.rlike(COURSE_PATTERN)
        & consecutive_years(year)
    )
    return F.when(
        valid, F.struct(course.alias("course"), year.alias("academic_year"))
    )


def consecutive_years(value: Column) -> Column:
    """Whether an academic year names two consecutive years; false, never null, for junk."""
    first = F.regexp_extract(value, ACADEMIC_YEAR_PATTERN, 1).try_cast("int")
    second = F.regexp_extract(value, ACADEMIC_YEAR_PATTERN, 2).try_cast("int")
    return F.coalesce(second == first + 1, F.lit(False))


def chunk_id(
    course: Column, year: Column, sha256: Column, variant: Column, index: Column
) -> Column:
    """`[course:year:]sha16:variant:0000`; the edition prefix only when there is a year."""
    prefix = F.when(year.isNotNull(), F.concat(course, F.lit(":"), year))
    number = index.cast("string")
    padded = F.when(
        F.length(number) < INDEX_DIGITS, F.lpad(number, INDEX_DIGITS, "0")
    ).otherwise(number)
    return F.concat_ws(":", prefix, F.left(sha256, F.lit(SHA_PREFIX)), variant, padded)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version-5 UUID of `name`, computed in the JVM."""
    head = F.unhex(F.lit(namespace.hex))
    digest = F.sha1(F.concat(head, F.encode(name, "UTF-8")))
    variant_nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(variant_nibble.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def artifact_name(url: Column) -> Column:
    """File stem of a fetched page: the first 16 hex digits of its address's sha256."""
    return F.left(F.sha2(url, 256), F.lit(ARTIFACT_PREFIX))
