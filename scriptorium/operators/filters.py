"""Filters whose absent value means "all" and whose impossible value means "nothing"."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def payload_filter(scope: Sequence[tuple[str, str]] | None = None, **equals: str | None) -> Column:
    """The condition of one search branch, for use below the ranking.

    Every named column with a value must hold it. `scope=None` adds nothing, else the
    point's (course, year) must be in it; an empty scope is the literal false, which
    lets the planner drop the scan.
    """
    wanted = [F.col(column).eqNullSafe(value) for column, value in equals.items() if value]
    if scope is not None:
        editions = [F.struct(F.lit(course).alias("course"), F.lit(year).alias("academic_year")) for course, year in scope]
        held = F.struct(F.col("course"), F.col("academic_year"))
        wanted.append(held.isin(*editions) & held["course"].isNotNull() & held["academic_year"].isNotNull() if editions else F.lit(False))
    return reduce(and_, wanted, F.lit(True))


def in_editions(points: DataFrame, editions: DataFrame) -> DataFrame:
    """Points of a table of editions; an empty table lets nothing through."""
    return points.join(editions.select("course", "academic_year").distinct(),
                       ["course", "academic_year"], "left_semi")


def any_of(column: Column, value: str | None, allowed: Sequence[str] | None) -> Column:
    """Equality under a closed set: no value keeps all, a foreign one keeps nothing."""
    if value is None:
        return F.lit(True)
    if allowed is not None and value not in allowed:
        return F.lit(False)
    return column.eqNullSafe(value)


def json_path_is(column: Column, path: str, value: str | None, allowed: Sequence[str]) -> Column:
    return any_of(F.get_json_object(column, path), value, allowed)
