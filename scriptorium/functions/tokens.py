"""Word tokens shared by ranking, resemblance and encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: a word is a run of letters, digits and underscores in any script.
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    A lambda variable holds it, so a body that reads it per element does not
    recompute it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
