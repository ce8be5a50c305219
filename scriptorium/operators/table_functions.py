"""Generators for SQL: links of a page, shingles of a text, references of an answer."""

from __future__ import annotations

import re

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scriptorium.functions.citations import CODE_PATTERN, EXCERPT_LIST_PATTERN, EXCERPT_PATTERN, NUMBER_PATTERN
from scriptorium.functions.html import links_of
from scriptorium.functions.text import HYPHEN_BREAK_PATTERN, SHINGLE_WORDS
from scriptorium.functions.tokens import WORD_PATTERN

_word = regex.compile(WORD_PATTERN)
_code = re.compile(CODE_PATTERN)
_break = regex.compile(HYPHEN_BREAK_PATTERN)
_reference = re.compile(f"{EXCERPT_LIST_PATTERN}|{NUMBER_PATTERN}|{EXCERPT_PATTERN}", re.ASCII)
_digits = re.compile("[0-9]+")


@udtf(returnType="pos int, dst string, anchor string", useArrow=True)
class PageLinks:
    def eval(self, url: str, html: str):
        for pos, (dst, anchor) in enumerate(links_of(url or "", html or "")):
            yield pos, dst, anchor


@udtf(returnType="shingle string", useArrow=True)
class Shingles:
    def eval(self, text: str):
        found = _word.findall(_break.sub(r"\1\2", text or "").lower())
        spans = max(len(found) - SHINGLE_WORDS + 1, 1 if found else 0)
        for shingle in {" ".join(found[i : i + SHINGLE_WORDS]) for i in range(spans)}:
            yield (shingle,)


@udtf(returnType="number int", useArrow=True)
class CitationRefs:
    def eval(self, answer: str):
        prose = _code.sub(" ", answer or "")
        found = (n for m in _reference.finditer(prose) for n in _digits.findall(m[0]))
        for number in dict.fromkeys(map(int, found)):
            yield (number,)


def register_table_functions(spark: SparkSession) -> None:
    """Makes page_links, shingles and citation_refs callable from SQL with LATERAL."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("shingles", Shingles)
    spark.udtf.register("citation_refs", CitationRefs)
