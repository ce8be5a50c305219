"""The registered queries of the subpackage and, where SQL can say it, their SQL twins.

Every query applies its operator to a whole table with the operator's own defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import sql
from scriptorium.llm.columns import read
from scriptorium.llm.decontamination import matches
from scriptorium.llm.language_id import language_id
from scriptorium.llm.license_scan import license_scan
from scriptorium.llm.lm_scoring import lm_scores
from scriptorium.llm.mixing import mix
from scriptorium.llm.ngram_join import ngram_join
from scriptorium.llm.pii import pii_report
from scriptorium.llm.quality_classifier import quality_classifier
from scriptorium.llm.quality_rules import quality_rules
from scriptorium.llm.spelling_variants import spelling_variants
from scriptorium.llm.token_alignment import token_alignment
from scriptorium.llm.tool_calls import SCHEMAS, as_tool_messages, link_tool_calls, parse
from scriptorium.llm.url_filters import url_filters

Run = Callable[[SparkSession, str], DataFrame]


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as tool calls, linked with their results, ordered and checked."""
    calls, results = parse(as_tool_messages(read(spark, sf_dir, "conversations")))
    return link_tool_calls(calls, results, SCHEMAS)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return ngram_join(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern spans, their digest, and the field's spans too."""
    return pii_report(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds, with the best window."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("digest")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the corpus' word pairs, and under single words."""
    return lm_scores(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and mined verdicts on every page's url."""
    return url_filters(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed to target weights."""
    return mix(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text counts, base failure and host-level verdict of every document."""
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and call of every document."""
    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return license_scan(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its more frequent form one edit away, and the last form."""
    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return token_alignment(read(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Run] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_ngram_join": op2_ngram_join,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_url_filters": op6_url_filters,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": sql.OP2,
    "op4_decontamination": sql.OP4,
    "op8_quality_rules": sql.OP8,
    "op10_license_scan": sql.OP10,
}
