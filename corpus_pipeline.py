"""A training corpus from `documents`: clean, without near copies or benchmark items, without
personal data, and mixed to target weights.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
its result is written as Parquet and read again. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontamination, mixing, ngram_join, pii, quality_rules
from scriptorium.llm.columns import read
from scriptorium.session import written_once


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules themselves and by their host."""
    return quality_rules.drop_failing(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group."""
    return ngram_join.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix, and the words they take."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram join", keep_one_of_group),
    ("decontamination", keep_uncontaminated),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]

# No SQL: the field of the fourth stage is trained, the rates of the fifth are iterated.
# tests/llm/test_tools_and_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
