"""JSON lines in and out: strict and tolerant reads, appends, frozen writes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scriptorium.operators.index import fingerprint

CORRUPT = "_corrupt_line"


def read_strict(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    required: list[str] | None = None,
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Typed rows of a JSONL file or folder.

    Blank lines are skipped, a malformed line or a missing required field fails the
    job, and a missing optional field takes its default.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required or []:
        problem = F.raise_error(F.lit(f"a line has no {name}")).cast(schema[name].dataType)
        rows = rows.withColumn(name, F.coalesce(F.col(name), problem))
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value))
    return rows


def read_tolerant(
    spark: SparkSession, path: str, schema: T.StructType, required: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines): a damaged ledger loses its damaged lines only.

    Lines are read as text, so both results come from plain scans and nothing is cached.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select(
        "value",
        F.from_json(
            "value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        ).alias("row"),
    )
    bad = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    for name in required:
        bad = bad | F.col(f"row.{name}").isNull()
    good = parsed.where(~bad).select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema])
    return good, parsed.where(bad).select(F.col("value").alias("line"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append-only write of ledger or decision rows; rows carry their own `seq`."""
    rows.write.mode("append").json(path)


def write_frozen(rows: DataFrame, path: str) -> DataFrame:
    """Write once and return the identity a later reader checks."""
    rows.write.mode("errorifexists").parquet(path)
    return fingerprint(rows.sparkSession.read.schema(rows.schema).parquet(path))


def read_frozen(spark: SparkSession, path: str, identity: Mapping[str, object]) -> DataFrame:
    """The rows of a frozen write; refuses a table that is not the one named."""
    rows = spark.read.parquet(path)
    now = fingerprint(rows).first()
    if (now["rows"], now["digest"]) != (identity["rows"], identity["digest"]):
        raise ValueError(f"{path} is not the table this run was given")
    return rows
