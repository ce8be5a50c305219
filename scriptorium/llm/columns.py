"""Column expressions shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: white space that ends a word; all else is part of one.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words of a whole text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of every run of `n` words, in order; empty below `n` words.

    Elements are read by index: `slice` would copy the whole array for each window.
    """
    none = F.array().cast("array<bigint>")

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        each = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, each).otherwise(none)

    # bound first: an expression inside a lambda is computed for every element
    return let(words, hashed)


#: buckets of keys: as many rows, and no more, may be broadcast by `split_by_keys`
BUCKETS = 1 << 20


def split_by_keys(docs: DataFrame, key: str, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(near, far): rows whose key may be among `keys`, and rows whose key is not.

    What goes on to an exact join by key is then the few rows that may meet it, not every
    whole text. Where the keys fill all buckets, every row is near, and as correct.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    held = F.broadcast(keys.select(bucket(F.col(name)).alias("_key_bucket")).distinct())
    meets = bucket(docs[key]) == held["_key_bucket"]
    return docs.join(held, meets, "left_semi"), docs.join(held, meets, "left_anti")
