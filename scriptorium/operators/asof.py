"""As-of join by merging: each left row with the best right row at or before its time.

Both sides become one table in order of (key, time), right rows first at equal times, cut
into pieces by range. A piece carries the best right row so far from row to row; what a key's
earlier pieces end with is carried over the borders, one row a key and piece. So a key that
holds half of all rows is many pieces, and no list of a key's right rows is ever made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.session import written_once


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, best: Column, name: str = "found") -> DataFrame:
    """The columns of `left` and, as `name`, the greatest `best` of the right rows of its key with `since` <= `at`.

    `best` is an expression over `right` that has an order: a struct that begins with `since`
    gives the latest row. It is null where there is no such row, where a key or a time is null
    too. Rows of `left` that repeat return each.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row")
    asked = left.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(at).alias("t"), F.lit(1).alias("side"), row)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, since)])
    given = right.where(known).select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(since).alias("t"), F.lit(0).alias("side"), best.alias("best")
    )
    names = [f"k{i}" for i in range(len(keys))]
    both = asked.unionByName(given, allowMissingColumns=True)
    # many left rows at one time may still be cut apart: they do not depend on each other
    spread = F.when(F.col("side") == 1, F.xxhash64("row")).otherwise(F.lit(0))
    placed = both.withColumn("spread", spread).repartitionByRange(*names, "t", "side", "spread")
    placed = written_once(placed.withColumn("piece", F.spark_partition_id()), "as-of")
    ends = placed.groupBy(*names, "piece").agg(F.max("best").alias("end"))
    earlier = Window.partitionBy(*names).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"c_{k}") for k in names), F.col("piece").alias("c_piece"), F.max("end").over(earlier).alias("carried"))
    carried = carried.where("carried is not null")
    so_far = Window.partitionBy("piece", *names).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("local", F.max("best").over(so_far)).where("side = 1")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"c_{k}") for k in names], F.col("piece") == F.col("c_piece"))
    found = F.when(F.col("t").isNotNull(), F.array_max(F.array("local", "carried")))
    return local.join(carried, same, "left").select("row.*", found.alias(name))
