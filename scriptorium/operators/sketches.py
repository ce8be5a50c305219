"""Statistics that merge: sketches stored by hour, rolled up without the rows they came from.

A fine window keeps, beside its exact count, a KLL sketch of a measure and an HLL sketch of
an identity. A coarser window merges the sketches of its fine ones; the rows are not read again.
Quantiles of a KLL sketch are off by at most a share of the ranks that its size sets, distinct
counts of an HLL sketch by a share of the count; `within` says whether an estimate kept it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: sizes of the sketches: KLL's k, and the log2 of HLL's slots
KLL_K, HLL_LG = 1000, 14
#: bounds that hold for nearly every sketch of these sizes: share of ranks, share of a distinct count
RANK_BOUND, COUNT_BOUND = 0.01, 0.03


def hourly(rows: DataFrame, keys: list[str], ts: str, measure: str, identity: str, width: str = "1 hour") -> DataFrame:
    """(window_start, keys, n, kll, hll) of each fine window; partial sketches meet in the shuffle."""
    held = rows.where(F.col(measure).isNotNull())
    return held.groupBy(F.window(ts, width)["start"].alias("window_start"), *keys).agg(
        F.count("*").alias("n"),
        F.kll_sketch_agg_bigint(F.col(measure).cast("long"), KLL_K).alias("kll"),
        F.hll_sketch_agg(F.col(identity), HLL_LG).alias("hll"),
    )


def rolled_up(fine: DataFrame, keys: list[str], width: str) -> DataFrame:
    """The same columns for coarser windows, from the stored sketches alone."""
    return fine.groupBy(F.window("window_start", width)["start"].alias("window_start"), *keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("kll").alias("kll"), F.hll_union_agg("hll").alias("hll")
    )


def quantile(kll: Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(kll, F.lit(share))


def distinct(hll: Column) -> Column:
    return F.hll_sketch_estimate(hll)


def rank_within(below: Column, upto: Column, n: Column, share: float, bound: float = RANK_BOUND) -> Column:
    """Whether a value with `below` rows under it and `upto` rows not over it is a quantile, give or take the bound."""
    return (below <= (share + bound) * n + 1) & (upto >= (share - bound) * n - 1)


def checked(rows: DataFrame, rolled: DataFrame, keys: list[str], ts: str, measure: str, identity: str, width: str, shares: list[float]) -> DataFrame:
    """(window_start, keys, n, ids, within): exact counts of the raw rows, and whether every estimate keeps its bound.

    The one read of the raw rows is the check itself, not the roll-up.
    """
    told = rolled.select(
        F.col("window_start").alias("w"), *(F.col(k).alias(f"r_{k}") for k in keys), F.col("n").alias("r_n"),
        distinct(F.col("hll")).alias("ids_about"), *(quantile(F.col("kll"), s).alias(f"q{i}") for i, s in enumerate(shares)),
    )
    own = rows.where(F.col(measure).isNotNull()).withColumn("window_start", F.window(ts, width)["start"])
    same = F.col("window_start") == F.col("w")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    ranks = [f(F.count_if(c)) for i in range(len(shares)) for c, f in (
        (F.col(measure) < F.col(f"q{i}"), lambda x, i=i: x.alias(f"below{i}")), (F.col(measure) <= F.col(f"q{i}"), lambda x, i=i: x.alias(f"upto{i}")))]
    exact = own.join(told, same).groupBy("window_start", *keys).agg(
        F.count("*").alias("n"), F.countDistinct(identity).alias("ids"), F.max("r_n").alias("r_n"), F.max("ids_about").alias("ids_about"), *ranks
    )
    within = (F.col("n") == F.col("r_n")) & (F.abs(F.col("ids_about") - F.col("ids")) <= COUNT_BOUND * F.col("ids") + 1)
    for i, share in enumerate(shares):
        within = within & rank_within(F.col(f"below{i}"), F.col(f"upto{i}"), F.col("n"), share)
    return exact.select("window_start", *keys, "n", "ids", within.alias("within"))
