"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
150 % of all words; none gets more than twice its own words, the excess goes to the
others by weight. Rates: among all document rates between 0 and 2 that give each source
its target, those nearest to one copy each in relative entropy. The dual is convex with
one multiplier a source, and its solution is an exponential tilt by size, held at 2:
rate = min(2, exp(multiplier * size)). Newton steps on all sources at once are one
grouped sum each over the table of (source, size, documents), kept inside a bracket so
that every step halves the bracket at worst. Copies: rates are rounded up for as many
documents of each cell as keep the running sum, sizes in order, so a source's words
come within about one document of its target.

Nothing is gathered on the driver but two sums; a hot source or size is cells of at
most SPLIT documents by hash. Runs agree: ties go to a hash of the key.

Defined results: a null text has size 0, gets its rate and takes 0 words; a null source
is the last source; repeated rows are documents of their own; a source without words has
target 0; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.llm.columns import words_of
from scriptorium.session import written_once

# Weights by position, the share of all words, and the most copies.
WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST = 2
#: relative miss of a target at which Newton stops
TOLERANCE = 1e-9
#: documents of one source and size that are ranked together
SPLIT = 1000


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with weight, cap and target; one row a source.

    Sources that reach their cap are those with the smallest cap per weight, so running
    sums in that order give the level of all others in one pass.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.select(
        "source",
        "source_size",
        F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).alias("weight"),
        (MOST * F.col("source_size")).cast("double").alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * TOTAL_PERCENT / 100.0 - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    stepped = weighed.withColumn("level", level)
    # the level of the first source, in that order, that stays below its cap is everyone's
    below = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))
    final = F.min(below).over(whole)["level"]
    return stepped.withColumn("final", final).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), "cap")).alias("target")
    )


def _rate(multiplier: Column, x: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * x, F.lit(1.0))))


def multipliers(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, target, scale, multiplier): the dual solution of every source.

    `cells` has source, size, n. A source at its cap has no finite solution and gets the
    limit, two copies of everything. Every step is one grouped sum over the cells.
    """
    scale = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    # words are counted in the source's mean size, so multipliers are of order one
    state = written_once(
        goals.join(scale.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
            F.col("source").alias("at"), "source_size", "target", "scale",
            F.lit(-1024.0).alias("low"), F.lit(1024.0).alias("high"), F.lit(0.0).alias("multiplier"),
            (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("full"),
        ),
        "mix-state",
    )
    while True:
        x = F.col("size") / F.col("scale")
        tilt = _rate(F.col("multiplier"), x)
        words = F.col("n") * F.col("size")
        step = (
            cells.join(state.where("not full"), F.col("source").eqNullSafe(F.col("at")))
            .groupBy("at", "source_size", "target", "scale", "low", "high", "multiplier", "full")
            .agg(
                F.sum(words * tilt).alias("got"),
                F.sum(F.when(tilt < MOST, words * tilt * x).otherwise(0.0)).alias("slope"),
            )
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = (F.abs(miss) <= TOLERANCE * F.col("target")) | (high - low <= 1e-12 * F.abs(F.col("multiplier")))
        moved = written_once(
            step.select(
                "at", "source_size", "target", "scale",
                low.alias("low"), high.alias("high"),
                F.when(done, F.col("multiplier")).otherwise(F.coalesce(F.when(inside, newton), (low + high) / 2)).alias("multiplier"),
                "full", done.alias("done"),
            ),
            "mix-state",
        )
        state = moved.drop("done").unionByName(state.where("full"))
        if moved.where("not done").isEmpty():
            return state.select(
                "at", "source_size", "target", "scale",
                F.when(F.col("full"), F.lit(math.inf)).otherwise(F.col("multiplier")).alias("multiplier"),
            )


def copies(sized: DataFrame, cells: DataFrame, tilts: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row of (doc_id, source, size).

    Documents of one source and size are dealt by hash to parts of about SPLIT. The
    fractions of all parts of a source are summed in order of size; a part rounds up as
    many documents as whole numbers (offset by a half) fall within its stretch.
    """
    salt = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.greatest(F.lit(1), F.ceil(F.col("n") / SPLIT)))
    rated = cells.join(tilts, F.col("source").eqNullSafe(F.col("at")), "left").select(
        F.col("source").alias("c_source"),
        F.col("size").alias("c_size"),
        "n",
        F.coalesce("source_size", F.lit(0)).cast("bigint").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        F.when(F.isnull("multiplier"), F.lit(1.0))
        .when(F.col("multiplier") == math.inf, F.lit(float(MOST)))
        .otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("scale")))
        .alias("rate"),
    )
    rated = written_once(rated, "mix-rates")
    dealt = sized.join(
        rated, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    ).withColumn("part", salt)
    dealt = written_once(dealt.select("doc_id", "source", "size", "source_size", "target", "rate", "part"), "mix-parts")
    parts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("m"), F.first("rate").alias("rate"))
    line = Window.partitionBy("source").orderBy(F.col("size").desc(), "part")
    upto = F.sum(F.col("m") * (F.col("rate") - F.floor("rate"))).over(line)
    parts = parts.withColumn("upto", upto)
    parts = parts.withColumn(
        "extra", F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.lag("upto").over(line), F.lit(0.0)) + 0.5)
    ).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), "extra")
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = dealt.withColumn("rank", rank)
    same = (
        F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part"))
    )
    return ranked.join(parts, same).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.floor("rate") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("bigint").alias("copies"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document."""
    sized = written_once(
        docs.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("bigint").alias("size")
        ),
        "mix-sizes",
    )
    cells = written_once(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tilts = multipliers(cells, targets(sources))
    return copies(sized, cells, tilts).withColumn("taken", F.col("copies") * F.col("size"))
