"""Scores of labelled runs: ranks, hit rates, failures counted and never averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Where hits are counted, and when an answer counts as good.
CUTS = (1, 3, 5, 10)
MRR_CUT = 10
GOOD = 0.5


def first_hit_rank(
    hits: DataFrame,
    truth: DataFrame,
    questions: DataFrame,
    arms: Sequence[str] | None = None,
    question: str = "question_id",
) -> DataFrame:
    """Rank of the first right hit per question (and arm), null when there is none.

    `hits` and `truth` share the columns a hit is judged on besides the question.
    """
    judged = [c for c in truth.columns if c != question]
    right = hits.join(truth.distinct(), [question, *judged], "left_semi")
    asked = questions.select(question, "locale")
    keys = [question]
    if arms is not None:
        keys.append("arm")
        asked = asked.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    return asked.join(right.groupBy(*keys).agg(F.min("rn").alias("rank")), keys, "left")


def trimmed(url: Column) -> Column:
    """An address as truth compares it: without a closing slash."""
    return F.regexp_replace(url, r"/+$", "")


def rank_by_url_or_page(hits: DataFrame, truth: DataFrame, questions: DataFrame) -> DataFrame:
    """First rank at which a hit is a question's page: by address, or by file and page.

    `truth`: question_id with either url or (source_file, page); `hits`: question_id,
    rn, url, source_file, pages (array). Two equi-joins, then the lower rank.
    """
    wanted = truth.where("url is not null").select(
        "question_id", trimmed(F.col("url")).alias("address")
    )
    by_url = hits.select("question_id", "rn", trimmed(F.col("url")).alias("address")).join(
        wanted, ["question_id", "address"], "left_semi"
    )
    by_page = hits.select(
        "question_id", "rn", "source_file", F.explode("pages").alias("page")
    ).join(
        truth.where("url is null").select("question_id", "source_file", "page"),
        ["question_id", "source_file", "page"],
        "left_semi",
    )
    right = by_url.select("question_id", "rn").unionByName(by_page.select("question_id", "rn"))
    return questions.select("question_id").join(
        right.groupBy("question_id").agg(F.min("rn").alias("rank")), "question_id", "left"
    )


def retrieval_summary(rank: Column) -> list[Column]:
    """hit@k as counts and the mean reciprocal rank, a miss counting 0."""
    counts = [
        F.count_if(F.coalesce(rank <= k, F.lit(False))).alias(f"hit_{k}") for k in CUTS
    ]
    reciprocal = F.when(rank <= MRR_CUT, 1 / rank).otherwise(F.lit(0.0))
    return [
        F.count("*").alias("questions"),
        *counts,
        F.round(F.avg(F.coalesce(reciprocal, F.lit(0.0))), 9).alias("mrr_10"),
    ]


def by_locale(rows: DataFrame, summary: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Any summary for all rows and for each locale, in one pass of grouping sets."""
    sets = [[*keys], [*keys, "locale"]]
    grouped = rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, "locale"]]
    )
    name = F.when(F.grouping("locale") == 1, "all").otherwise(F.col("locale"))
    out = grouped.agg(name.alias("group"), *summary)
    return out.drop("locale")


def metric_summary(value: Column) -> list[Column]:
    """Mean of the scored values beside counts of each way a score can be missing."""
    number = F.when(~value.isin("nan", "failed", "refused"), value.try_cast("double"))
    return [
        F.round(F.avg(number), 9).alias("mean"),
        F.count(number).alias("scored"),
        *[F.count_if(value == reason).alias(reason) for reason in ("nan", "failed", "refused")],
    ]


def rate(condition: Column, among: Column | None = None) -> Column:
    """Share of true values among the rows that count; null when none does."""
    counted = condition if among is None else F.when(among, condition)
    return F.round(F.avg(counted.cast("double")), 9)


def flag_lists(scores: DataFrame) -> DataFrame:
    """Answers worth a look, as rows (flag, question_id), and how many there are per flag.

    Rows, not lists: a flag may hold any share of a large run.
    """
    wide = scores.groupBy("question_id", "locale", "answer_locale").pivot(
        "metric", ["faithfulness", "relevancy"]
    ).agg(F.first(F.when(~F.col("value").isin("nan", "failed", "refused"), F.col("value").try_cast("double"))))
    mismatch = wide.where(F.col("locale") != F.col("answer_locale")).select(
        F.lit("language mismatch").alias("flag"), "question_id"
    )
    off_topic = wide.where((F.col("faithfulness") >= GOOD) & (F.col("relevancy") < GOOD)).select(
        F.lit("faithful but irrelevant").alias("flag"), "question_id"
    )
    return mismatch.unionByName(off_topic)


def routing_report(routes: DataFrame) -> DataFrame:
    """How often the router chose the labelled collection, both, or fell back."""
    exact = F.col("routed") == F.col("target")
    both = F.col("routed") == "both"
    return routes.agg(
        F.count("*").alias("questions"),
        F.count_if(exact).alias("exact"),
        F.count_if(exact | both).alias("wide"),
        F.count_if(both).alias("both"),
        F.count_if("fallback").alias("fallback"),
    )


def label_agreement(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion of a predicted against a given label, with the agreement of each label."""
    return (
        rows.groupBy(label)
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col(label) == F.col(predicted)).alias("agree"),
        )
    )


def confusion(rows: DataFrame, label: str, predicted: str, values: Sequence[str]) -> DataFrame:
    return rows.groupBy(label).pivot(predicted, list(values)).count().na.fill(0)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one run the other lacks, repeats counted: empty when the runs are equal."""
    columns = left.columns
    only_left = left.exceptAll(right.select(*columns)).withColumn("side", F.lit("left"))
    only_right = right.select(*columns).exceptAll(left).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)
