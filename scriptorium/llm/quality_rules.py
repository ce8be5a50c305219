"""Quality rules with host-level verdicts, in DataFrame functions only.

Every text is measured by itself; failures of each rule are summed by host, the rate
is shrunk toward an empirical beta prior over hosts, and a host's verdict on a rule is
joined back to the documents that break that rule. So a clean document of a bad host
stays, and a document with an odd count stays in a host that is otherwise sound.

Defined results: a null or empty text has no words and fails the length rule; a null
host is a host of its own; equal rows are judged alike and all returned; an empty table
gives an empty result; columns other than the three named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.columns import SPACE, let, window_hashes, words_of
from scriptorium.session import written_once

WINDOW = 8
MIN_WORDS = 20
#: percent of words in repeated windows above which a text fails by itself
MAX_REPEAT_PERCENT = 30
#: a shrunk host rate above this is the host's verdict against a rule
MAX_HOST_RATE = 0.3

# Rules whose failures count against a host. The first two fail a text by themselves.
RULES = {
    "short": lambda: F.col("n_words") < MIN_WORDS,
    "repeats": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
}
OWN = ("short", "repeats")


def _repeated_words(words: Column, hashes: Column) -> Column:
    """How many words stand in a window found twice or more.

    Texts without a repeated window, nearly all, end at the first test. Else windows
    are sorted by hash, equal neighbours give the starts, and sorted starts give the
    words covered, each counted once.
    """

    def starts_of(ordered: Column) -> Column:
        def meets(x: Column, j: Column) -> Column:
            near = lambda k: F.coalesce(x["h"] == F.get(ordered, j + k)["h"], F.lit(False))
            return near(-1) | near(1)

        return F.sort_array(F.transform(F.filter(ordered, meets), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts,
            lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW))),
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(let(ordered, starts_of), covered)
    )


def measure(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The counts of each text beside the columns `keep`; no shuffle."""
    split = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = split.select(
        *keep_names(keep, split),
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.withColumn("hashes", window_hashes(F.col("words"), WINDOW))
    counted = hashed.select(
        *keep_names(keep, split),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", "")))
        .cast("bigint")
        .alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.col("hashes")).cast("bigint").alias("n_repeat_words"),
    )
    failed = F.lit(False)
    for rule in OWN:
        failed = failed | RULES[rule]()
    return counted.withColumn("base_failed", failed)


def keep_names(keep: list[Column], split: DataFrame) -> list[str]:
    return [f"`{name}`" for name in split.columns[: len(keep)]]


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a host: documents, and for each rule the shrunk failure rate and the verdict.

    Failures are partial sums before the shuffle, so a hot host is a few rows. The beta
    prior of a rule has the pooled rate as its mean and its strength by moments from
    the spread of host rates; it is one row, joined by position to every host.
    """
    sums = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"),
        *(F.sum(RULES[r]().cast("bigint")).alias(f"k_{r}") for r in RULES),
    )
    sums = written_once(sums, "host-sums")
    moments = []
    for r in RULES:
        pooled = F.sum(f"k_{r}") / F.sum("n_docs")
        rate = F.col(f"k_{r}") / F.col("n_docs")
        moments += [pooled.alias(f"m_{r}"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias(f"v_{r}")]
    prior = sums.agg(*moments).first()  # one row of eight numbers
    out = sums
    for r in RULES:
        mean, spread = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        rate = (F.col(f"k_{r}") + mean * strength) / (F.col("n_docs") + strength)
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"reject_{r}", rate > max_rate)
    return out


def verdict_of(measured: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """`measured` with `kept`: no failure by itself, and no failure its host is rejected for.

    Only hosts with a verdict against some rule are joined.
    """
    against = F.lit(False)
    for r in RULES:
        against = against | F.col(f"reject_{r}")
    bad = verdicts.where(against).select(
        F.col("host").alias("bad_host"), *(F.col(f"reject_{r}").alias(f"bad_{r}") for r in RULES)
    )
    joined = measured.join(bad, F.col(host).eqNullSafe(F.col("bad_host")), "left")
    broken = F.col("base_failed")
    for r in RULES:
        broken = broken | (F.coalesce(F.col(f"bad_{r}"), F.lit(False)) & RULES[r]())
    return joined.withColumn("kept", ~broken).drop("bad_host", *(f"bad_{r}" for r in RULES))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts, own failure and verdict of every document, one row each.

    The texts are read once; the counts are written and read by both later steps.
    """
    keep = [F.col(key).alias("doc_id"), F.col(host).alias("host")]
    measured = written_once(measure(docs, text, keep), "quality-counts")
    return verdict_of(measured, host_verdicts(measured, "host"), "host").drop("host")


def drop_failing(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that `quality_rules` keeps, whole and in their own columns.

    Texts are measured once: rows are written beside their counts, and the filter reads
    those. Filtering the measures themselves would run them again inside the filter.
    """
    # the row travels as one struct, so its column names can clash with none of ours
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    measured = written_once(measure(docs, text, [row, F.col(host).alias("host")]), "quality-rows", "zstd")
    verdicts = host_verdicts(measured, "host")
    return verdict_of(measured, verdicts, "host").where("kept").select("row.*")
