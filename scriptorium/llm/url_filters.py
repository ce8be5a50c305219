"""URL filters: a short list of fixed rules, and association rules mined from labels.

A fixed rule names a host and a path; it fits that host and its subdomains where the
url's path starts with the rule's, and the longest that fits decides. For all other
urls FP-growth mines combinations of url tokens (scheme, host labels, folders, file
ending, query keys) together with the label of the page's document. Combinations with a
label that pass support, confidence and lift become rules; a rule is indexed by its
rarest token, urls meet it through that token and must hold all others. The most
confident rule decides, then support, then its tokens in order; without one the verdict
is allow.

The labels come from `labels` by the document number in the url's path (the last folder
that is a number), block for low quality or toxic.

Defined results: a null url, or one without `://`, has empty host and path and no token,
so no rule and the verdict allow; rows are judged each by their own url, whole, however
long; repeated rows repeat; with empty pages or labels no rule is mined; other columns,
whatever their names, are not read. Support is one absolute count at every size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.session import written_once

# Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: labelled urls of a verdict that must hold a combination, however many are labelled
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(page_id, digest, url, host, path) of every row; no shuffle."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return (
        pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
        .withColumn("rest", rest)
        .withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
        .select(
            "page_id",
            F.xxhash64("url").alias("digest"),
            "url",
            F.translate("raw", UPPER, LOWER).alias("host"),
            F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0).alias("path"),
        )
    )


def fixed_rule(rules: list[tuple[str, str, str]], what: str) -> Column:
    """The longest rule that fits, as its text or verdict. The list is short by contract."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out: Column | None = None
    for verdict, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.lit(host + path if what == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def tokens_of() -> Column:
    """The distinct tokens of a parsed url, each with its part's name."""
    empty = F.array().cast("array<string>")
    folders = F.array_remove(F.split("path", "/"), "")
    names = F.filter(folders, lambda x: ~x.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"))
    query = F.regexp_extract_all("url", F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    parts = [
        F.transform(F.array(F.split_part("url", F.lit("://"), F.lit(1))), lambda x: F.concat(F.lit("scheme:"), x)),
        F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("label:"), x)),
        F.array(F.concat(F.lit("host:"), "host")),
        F.transform(names, lambda x: F.concat(F.lit("folder:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("query:"), x)),
        F.transform(
            F.regexp_extract_all("path", F.lit(r"\.([A-Za-z0-9]+)$"), F.lit(1)), lambda x: F.concat(F.lit("ending:"), x)
        ),
        F.when(F.col("url").contains("#"), F.array(F.lit("fragment"))).otherwise(empty),
    ]
    return F.when(F.col("host") != "", F.array_distinct(F.concat(*parts))).otherwise(empty)


def mined_rules(
    tokens: DataFrame, labels: DataFrame, min_count: int, min_confidence: float, min_lift: float
) -> DataFrame:
    """(antecedent, verdict, confidence, support) of the rules that pass, and their index token.

    `tokens` has number, tokens; `labels` has doc_id, quality, toxic. FP-growth shards its
    transactions over the cluster; its rules are a table and stay one.
    """
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    told = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max(bad).alias("bad"))
    baskets = tokens.where("number is not null and size(tokens) > 0").join(told, "number").select(
        F.concat("tokens", F.array(F.when(F.col("bad"), "verdict:block").otherwise("verdict:allow"))).alias("items")
    )
    baskets = written_once(baskets, "url-baskets")
    # the miner counts by share and rounds up: half a url below the count asks for the count
    share = min(1.0, (min_count - 0.5) / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(
        F.col("consequent")[0].startswith("verdict:") & (F.col("lift") >= min_lift)
    ).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"),
        "confidence",
        "support",
    )
    return written_once(rules, "url-rules")


def best_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, digest, verdict) of the rows that hold all tokens of a rule.

    The inverted index has one entry a rule, under the token that fewest rows hold.
    """
    asked = rules.select("antecedent", F.explode("antecedent").alias("token"))
    frequency = (
        tokens.select(F.explode("tokens").alias("token"))
        .join(asked.select("token").distinct(), "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = asked.join(frequency, "token").groupBy("antecedent").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = written_once(rules.join(rarest, "antecedent"), "url-index")
    met = (
        tokens.select("page_id", "digest", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    order = F.struct("confidence", "support", F.negative(F.size("antecedent")), F.concat_ws(" ", "antecedent"), "verdict")
    return met.groupBy("page_id", "digest").agg(F.max(order)["verdict"].alias("mined"))


def url_filters(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Host, path, fixed rule and verdict of every url, one row each."""
    split = parsed(pages, key, url)
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1)
    tokens = split.select(
        "page_id", "digest", F.when(number != "", number.cast("bigint")).alias("number"), tokens_of().alias("tokens")
    )
    mined = mined_rules(tokens, labels, min_count, min_confidence, min_lift)
    best = best_rules(tokens, mined).select(
        F.col("page_id").alias("m_id"), F.col("digest").alias("m_digest"), "mined"
    )
    same = reduce(lambda a, b: a & b, [F.col("page_id").eqNullSafe(F.col("m_id")), F.col("digest") == F.col("m_digest")])
    return split.join(best, same, "left").select(
        "page_id",
        "host",
        "path",
        fixed_rule(rules, "rule").alias("rule"),
        F.coalesce(fixed_rule(rules, "verdict"), "mined", F.lit("allow")).alias("verdict"),
    )
