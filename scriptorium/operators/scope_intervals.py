"""Path rules as intervals: each address meets one row, however many rules its host has.

The paths that begin with a prefix are an interval of sorted paths. Intervals of prefixes
nest, so their ends cut all paths of a host into pieces in each of which the same rules
hold. A piece begins where a prefix begins, or where one ends and what lies around it goes on.
The rule of an address is that of the last beginning at or before its path: an as-of join with the
path as time. Rules are related to the rules around them by their own prefixes, so the
work is the length of the rules and the number of addresses, not their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.functions import urls
from scriptorium.operators.asof import as_of

#: a byte that no text holds: what begins with a prefix sorts before the prefix and this
BEHIND = "FF"


def pieces(rules: DataFrame) -> DataFrame:
    """(host, begins, rule): where each piece of a host's paths begins, and the first rule that holds in it.

    `rules`: (rule_order, host, path_prefix, section). `rule` is null where none holds.
    """
    rule = F.struct("rule_order", "path_prefix", "section")
    known = rules.where("host is not null and path_prefix is not null")
    first = known.groupBy("host", "path_prefix").agg(F.min(rule).alias("rule"))
    lengths = F.sequence(F.lit(0), F.char_length("path_prefix"))
    shorter = first.select("host", "path_prefix", F.explode(lengths).alias("n"))
    shorter = shorter.select("host", "path_prefix", F.substring("path_prefix", F.lit(1), F.col("n")).alias("around"))
    around = first.select("host", F.col("path_prefix").alias("around"), "rule")
    held = shorter.join(around, ["host", "around"]).groupBy("host", "path_prefix")
    own = held.agg(F.min("rule").alias("inside"), F.min(F.when(F.col("around") != F.col("path_prefix"), F.col("rule"))).alias("behind"))
    at = F.encode("path_prefix", "utf-8")
    begin, end = F.struct(at.alias("begins"), F.col("inside").alias("rule")), F.struct(F.concat(at, F.unhex(F.lit(BEHIND))).alias("begins"), F.col("behind").alias("rule"))
    return own.select("host", F.explode(F.array(begin, end)).alias("x")).select("host", "x.begins", "x.rule")


def in_scope(pages: DataFrame, rules: DataFrame, key: str, url: str = "url") -> DataFrame:
    """Each row with the first rule that covers it, null when none does: (key, url, rule_order, path_prefix, section)."""
    address = F.col(url)
    asked = pages.select(
        key,
        url,
        F.when(urls.is_http(address), urls.host_of(address)).alias("rule_host"),
        F.encode(urls.path_of(address), "utf-8").alias("rule_path"),
    )
    given = pieces(rules).withColumnRenamed("host", "rule_host")
    found = as_of(asked, given, ["rule_host"], "rule_path", "begins", F.struct("begins", "rule"), "piece")
    return found.select(key, url, *(F.col(f"piece.rule.{c}").alias(c) for c in ("rule_order", "path_prefix", "section")))
