"""The link graph: carriers, candidate pools, shortlists, reach, uncrawled links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators.ranking import quota_cut
from scriptorium.session import cut_lineage

# How many pages and how many PDFs a shortlist holds, and the shortest anchor.
PAGE_QUOTA = 10
PDF_QUOTA = 5
MIN_ANCHOR = 15


def carriers(ledger: DataFrame, edges: DataFrame) -> DataFrame:
    """For each page, the page whose links stand for it: (page, carrier).

    Itself when it has links, else its referrer when the ledger still holds that row.
    `ledger`: page, referrer; `edges`: src.
    """
    linking = edges.select(F.col("src").alias("page")).distinct().withColumn("links", F.lit(True))
    marked = ledger.select("page", "referrer").join(linking, "page", "left")
    known = ledger.select(F.col("page").alias("referrer"), F.lit(True).alias("known"))
    return (
        marked.join(known, "referrer", "left")
        .withColumn(
            "carrier",
            F.when(F.col("links"), F.col("page")).when(F.col("known"), F.col("referrer")),
        )
        .where("carrier is not null")
        .select("page", "carrier")
    )


def graph_candidates(
    hits: DataFrame, ledger: DataFrame, edges: DataFrame, visited: DataFrame
) -> DataFrame:
    """Per question the links its hit pages offer, minus what it has seen.

    `hits`: question_id, rn, page; `visited`: question_id, page. The first place a
    link stands, by hit rank and position, gives its anchor and referrer.
    """
    read_through = hits.join(carriers(ledger, edges), "page")
    offered = read_through.join(edges, F.col("carrier") == F.col("src"))
    seen = (
        hits.select("question_id", "page")
        .unionByName(visited.select("question_id", "page"))
        .select("question_id", F.col("page").alias("dst"))
        .distinct()
    )
    return (
        offered.join(seen, ["question_id", "dst"], "left_anti")
        .groupBy("question_id", "dst")
        .agg(F.min(F.struct("rn", "pos", F.col("src").alias("referrer"), "anchor", "is_pdf")).alias("at"))
        .select("question_id", "dst", "at.rn", "at.pos", "at.referrer", "at.anchor", "at.is_pdf")
    )


def shortlist(
    scored: DataFrame, key: str = "dst", link_hopping: bool = True
) -> DataFrame:
    """Scored candidates under their two quotas, or the PDFs alone without a cut."""
    if link_hopping:
        return quota_cut(
            scored, "question_id", "is_pdf", {False: PAGE_QUOTA, True: PDF_QUOTA}, key=key
        )
    return quota_cut(
        scored.where("is_pdf"), "question_id", "is_pdf", {True: None}, key=key
    )


def crawl_order(
    edges: DataFrame,
    seeds: DataFrame,
    max_pages: int | None = None,
    follow: Column | None = None,
) -> tuple[DataFrame, int]:
    """Breadth-first reach: ((page, hop, referrer), pages left queued at the cap).

    One equi-join per hop against edges kept partitioned by source; the referrer is
    the smallest page of the hop before. Each hop is written to the shared folder.
    `follow` is the scope and extension rule on an edge.
    """
    usable = edges if follow is None else edges.where(follow)
    usable = cut_lineage(usable.select("src", "dst").distinct().repartition("src"))
    kind = usable.schema["dst"].dataType
    frontier = cut_lineage(
        seeds.select(
            F.col("page").cast(kind).alias("page"),
            F.lit(0).cast("long").alias("hop"),
            F.lit(None).cast(kind).alias("referrer"),
        ).distinct()
    )
    visited, total, left = frontier, frontier.count(), 0
    hop = 0
    while True:
        hop += 1
        reached = (
            frontier.join(usable, frontier.page == usable.src)
            .groupBy(F.col("dst").alias("page"))
            .agg(F.min("src").alias("referrer"))
            .join(visited.select("page"), "page", "left_anti")
            .select("page", F.lit(hop).cast("long").alias("hop"), "referrer")
        )
        frontier = cut_lineage(reached)
        found = frontier.count()
        if not found:
            break
        if max_pages is not None and total + found > max_pages:
            left = total + found - max_pages
            frontier = frontier.orderBy("page").limit(max_pages - total)
            visited = cut_lineage(visited.unionByName(frontier))
            break
        total += found
        visited = cut_lineage(visited.unionByName(frontier))
    return visited, left


def uncrawled_pool(
    links: DataFrame,
    fetched: DataFrame,
    in_scope: Column,
    excluded: Sequence[str] = (),
) -> DataFrame:
    """Links never fetched that could be: named, in scope or PDF, first anchor kept.

    `links`: order, dst, anchor; `fetched`: url. -> (url, anchor).
    """
    low = F.lower("dst")
    allowed = in_scope | F.endswith(low, F.lit(".pdf"))
    for pattern in excluded:
        allowed = allowed & ~F.contains(F.col("dst"), F.lit(pattern))
    return (
        links.where(allowed & (F.length("anchor") >= MIN_ANCHOR))
        .join(fetched.select(F.col("url").alias("dst")), "dst", "left_anti")
        .groupBy(F.col("dst").alias("url"))
        .agg(F.min_by("anchor", "order").alias("anchor"))
    )


def outlink_stats(counts: DataFrame, kind: str, exact: bool = True) -> DataFrame:
    """Median, p90 and maximum of outlinks per page, for each kind of page."""
    n = F.col("outlinks")
    pick = F.percentile if exact else F.percentile_approx
    return counts.groupBy(kind).agg(
        F.count("*").alias("pages"),
        pick(n, F.lit(0.5)).cast("double").alias("median"),
        pick(n, F.lit(0.9)).cast("double").alias("p90"),
        F.max(n).alias("most"),
    )


def outcome_funnel(decisions: DataFrame) -> DataFrame:
    """Decisions per step and outcome."""
    return decisions.groupBy("step", "outcome").agg(F.count("*").alias("decisions"))


def hops_per_question(decisions: DataFrame, fallback: str = "timeout") -> DataFrame:
    """Questions by how many steps they took, with the share that ended in a fallback."""
    per_question = decisions.groupBy("question_id").agg(
        F.max("step").alias("hops"),
        F.bool_or(F.col("outcome") == fallback).alias("fell_back"),
    )
    return per_question.groupBy("hops").agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.col("fell_back").cast("double")), 9).alias("fallback_share"),
    )
