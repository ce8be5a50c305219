"""Registered queries of the link graph and of sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import urls, vectors
from scriptorium.operators import encoding, links, sampling
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.scalar_queries import EDGE_URL_SQL, LINKS_SQL, edge_url
from scriptorium.plans.views import text_of


@query("j06_ledger_carrier", "SELECT page, carrier FROM v_carriers")
def j06(spark, sf):
    return links.carriers(v.page_ledger(spark, sf), v.linked(spark, sf))


def candidates(spark, sf):
    return links.graph_candidates(
        v.question_hits(spark, sf), v.page_ledger(spark, sf), v.linked(spark, sf), v.visited_pages(spark, sf)
    )


@query("x18_graph_candidates", "SELECT question_id, dst, rn, pos, referrer, anchor, is_pdf FROM v_candidates")
def x18(spark, sf):
    return candidates(spark, sf)


QUOTA_SQL = """SELECT question_id, dst, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, dst) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, is_pdf ORDER BY score DESC, dst) AS k FROM {scored}) WHERE k <= CASE WHEN is_pdf THEN 5 ELSE 10 END"""


@query(
    "w04_dual_quota",
    QUOTA_SQL.format(
        scored="(SELECT question_id, dst, is_pdf, CAST((dst * 37) % 101 AS DOUBLE) / 100 AS score FROM v_candidates)"
    ),
)
def w04(spark, sf):
    scored = candidates(spark, sf).withColumn("score", ((F.col("dst") * 37) % 101).cast("double") / 100)
    return links.shortlist(scored).select("question_id", "dst", "score", "rn")


@query(
    "w04_pdf_only",
    """SELECT question_id, dst, row_number() OVER (PARTITION BY question_id ORDER BY (dst * 37) % 101 DESC, dst) AS rn FROM v_candidates WHERE is_pdf""",
)
def w04_pdf(spark, sf):
    scored = candidates(spark, sf).withColumn("score", ((F.col("dst") * 37) % 101).cast("double") / 100)
    return links.shortlist(scored, link_hopping=False).select("question_id", "dst", "rn")


@query(
    "x19_narrow_candidates",
    r"""WITH texts AS (SELECT question_id, dst, is_pdf, anchor || CASE WHEN is_pdf THEN ' file.pdf /d/' || dst || '/file.pdf' ELSE ' /d/' || dst END AS t FROM v_candidates),
        tv AS (SELECT question_id, dst, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS slot, count(*) AS x FROM (
            SELECT question_id, dst, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS w FROM texts) GROUP BY 1, 2, 3),
        tn AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY question_id, dst)) AS u FROM tv),
        scored AS (SELECT t.question_id, t.dst, t.is_pdf, round(COALESCE(sum(n.u * q.v), 0), 9) AS score FROM texts t JOIN tn n USING (question_id, dst)
            LEFT JOIN v_hash_queries q ON q.question_id = t.question_id AND q.slot = n.slot GROUP BY 1, 2, 3) """
    + QUOTA_SQL.format(scored="scored"),
)
def x19(spark, sf):
    """Candidates scored by their ranking text against the question, under both quotas."""
    pool = candidates(spark, sf).withColumn("ranking", urls.ranking_text(F.col("anchor"), edge_url()))
    coded = encoding.encode_batch(pool, "ranking", into="link_vec")
    asked = encoding.encode_batch(v.gold(spark, sf), "question", into="question_vec").select(
        "question_id", "question_vec"
    )
    scored = coded.join(asked, "question_id").withColumn(
        "score", F.round(vectors.cosine(F.col("link_vec"), F.col("question_vec")), 9)
    )
    return links.shortlist(scored).select("question_id", "dst", "score", "rn")


REACH_SQL = """WITH RECURSIVE usable AS (SELECT DISTINCT src, dst FROM v_edges WHERE NOT is_pdf),
    reach AS (SELECT CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS hop UNION
              SELECT u.dst, r.hop + 1 FROM reach r JOIN usable u ON u.src = r.page WHERE r.hop < (SELECT count(*) FROM pages)),
    first AS (SELECT page, min(hop) AS hop FROM reach GROUP BY 1)
    SELECT f.page, f.hop, COALESCE(CAST(min(p.page) AS VARCHAR), 'none') AS referrer FROM first f LEFT JOIN (
        SELECT u.dst, x.page, x.hop FROM usable u JOIN first x ON x.page = u.src) p ON p.dst = f.page AND p.hop = f.hop - 1 GROUP BY 1, 2"""


@query("x20_frontier_crawl_order", REACH_SQL)
def x20(spark, sf):
    """Breadth-first reach from page 0 over followable links."""
    seeds = v.table(spark, sf, "pages").where("page_id = 0").select(F.col("page_id").alias("page"))
    visited, _ = links.crawl_order(v.edges(spark, sf), seeds, follow=~F.col("is_pdf"))
    return visited.select(
        "page", "hop", F.coalesce(F.col("referrer").cast("string"), F.lit("none")).alias("referrer")
    )


@query(
    "x20_reach_sizes",
    f"SELECT hop, count(*) AS pages FROM ({REACH_SQL}) GROUP BY 1",
)
def x20_sizes(spark, sf):
    seeds = v.table(spark, sf, "pages").where("page_id = 0").select(F.col("page_id").alias("page"))
    visited, _ = links.crawl_order(v.edges(spark, sf), seeds, follow=~F.col("is_pdf"))
    return visited.groupBy("hop").agg(F.count("*").alias("pages"))


@query(
    "x21_uncrawled_pool",
    f"""SELECT dst AS url, arg_min(anchor, (page_id, pos)) AS anchor FROM (
        SELECT page_id, pos, CASE WHEN page_id % 3 = 0 THEN dst || '.PDF' WHEN page_id % 3 = 1 THEN 'https://other.example/' || page_id || '/people/card' ELSE dst END AS dst,
               anchor || ' as linked from page' AS anchor FROM ({LINKS_SQL}))
        WHERE (lower(regexp_extract(dst, '^https?://([^/?#:]+)', 1)) LIKE '%.example.org' OR lower(dst) LIKE '%.pdf') AND NOT contains(dst, 'people/')
          AND length(anchor) >= 15 AND dst NOT IN (SELECT url FROM v_registry) GROUP BY 1""",
)
def x21(spark, sf):
    p = F.col("page_id")
    named = v.links(spark, sf).select(
        F.struct("page_id", "pos").alias("order"),
        F.when(p % 3 == 0, F.concat("dst", F.lit(".PDF")))
        .when(p % 3 == 1, text_of("https://other.example/", p, "/people/card"))
        .otherwise(F.col("dst"))
        .alias("dst"),
        F.concat("anchor", F.lit(" as linked from page")).alias("anchor"),
    )
    in_scope = F.endswith(urls.host_of(F.col("dst")), F.lit(".example.org"))
    return links.uncrawled_pool(
        named, v.registry(spark, sf).select("url"), in_scope, (*sampling.EXCLUDED, "people/")
    )


@query(
    "j03_not_exists_join",
    f"SELECT dst AS url, count(*) AS links FROM ({LINKS_SQL}) WHERE dst NOT IN (SELECT url FROM pages) GROUP BY 1",
)
def j03(spark, sf):
    """Linked addresses no page of the table was fetched from."""
    fetched = v.table(spark, sf, "pages").select(F.col("url").alias("dst"))
    return (
        v.links(spark, sf)
        .join(fetched, "dst", "left_anti")
        .groupBy(F.col("dst").alias("url"))
        .agg(F.count("*").alias("links"))
    )


@query(
    "a13_outlink_stats",
    f"""SELECT kind, count(*) AS pages, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, max(n) AS most FROM (
        SELECT p.page_id, CASE WHEN contains(h.content_type, 'pdf') OR lower(h.url) LIKE '%.pdf' THEN 'pdf' ELSE 'other' END AS kind,
               count(l.dst) AS n FROM pages p JOIN v_headers h USING (page_id) LEFT JOIN ({LINKS_SQL}) l ON l.page_id = p.page_id GROUP BY 1, 2) GROUP BY 1""",
)
def a13(spark, sf):
    kinds = v.headers(spark, sf).select(
        "page_id",
        F.when(urls.is_pdf(F.col("url"), F.col("content_type")), "pdf").otherwise("other").alias("kind"),
    )
    counts = v.links(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"))
    per_page = kinds.join(counts, "page_id", "left").withColumn("outlinks", F.coalesce("n", F.lit(0)))
    return links.outlink_stats(per_page, "kind")


@query("a19_outcome_funnel", "SELECT step, outcome, count(*) AS decisions FROM v_decisions GROUP BY 1, 2")
def a19(spark, sf):
    return links.outcome_funnel(v.decisions(spark, sf))


@query(
    "a19_hops_per_question",
    """SELECT hops, count(*) AS questions, round(avg(CASE WHEN fell THEN 1.0 ELSE 0.0 END), 9) AS fallback_share FROM (
        SELECT question_id, max(step) AS hops, bool_or(outcome = 'timeout') AS fell FROM v_decisions GROUP BY 1) GROUP BY 1""",
)
def a19_hops(spark, sf):
    return links.hops_per_question(v.decisions(spark, sf))


PAGE_TEXT_SQL = """(SELECT url, section, left(string_agg(text, chr(10) ORDER BY row_key), 4000) AS text FROM v_chunks WHERE kind = 'web' GROUP BY 1, 2)"""


@query("x22_page_regroup", f"SELECT url, section, md5(text) AS text, length(text) AS chars FROM {PAGE_TEXT_SQL}")
def x22(spark, sf):
    pages = sampling.page_regroup(v.chunks(spark, sf))
    return pages.select(
        "url", "section", F.md5("text").alias("text"), F.length("text").cast("long").alias("chars")
    )


QUOTA = {f"src{i}": 3 + i % 4 for i in range(20)}
QUOTA_CASE = "CASE section " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in QUOTA.items()) + " END"
SAMPLE_SQL = f"""(SELECT url, section, row_number() OVER (PARTITION BY section ORDER BY sha256('20260101|' || url), url) AS place FROM {PAGE_TEXT_SQL}
    WHERE length(text) >= 300 QUALIFY row_number() OVER (PARTITION BY section ORDER BY sha256('20260101|' || url), url) <= {QUOTA_CASE})"""


def sampled(spark, sf):
    pages = sampling.page_regroup(v.chunks(spark, sf))
    return sampling.stratified_sample(pages, QUOTA, 20260101).select("url", "section", "place")


@query("x23_stratified_sample", f"SELECT * FROM {SAMPLE_SQL}")
def x23(spark, sf):
    return sampled(spark, sf)


@query(
    "x23_short_strata",
    f"""SELECT section, count(*) AS usable, {QUOTA_CASE.replace('THEN 3', 'THEN 300')} AS wanted FROM {PAGE_TEXT_SQL} WHERE length(text) >= 300 GROUP BY 1
        HAVING count(*) < {QUOTA_CASE.replace('THEN 3', 'THEN 300')}""",
)
def x23_short(spark, sf):
    wanted = {s: 300 if n == 3 else n for s, n in QUOTA.items()}
    return sampling.short_strata(sampling.page_regroup(v.chunks(spark, sf)), wanted)


@query(
    "x23_sample_with_minimum",
    f"""WITH c AS (SELECT DISTINCT {EDGE_URL_SQL} AS url, is_pdf FROM v_edges), d AS (SELECT url, is_pdf, row_number() OVER (PARTITION BY is_pdf ORDER BY sha256('7|' || url), url) AS k FROM c)
        SELECT url, is_pdf FROM d WHERE (is_pdf AND k <= 2) OR (NOT is_pdf AND k <= 6)""",
)
def x23_minimum(spark, sf):
    """Eight link targets of which at least two are PDFs, the same for a seed."""
    targets = v.edges(spark, sf).select(edge_url().alias("url"), "is_pdf").distinct()
    return sampling.sample_with_minimum(targets, 8, 2, "is_pdf", seed=7).select("url", "is_pdf")


@query(
    "w11_locale_cycle",
    f"""SELECT 'c' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS id, url, (['it', 'en', 'zh', 'it', 'en'])[(n - 1) % 5 + 1] AS locale FROM (
        SELECT url, row_number() OVER (ORDER BY section, place) AS n FROM {SAMPLE_SQL})""",
)
def w11(spark, sf):
    return sampling.locale_cycle(sampled(spark, sf), ["section", "place"]).select("id", "url", "locale")
