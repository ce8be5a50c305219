"""Registered queries of search, fusion, passages and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.tokens import words
from scriptorium.operators import bm25, encoding, evaluation as ev, impact_index, passages, ranking, retrieval, vector_index
from scriptorium.operators.filters import payload_filter
from scriptorium.operators.incremental_clusters import Clusters
from scriptorium.operators.ranking import PREFETCH
from scriptorium.operators.vector_search import exact_search, recall_at_k
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.views import text_of
from scriptorium.session import cut_lineage, scratch_path, written_once


def nullable(number):
    """A nullable count as text, so that both engines print it alike."""
    return F.coalesce(number.cast("string"), F.lit("none"))


def sparse_hits(spark, sf, k=ranking.PREFETCH):
    return bm25.search_texts(
        v.chunks(spark, sf).select("row_key", "text"), v.gold(spark, sf), k=k
    )


def doc_of(row_key):
    return F.substring_index(row_key, "-", 1).cast("long")


def sparse_ranks(spark, sf):
    hits = sparse_hits(spark, sf).where(F.col("rn") <= ev.MRR_CUT)
    judged = hits.withColumn("doc_id", doc_of(F.col("row_key")))
    return ev.first_hit_rank(judged, v.truth(spark, sf), v.gold(spark, sf))


SUMMARY_SQL = """count(*) AS questions, count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3,
    count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10,
    round(avg(COALESCE(CASE WHEN rank <= 10 THEN 1.0 / rank END, 0)), 9) AS mrr_10"""


@query(
    "flagship_retrieval",
    f"""SELECT COALESCE(locale, 'all') AS "group", {SUMMARY_SQL} FROM v_sparse_ranks GROUP BY GROUPING SETS ((), (locale))""",
)
def flagship(spark, sf):
    """Questions searched over the whole corpus, scored against the documents that hold them."""
    return ev.by_locale(sparse_ranks(spark, sf), ev.retrieval_summary(F.col("rank")))


@query(
    "a01_hit_at_k",
    """SELECT count(*) FILTER (rank <= 1) AS hit_1, count(*) FILTER (rank <= 3) AS hit_3,
       count(*) FILTER (rank <= 5) AS hit_5, count(*) FILTER (rank <= 10) AS hit_10 FROM v_sparse_ranks""",
)
def a01(spark, sf):
    return sparse_ranks(spark, sf).agg(
        *ev.retrieval_summary(F.col("rank"))
    ).select("hit_1", "hit_3", "hit_5", "hit_10")


@query(
    "a02_mrr_at_10",
    "SELECT round(avg(COALESCE(1.0 / rank, 0)), 9) AS mrr_10 FROM v_sparse_ranks",
)
def a02(spark, sf):
    return sparse_ranks(spark, sf).agg(*ev.retrieval_summary(F.col("rank"))).select("mrr_10")


@query(
    "a03_by_locale",
    """SELECT COALESCE(locale, 'all') AS "group", count(*) AS questions, count(rank) AS found FROM v_sparse_ranks
       GROUP BY GROUPING SETS ((), (locale))""",
)
def a03(spark, sf):
    return ev.by_locale(
        sparse_ranks(spark, sf),
        [F.count("*").alias("questions"), F.count("rank").alias("found")],
    )


METRIC_SQL = """round(avg(TRY_CAST(CASE WHEN value NOT IN ('nan', 'failed', 'refused') THEN value END AS DOUBLE)), 9) AS mean,
    count(*) FILTER (value NOT IN ('nan', 'failed', 'refused')) AS scored, count(*) FILTER (value = 'nan') AS nan,
    count(*) FILTER (value = 'failed') AS failed, count(*) FILTER (value = 'refused') AS refused"""


@query(
    "a04_metric_summary",
    f"""SELECT metric, COALESCE(locale, 'all') AS "group", {METRIC_SQL} FROM v_scores GROUP BY GROUPING SETS ((metric), (metric, locale))""",
)
def a04(spark, sf):
    return ev.by_locale(v.scores(spark, sf), ev.metric_summary(F.col("value")), ["metric"])


ANSWER_LOCALE_SQL = f"""(SELECT question_id, CASE WHEN len(list_filter(w, lambda x: list_contains({tx.ITALIAN_WORDS}, x)))
    > len(list_filter(w, lambda x: list_contains({tx.ENGLISH_WORDS}, x))) THEN 'it' ELSE 'en' END AS answer_locale
    FROM (SELECT question_id, regexp_extract_all(lower(question), '{tx.VOTE_WORD_PATTERN}') AS w FROM v_gold))"""


def answered(spark, sf):
    """Judge scores beside the language each answer was written in."""
    spoken = v.gold(spark, sf).select(
        "question_id", tx.detect_locale(F.col("question")).alias("answer_locale")
    )
    return v.scores(spark, sf).join(spoken, "question_id")


@query(
    "a05_rate",
    f"""SELECT round(avg(CASE WHEN locale = answer_locale THEN 1.0 ELSE 0.0 END), 9) AS consistency, count(*) AS answers
        FROM v_scores JOIN {ANSWER_LOCALE_SQL} USING (question_id) WHERE metric = 'faithfulness' AND value <> 'refused'""",
)
def a05(spark, sf):
    rows = answered(spark, sf).where("metric = 'faithfulness'")
    kept = F.col("value") != "refused"
    return rows.agg(
        ev.rate(F.col("locale") == F.col("answer_locale"), kept).alias("consistency"),
        F.count_if(kept).alias("answers"),
    )


@query(
    "a06_flag_lists",
    f"""SELECT 'language mismatch' AS flag, question_id FROM v_gold JOIN {ANSWER_LOCALE_SQL} USING (question_id) WHERE locale <> answer_locale
        UNION ALL SELECT 'faithful but irrelevant', question_id FROM (
            SELECT question_id, max(CASE metric WHEN 'faithfulness' THEN TRY_CAST(CASE WHEN value <> 'nan' THEN value END AS DOUBLE) END) AS f,
                   max(CASE metric WHEN 'relevancy' THEN TRY_CAST(CASE WHEN value <> 'nan' THEN value END AS DOUBLE) END) AS r FROM v_scores GROUP BY 1)
        WHERE f >= 0.5 AND r < 0.5""",
)
def a06(spark, sf):
    return ev.flag_lists(answered(spark, sf))


@query(
    "a08_routing_report",
    """SELECT count(*) AS questions, count(*) FILTER (routed = target) AS exact,
       count(*) FILTER (routed = target OR routed = 'both') AS wide, count(*) FILTER (routed = 'both') AS "both",
       count(*) FILTER (fallback) AS fallback FROM v_routes""",
)
def a08(spark, sf):
    return ev.routing_report(v.routes(spark, sf))


@query(
    "a09_label_agreement",
    "SELECT target, count(*) AS rows, count(*) FILTER (routed = target) AS agree FROM v_routes GROUP BY target",
)
def a09(spark, sf):
    return ev.label_agreement(v.routes(spark, sf), "target", "routed")


@query(
    "a09_confusion",
    """SELECT target, count(*) FILTER (routed = 'slides') AS slides, count(*) FILTER (routed = 'web') AS web,
       count(*) FILTER (routed = 'both') AS "both" FROM v_routes GROUP BY target""",
)
def a09_confusion(spark, sf):
    return ev.confusion(v.routes(spark, sf), "target", "routed", v.TARGETS)


@query(
    "a09_passage_labels",
    r"""SELECT label, predicted, count(*) AS pairs FROM (
        SELECT CASE WHEN doc_id % 5 = 0 THEN 'different' ELSE 'same' END AS label,
               CASE WHEN ta = tb THEN 'same' WHEN len(sa) > 0 AND len(sb) > 0 AND 2 * len(list_intersect(sa, sb)) >= len(sa) + len(sb) - len(list_intersect(sa, sb))
                     AND CASE WHEN len(na) <= len(nb) THEN list_has_all(nb, na) ELSE list_has_all(na, nb) END THEN 'same' ELSE 'different' END AS predicted
        FROM (SELECT doc_id, ta, tb, CASE WHEN len(wa) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(wa) - 1, 2)), lambda i: array_to_string(wa[i:i + 2], ' '))) END AS sa,
                     list_distinct(list_transform(range(1, greatest(len(wb) - 1, 2)), lambda i: array_to_string(wb[i:i + 2], ' '))) AS sb,
                     list_distinct(regexp_extract_all(ta, '\p{Nd}+')) AS na, list_distinct(regexp_extract_all(tb, '\p{Nd}+')) AS nb
              FROM (SELECT doc_id, text AS ta, text || ' and three more words', text || CASE WHEN doc_id % 2 = 0 THEN ' and three more words' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' 77' ELSE '' END AS tb,
                           regexp_extract_all(lower(ta), '[\p{L}\p{N}_]+') AS wa, regexp_extract_all(lower(tb), '[\p{L}\p{N}_]+') AS wb
                    FROM v_chunks WHERE kind = 'web')))
        GROUP BY 1, 2""",
)
def a09_passages(spark, sf):
    """Every web chunk beside an altered copy at another address, judged by the passage rule."""
    web = v.chunks(spark, sf).where("kind = 'web'")
    d = F.col("doc_id")
    altered = text_of(
        F.col("text"),
        F.when(d % 2 == 0, " and three more words").otherwise(""),
        F.when(d % 7 == 0, " 77").otherwise(""),
    )
    fields = [F.col("url"), F.col("content_hash")]
    pairs = web.select(
        F.when(d % 5 == 0, "different").otherwise("same").alias("label"),
        F.struct("text", *fields).alias("a"),
        F.struct(
            altered.alias("text"),
            F.concat(F.col("url"), F.lit("/copy")).alias("url"),
            "content_hash",
        ).alias("b"),
    )
    return passages.passage_labels(pairs)


@query(
    "a10_facet_counts",
    """SELECT kind, COALESCE(ingest_run_id, 'none') AS ingest_run_id, count(*) AS points FROM v_chunks GROUP BY 1, 2""",
)
def a10(spark, sf):
    from scriptorium.operators.index import facet_counts

    return facet_counts(v.chunks(spark, sf), "kind", "ingest_run_id").withColumn(
        "ingest_run_id", F.coalesce("ingest_run_id", F.lit("none"))
    )


@query(
    "a12_repeat_census",
    """SELECT count(*) AS texts, count(*) FILTER (urls > 1) AS repeated_texts, CAST(COALESCE(sum(urls) FILTER (urls > 1), 0) AS BIGINT) AS urls_involved,
       CAST(COALESCE(sum(points) FILTER (urls > 1), 0) AS BIGINT) AS points_involved,
       round(COALESCE(sum(points) FILTER (urls > 1), 0) / sum(points), 6) AS share FROM (
       SELECT text, count(DISTINCT url) AS urls, count(*) AS points FROM v_chunks WHERE kind = 'web' GROUP BY text)""",
)
def a12(spark, sf):
    return passages.repeat_census(v.chunks(spark, sf))


@query("x02_bm25_terms", "SELECT term, df, round(idf, 9) AS idf FROM v_terms")
def x02_terms(spark, sf):
    index = bm25.build_index(v.chunks(spark, sf).select("row_key", "text"))
    return index.terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(
    "x02_bm25_postings",
    "SELECT term, row_key, tf, doc_len FROM v_postings JOIN v_lengths USING (row_key)",
)
def x02_postings(spark, sf):
    index = bm25.build_index(v.chunks(spark, sf).select("row_key", "text"))
    return index.postings.select(
        "term", "row_key", "tf", F.col("doc_len").cast("long").alias("doc_len")
    )


@query("x03_sparse_search", "SELECT question_id, row_key, score, rn FROM v_sparse_top")
def x03(spark, sf):
    return sparse_hits(spark, sf)


@query("x03_index_search", "SELECT question_id, row_key, score, rn FROM v_sparse_top")
def x03_index(spark, sf):
    """The same ranking from a built index."""
    index = bm25.build_index(v.chunks(spark, sf).select("row_key", "text"))
    return bm25.search_index(index, v.gold(spark, sf))


def impact_search(spark, sf):
    built = bm25.build_index(v.chunks(spark, sf).select("row_key", "text"))
    return impact_index.search(impact_index.write(built, scratch_path(spark, "impacts")), v.gold(spark, sf))


@query("x03_impact_search", "SELECT question_id, row_key, score, rn FROM v_sparse_top")
def x03_impact(spark, sf):
    """The same ranking from postings by impact, of which most blocks stay unread."""
    return impact_search(spark, sf)[0]


@query(
    "x03_impact_blocks",
    r"""SELECT question_id, CAST(sum(ceil(df / 128)) AS BIGINT) AS blocks, true AS within FROM (
        SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM v_gold)
        JOIN (SELECT term, count(*) AS df FROM v_postings GROUP BY 1) USING (term) GROUP BY 1""",
)
def x03_blocks(spark, sf):
    """The blocks of each question's words, and whether no more than these were read."""
    reads = impact_search(spark, sf)[1]
    return reads.select("question_id", "blocks", ((F.col("read") > 0) & (F.col("read") <= F.col("blocks"))).alias("within"))


@query("x03_impact_reads")
def x03_reads(spark, sf):
    """Blocks of each question's words, and how many of them were read."""
    return impact_search(spark, sf)[1]


def vector_queries(spark, sf):
    """Every stored vector asks for its neighbours."""
    return v.dense(spark, sf).select(
        F.col("row_key").alias("query_id"), "embedding", F.col("text").alias("question")
    )


@query(
    "j09_vector_cross",
    """SELECT query_id, row_key, score, rn FROM (
        SELECT q.row_key AS query_id, d.row_key, round(list_cosine_similarity(q.embedding, d.embedding), 9) AS score,
               row_number() OVER (PARTITION BY q.row_key ORDER BY round(list_cosine_similarity(q.embedding, d.embedding), 9) DESC, d.row_key) AS rn
        FROM v_dense q, v_dense d) WHERE rn <= 5""",
)
def j09(spark, sf):
    return exact_search(
        v.dense(spark, sf).select("row_key", "embedding"),
        vector_queries(spark, sf).select("query_id", "embedding"),
        "query_id",
        k=5,
    )


CRAWLED_WEB = dict(ingest_source="crawl")
DENSE_TOP_SQL = """SELECT query_id, row_key, score, rn FROM (
    SELECT q.row_key AS query_id, d.row_key, round(list_cosine_similarity(q.embedding, d.embedding), 9) AS score,
           row_number() OVER (PARTITION BY q.row_key ORDER BY round(list_cosine_similarity(q.embedding, d.embedding), 9) DESC, d.row_key) AS rn
    FROM v_dense q JOIN v_dense d ON q.row_key <> d.row_key WHERE d.ingest_source = 'crawl') WHERE rn <= 20"""


@query("x04_dense_search", DENSE_TOP_SQL)
def x04(spark, sf):
    points = v.dense(spark, sf).where(payload_filter(**CRAWLED_WEB))
    return exact_search(
        points.select("row_key", "embedding"),
        vector_queries(spark, sf).select("query_id", "embedding"),
        "query_id",
        exclude_self=True,
    )


DENSE_SPARSE_SQL = r"""SELECT query_id, row_key, score, rn FROM (
    SELECT query_id, row_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_key) AS rn FROM (
        SELECT q.row_key AS query_id, p.row_key, round(sum(t.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / a.avg_len))), 9) AS score
        FROM dp p JOIN dt t USING (term) JOIN (SELECT DISTINCT row_key, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM v_dense) q USING (term)
             JOIN dl l ON l.row_key = p.row_key JOIN v_dense d ON d.row_key = p.row_key, (SELECT avg(doc_len) AS avg_len FROM dl) a
        WHERE q.row_key <> p.row_key AND d.ingest_source = 'crawl' GROUP BY 1, 2)) WHERE rn <= 20"""
DENSE_SPARSE_WITH = r"""WITH dp AS (SELECT row_key, term, count(*) AS tf FROM (SELECT row_key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM v_dense) GROUP BY 1, 2),
    dl AS (SELECT row_key, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS doc_len FROM v_dense),
    dt AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM dp GROUP BY 1), (SELECT count(*) AS n FROM dl))"""


@query(
    "x07_hybrid_search",
    f"""{DENSE_SPARSE_WITH} SELECT query_id, row_key, score, rn FROM (
        SELECT query_id, row_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_key) AS rn FROM (
            SELECT query_id, row_key, round(sum(1.0 / (rn + 1)), 9) AS score
            FROM (SELECT * FROM ({DENSE_TOP_SQL}) UNION ALL SELECT * FROM ({DENSE_SPARSE_SQL})) GROUP BY 1, 2)) WHERE rn <= 10""",
)
def x07(spark, sf):
    # The index at rest: both branches and their counts read it.
    points = written_once(
        v.dense(spark, sf).select("row_key", "text", "title", "embedding", "ingest_source", "ingest_run_id"), "points"
    )
    asked = points.select(F.col("row_key").alias("query_id"), "embedding", F.col("title").alias("question"))
    return retrieval.hybrid_search(
        points.drop("title"),
        asked,
        payload_filter(**CRAWLED_WEB),
        query="query_id",
        limit=10,
        exclude_self=True,
    )


def hashed_points(spark, sf):
    return encoding.encode_batch(v.chunks(spark, sf), "text")


def hashed_gold(spark, sf):
    return encoding.encode_batch(v.gold(spark, sf), "question")


def hash_hits(spark, sf):
    return exact_search(
        hashed_points(spark, sf).select("row_key", "embedding"),
        hashed_gold(spark, sf).select("question_id", "embedding"),
        "question_id",
    )


def fused_hits(spark, sf):
    return retrieval.hybrid_search(hashed_points(spark, sf), hashed_gold(spark, sf), limit=None)


@query(
    "e01_encode_batch",
    "SELECT row_key, slot, round(v, 9) AS value FROM v_hash_docs",
)
def e01(spark, sf):
    """The default encoder's vectors, in (row, slot, value) form."""
    vectors = hashed_points(spark, sf).select("row_key", F.posexplode("embedding").alias("slot", "v"))
    return vectors.where("v <> 0").select(
        "row_key", F.col("slot").cast("long").alias("slot"), F.round("v", 9).alias("value")
    )


@query(
    "e02_sparse_encode",
    """SELECT row_key, count(*) AS terms, md5(string_agg(slot || ':' || tf, ' ' ORDER BY slot)) AS vector FROM (
        SELECT row_key, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) AS slot, CAST(sum(tf) AS BIGINT) AS tf FROM v_postings GROUP BY 1, 2) GROUP BY 1""",
)
def e02(spark, sf):
    """Texts as (indices, values): hashed words and their counts."""
    from scriptorium.operators.encoding import sparse_encode

    coded = sparse_encode(v.chunks(spark, sf), "row_key", "text")
    printed = F.array_join(
        F.zip_with(
            "indices", "values", lambda i, x: F.concat(i.cast("string"), F.lit(":"), x.cast("string"))
        ),
        " ",
    )
    return coded.select(
        "row_key", F.size("indices").cast("long").alias("terms"), F.md5(printed).alias("vector")
    )


@query(
    "w01_branch_topk",
    """SELECT 'sparse' AS branch, question_id, row_key, score, rn FROM v_sparse_top
       UNION ALL SELECT 'dense', question_id, row_key, score, rn FROM v_hash_top""",
)
def w01(spark, sf):
    branches = {"sparse": sparse_hits(spark, sf), "dense": hash_hits(spark, sf)}
    return ranking.merge_pools(
        [hits.withColumn("branch", F.lit(name)) for name, hits in branches.items()]
    ).select("branch", "question_id", "row_key", "score", "rn")


@query("x05_rrf_fuse", "SELECT question_id, row_key, score, rn FROM v_fused")
def x05(spark, sf):
    return ranking.rrf_fuse([sparse_hits(spark, sf), hash_hits(spark, sf)], "question_id")


def reranked_hits(spark, sf, fused=None):
    pool = (
        (fused_hits(spark, sf) if fused is None else fused)
        .join(v.chunks(spark, sf).select("row_key", "text"), "row_key")
        .join(v.gold(spark, sf).select("question_id", "question"), "question_id")
    )
    return ranking.rerank(
        pool, "question_id", encoding.lexical_overlap(F.col("question"), F.col("text"))
    )


@query("x08_rerank", "SELECT question_id, row_key, score, rn FROM v_reranked")
def x08(spark, sf):
    return reranked_hits(spark, sf).select("question_id", "row_key", "score", "rn")


@query("e03_pair_scorer", "SELECT question_id, row_key, score, rn FROM v_reranked")
def e03(spark, sf):
    """The rerank again, through a user's scorer that runs in Arrow batches."""
    pool = (
        fused_hits(spark, sf)
        .join(v.chunks(spark, sf).select("row_key", "text"), "row_key")
        .join(v.gold(spark, sf).select("question_id", "question"), "question_id")
    )
    scorer = encoding.pair_scorer(encoding.overlap_scorer)
    return ranking.rerank(pool, "question_id", scorer(F.col("question"), F.col("text"))).select(
        "question_id", "row_key", "score", "rn"
    )


@query(
    "e04_judge_scores",
    """SELECT COALESCE(reason, 'scored') AS outcome, count(*) AS answers, round(avg(value), 6) AS mean FROM (
        SELECT CASE WHEN turn = 3 THEN 'failed' WHEN length(text) % 5 = 0 THEN 'nan' END AS reason,
               CASE WHEN turn <> 3 AND length(text) % 5 <> 0 THEN CAST(length(text) % 100 AS DOUBLE) / 100 END AS value
        FROM conversations WHERE role = 'assistant') GROUP BY 1""",
)
def e04(spark, sf):
    """Scores that never fail the job: values, nan and failures told apart."""
    answers = v.table(spark, sf, "conversations").where("role = 'assistant'")
    judged = encoding.judge_scores(answers, ["turn", "text"], encoding.length_judge)
    return judged.groupBy(F.coalesce("judgement.reason", F.lit("scored")).alias("outcome")).agg(
        F.count("*").alias("answers"), F.round(F.avg("judgement.value"), 6).alias("mean")
    )


@query(
    "w05_keep_first_above",
    "SELECT question_id, row_key, score, row_number() OVER (PARTITION BY question_id ORDER BY rn) AS rn FROM v_reranked WHERE rn = 1 OR score >= 0.5 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rn) <= 5",
)
def w05(spark, sf):
    return ranking.keep_first_above(
        reranked_hits(spark, sf), "question_id", ranking.RELEVANCE_CUTOFF, ranking.TOP_K
    ).select("question_id", "row_key", "score", "rn")


POOLS_SQL = """(SELECT f.question_id, f.row_key, f.score, c.kind, row_number() OVER (PARTITION BY f.question_id, c.kind ORDER BY f.rn) AS rn
    FROM v_fused f JOIN v_chunks c USING (row_key))"""


def pools(spark, sf):
    """The fused list of each question, split into one ranked pool per collection."""
    hits = fused_hits(spark, sf).join(v.chunks(spark, sf).select("row_key", "kind"), "row_key")
    from pyspark.sql import Window

    own = Window.partitionBy("question_id", "kind").orderBy("rn")
    ranked = cut_lineage(hits.withColumn("rn", F.row_number().over(own).cast("long")))
    return [ranked.where(F.col("kind") == k) for k in ("slides", "web")]


@query(
    "w03_round_robin",
    f"""SELECT question_id, row_key, row_number() OVER (PARTITION BY question_id ORDER BY rn, kind) AS rn FROM {POOLS_SQL}
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rn, kind) <= 10""",
)
def w03(spark, sf):
    return ranking.round_robin(pools(spark, sf), "question_id", 10).select(
        "question_id", "row_key", "rn"
    )


@query(
    "u01_merge_pools",
    f"SELECT question_id, kind, count(*) AS hits, min(row_key) AS first_key FROM {POOLS_SQL} GROUP BY 1, 2",
)
def u01(spark, sf):
    return (
        ranking.merge_pools(pools(spark, sf))
        .groupBy("question_id", "kind")
        .agg(F.count("*").alias("hits"), F.min("row_key").alias("first_key"))
    )


EDITIONS = [(f"C{c:03d}", f"{y}-{y + 1}") for c in range(0, 20, 3) for y in range(2020, 2025)]


def _collection_sql(kind: str, visible: str) -> str:
    """One collection's fused pool as a subquery: its own word weights, its own filter."""
    words_sql = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    return rf"""(WITH c AS (SELECT * FROM v_chunks WHERE kind = '{kind}'),
        p AS (SELECT row_key, term, count(*) AS tf FROM (SELECT row_key, unnest({words_sql}) AS term FROM c) GROUP BY 1, 2),
        l AS (SELECT row_key, len({words_sql}) AS doc_len FROM c),
        t AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), (SELECT count(*) AS n FROM l)),
        vis AS (SELECT row_key FROM c WHERE {visible}),
        s AS (SELECT question_id, row_key, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) AS rn FROM (
              SELECT q.question_id, p.row_key, round(sum(t.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / a.avg_len))), 9) AS score
              FROM v_query_terms q JOIN p USING (term) JOIN t USING (term) JOIN l ON l.row_key = p.row_key JOIN vis ON vis.row_key = p.row_key,
                   (SELECT avg(doc_len) AS avg_len FROM l) a GROUP BY 1, 2)),
        d AS (SELECT question_id, row_key, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) AS rn FROM (
              SELECT q.question_id, v.row_key, round(COALESCE(sum(q.v * h.v), 0), 9) AS score FROM v_hash_queries q JOIN v_hash_docs h USING (slot) JOIN vis v USING (row_key) GROUP BY 1, 2))
        SELECT question_id, row_key, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) AS rn FROM (
            SELECT question_id, row_key, round(sum(1.0 / (rn + 1)), 9) AS score
            FROM (SELECT * FROM s WHERE rn <= 20 UNION ALL SELECT * FROM d WHERE rn <= 20) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) <= 20)"""


EDITIONS_SQL = " OR ".join(f"(course = '{c}' AND academic_year = '{y}')" for c, y in EDITIONS)
RETRIEVE_SQL = rf"""WITH pool AS (
    SELECT question_id, row_key, rn AS was FROM {_collection_sql("slides", EDITIONS_SQL)}
    UNION ALL SELECT question_id, row_key, rn + 20 FROM {_collection_sql("web", "ingest_source = 'crawl'")}),
    scored AS (SELECT question_id, row_key, was, round(CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(g.question), '[\p{{L}}\p{{N}}_]+')),
        list_distinct(regexp_extract_all(lower(c.text), '[\p{{L}}\p{{N}}_]+')))) AS DOUBLE) / len(list_distinct(regexp_extract_all(lower(g.question), '[\p{{L}}\p{{N}}_]+'))), 9) AS score
        FROM pool JOIN v_gold g USING (question_id) JOIN v_chunks c USING (row_key)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, was) AS r0 FROM scored)
    SELECT question_id, row_key, score, row_number() OVER (PARTITION BY question_id ORDER BY r0) AS rn FROM ranked
    WHERE r0 = 1 OR score >= 0.5 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY r0) <= 5"""


SCOPE = retrieval.Scope(editions=EDITIONS, ingest_source="crawl")


@query("x09_retrieve_plain", RETRIEVE_SQL)
def x09_plain(spark, sf):
    return retrieval.retrieve(
        hashed_points(spark, sf), hashed_gold(spark, sf), SCOPE, collapsed=False
    )


@query("x09_retrieve")
def x09(spark, sf):
    """The whole retrieval, copies of a passage shown once."""
    return retrieval.retrieve(hashed_points(spark, sf), hashed_gold(spark, sf), SCOPE)


@query("x10_near_dup_pairs", "SELECT a, b, jaccard FROM v_near")
def x10(spark, sf):
    return passages.near_dup_pairs(v.chunks(spark, sf))


@query("x11_collapse")
def x11(spark, sf):
    """Each question's reranked pool with the copies of a passage collapsed."""
    pool = reranked_hits(spark, sf).drop("text", "question").join(v.chunks(spark, sf), "row_key")
    return passages.collapse(pool, "question_id")


KEEPER_SQL = r"""SELECT m.cluster, CASE WHEN bool_and(y > 0) THEN arg_min(row_key, (-y, -d, row_key)) ELSE arg_min(row_key, (-d, row_key)) END AS keeper, count(*) AS copies
    FROM (SELECT {cluster} AS cluster, c.row_key, COALESCE(TRY_CAST(regexp_extract(c.url, 'guide-(20\d\d)-', 1) AS INTEGER), 0) AS y,
                 CAST(epoch(CAST(c.fetch_date AS DATE)) / 86400 AS BIGINT) AS d
          FROM v_chunks c JOIN v_web_texts t USING (text) {join} WHERE c.kind = 'web') m GROUP BY 1"""


@query("x12_corpus_dedup_equal", KEEPER_SQL.format(cluster="t.text_key", join=""))
def x12_equal(spark, sf):
    return passages.corpus_dedup(v.chunks(spark, sf), near=False)


DEDUP_SQL = (
    "WITH RECURSIVE both_ways AS (SELECT a, b FROM v_near UNION ALL SELECT b, a FROM v_near), "
    "reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen), "
    "label AS (SELECT node, min(seen) AS component FROM reach GROUP BY node) "
    + KEEPER_SQL.format(
        cluster="COALESCE(lb.component, t.text_key)",
        join="LEFT JOIN label lb ON lb.node = t.text_key",
    )
)


@query("x12_corpus_dedup", DEDUP_SQL)
def x12(spark, sf):
    return passages.corpus_dedup(v.chunks(spark, sf))


@query("x12_batches_dedup", DEDUP_SQL)
def x12_batches(spark, sf):
    """The same clusters, the corpus having come in three batches by document."""
    chunks, held = v.chunks(spark, sf), Clusters(spark, scratch_path(spark, "clusters"))
    for batch in range(3):
        held.add(chunks.where(F.pmod(doc_of(F.col("row_key")), F.lit(3)) == 2 - batch), batch)
    return held.clusters(3)


def arm_hits(spark, sf):
    """Both arms' first ten hits, with the document each lies in.

    The fused pools are a few dozen rows per question; they are written once and both
    arms read them.
    """
    fused = cut_lineage(fused_hits(spark, sf))
    arms = {"fusion": fused, "rerank": reranked_hits(spark, sf, fused)}
    return ranking.merge_pools(
        [
            hits.where(F.col("rn") <= ev.MRR_CUT).select(
                F.lit(arm).alias("arm"),
                "question_id",
                doc_of(F.col("row_key")).alias("doc_id"),
                "rn",
            )
            for arm, hits in arms.items()
        ]
    )


def arm_ranks(spark, sf):
    return ev.first_hit_rank(
        arm_hits(spark, sf), v.truth(spark, sf), v.gold(spark, sf), arms=["fusion", "rerank"]
    )


@query(
    "x25_evaluate_run",
    f"""SELECT arm, COALESCE(locale, 'all') AS "group", {SUMMARY_SQL} FROM v_ranks GROUP BY GROUPING SETS ((arm), (arm, locale))""",
)
def x25(spark, sf):
    return ev.by_locale(arm_ranks(spark, sf), ev.retrieval_summary(F.col("rank")), ["arm"])


@query(
    "x25_artefact_rows",
    """SELECT question_id, locale, COALESCE(CAST(max(rank) FILTER (arm = 'fusion') AS VARCHAR), 'none') AS fusion,
       COALESCE(CAST(max(rank) FILTER (arm = 'rerank') AS VARCHAR), 'none') AS rerank FROM v_ranks GROUP BY 1, 2""",
)
def x25_rows(spark, sf):
    """The run's artefact: a row per question with its rank on each arm."""
    wide = (
        arm_ranks(spark, sf)
        .groupBy("question_id", "locale")
        .pivot("arm", ["fusion", "rerank"])
        .agg(F.first("rank"))
    )
    return wide.select(
        "question_id", "locale", *[nullable(F.col(a)).alias(a) for a in ("fusion", "rerank")]
    )


@query(
    "j07_ground_truth_join",
    """SELECT g.question_id, COALESCE(CAST(min(h.rn) AS VARCHAR), 'none') AS rank FROM v_gold g LEFT JOIN (
        SELECT s.question_id, s.rn FROM v_sparse_top s JOIN v_chunks c USING (row_key)
        JOIN (SELECT question_id, doc_id % 3 <> 0 AS web, 'https://' || source || '.example.org/g/guide-' || (2019 + doc_id % 6) || '-p' || (doc_id % 60) AS url,
                     'd' || (doc_id % 400) || '.pdf' AS file FROM v_truth JOIN documents USING (doc_id)) t ON t.question_id = s.question_id
        WHERE (t.web AND c.url = t.url) OR (NOT t.web AND c.source_file = t.file AND (c.page = 1 OR c.page + 1 = 1))) h
       ON h.question_id = g.question_id GROUP BY 1""",
)
def j07(spark, sf):
    """First hit on the truth's page: web pages by address, decks by file and page."""
    payload = v.chunks(spark, sf).select(
        "row_key", "url", "source_file", F.array("page", F.col("page") + 1).alias("pages")
    )
    hits = sparse_hits(spark, sf).join(payload, "row_key")
    lead = v.whole_chunks(spark, sf).select(
        "doc_id",
        F.concat(F.col("url"), F.lit("/")).alias("url"),
        F.col("source_file"),
        F.lit(1).cast("long").alias("page"),
    )
    wanted = v.truth(spark, sf).join(lead, "doc_id").drop("doc_id")
    return ev.rank_by_url_or_page(hits, wanted, v.gold(spark, sf)).select(
        "question_id", nullable(F.col("rank")).alias("rank")
    )


@query(
    "a07_source_histogram",
    """SELECT sources, count(*) AS questions FROM (SELECT question_id, count(DISTINCT c.doc_id) AS sources
       FROM v_sparse_top JOIN v_chunks c USING (row_key) GROUP BY 1) GROUP BY 1""",
)
def a07(spark, sf):
    kept = sparse_hits(spark, sf).withColumn("doc_id", doc_of(F.col("row_key")))
    return (
        kept.groupBy("question_id")
        .agg(F.countDistinct("doc_id").alias("sources"))
        .groupBy("sources")
        .agg(F.count("*").alias("questions"))
    )


@query(
    "u04_run_equality",
    """SELECT 'left' AS side, question_id, row_key, rn FROM (
        SELECT question_id, row_key, rn FROM v_sparse_top WHERE rn <= 10 EXCEPT SELECT question_id, row_key, rn FROM v_hash_top WHERE rn <= 10)
       UNION ALL SELECT 'right', question_id, row_key, rn FROM (
        SELECT question_id, row_key, rn FROM v_hash_top WHERE rn <= 10 EXCEPT SELECT question_id, row_key, rn FROM v_sparse_top WHERE rn <= 10)""",
)
def u04(spark, sf):
    """Where two branches' top tens differ; a run against itself gives no row."""
    first = sparse_hits(spark, sf, 10).select("question_id", "row_key", "rn")
    second = hash_hits(spark, sf).where("rn <= 10").select("question_id", "row_key", "rn")
    return ev.symmetric_difference(first, second)


def some_vectors(spark, sf):
    """The stated query set of approximate search: every twentieth vector, against all."""
    asked = v.dense(spark, sf).where("vec_id % 20 = 0")
    return asked.select(F.col("row_key").alias("query_id"), "embedding")


def indexed_vectors(spark, sf):
    points = written_once(v.dense(spark, sf).select("row_key", "embedding"), "vectors")
    return points, vector_index.build(points, scratch_path(spark, "vector-index"))


@query(
    "x26_ann_recall",
    """SELECT query_id, string_agg(row_key, ',' ORDER BY rn) AS neighbours, true AS enough, true AS few FROM (
        SELECT q.row_key AS query_id, d.row_key,
               row_number() OVER (PARTITION BY q.row_key ORDER BY round(list_cosine_similarity(q.embedding, d.embedding), 9) DESC, d.row_key) AS rn
        FROM v_dense q JOIN v_dense d ON q.row_key <> d.row_key WHERE q.vec_id % 20 = 0) WHERE rn <= 20 GROUP BY 1""",
)
def x26(spark, sf):
    """Each query's exact neighbours; whether the index finds nine tenths of all, and scores a fifth of the points at most."""
    points, built = indexed_vectors(spark, sf)
    asked = some_vectors(spark, sf)
    exact = written_once(exact_search(points, asked, "query_id", exclude_self=True), "exact")
    found = written_once(vector_index.search(built, points, asked, "query_id", exclude_self=True), "found")
    whole = recall_at_k(found, exact, "query_id").agg((F.avg("recall") >= 0.9).alias("enough"))
    rows = points.agg(F.count("*").alias("rows"))
    few = found.agg(F.max("scored").alias("most")).join(rows).select((F.col("most") <= F.greatest(0.2 * F.col("rows"), F.lit(PREFETCH))).alias("few"))
    listed = exact.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rn", "row_key"))).alias("near"))
    # one row each side: both figures are of the whole run
    return listed.select("query_id", F.array_join("near.row_key", ",").alias("neighbours")).join(F.broadcast(whole.join(few)))


@query("x26_index_search")
def x26_search(spark, sf):
    """What the index finds for every twentieth vector, with the points it scored and scanned for it."""
    points, built = indexed_vectors(spark, sf)
    return vector_index.search(built, points, some_vectors(spark, sf), "query_id", exclude_self=True)


@query(
    "e06_vote",
    f"""SELECT doc_id, CASE WHEN it > en THEN 'it' ELSE 'en' END AS locale, CAST(en AS BIGINT) AS en, CAST(it AS BIGINT) AS it FROM (
        SELECT doc_id, sum(len(list_filter(w, lambda x: list_contains({tx.ENGLISH_WORDS}, x)))) AS en,
               sum(len(list_filter(w, lambda x: list_contains({tx.ITALIAN_WORDS}, x)))) AS it FROM (
            SELECT doc_id, regexp_extract_all(lower(text), '{tx.VOTE_WORD_PATTERN}') AS w FROM v_chunks) GROUP BY 1)""",
)
def e06(spark, sf):
    """A document's language as a vote over its blocks: two sums and a comparison."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(tx.VOTE_WORD_PATTERN), 0)
    blocks = v.chunks(spark, sf).select("doc_id", found.alias("w"))
    counts = blocks.groupBy("doc_id").agg(
        F.sum(tx.votes(F.col("w"), tx.ENGLISH_WORDS)).alias("en"),
        F.sum(tx.votes(F.col("w"), tx.ITALIAN_WORDS)).alias("it"),
    )
    return counts.select(
        "doc_id",
        tx.winner([("en", F.col("en")), ("it", F.col("it"))]).alias("locale"),
        "en",
        "it",
    )
