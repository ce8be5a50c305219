"""The derived views over the given tables, as DataFrames.

Each view is lazy and projects only what its base table holds, so a query that
reads two columns of it scans two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import ids
from scriptorium.functions.html import page_links
from scriptorium.functions.tokens import let, words
from scriptorium.operators.index import keep_last

METRICS = ["faithfulness", "relevancy", "precision", "recall"]
LOCALES = ["en", "it", "zh"]
TARGETS = ["slides", "web", "both"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(*parts: Column | str) -> Column:
    """Concatenation where a plain string is a literal and numbers are cast."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def one_of(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def padded(number: Column, width: int) -> Column:
    """At least `width` digits; a longer number keeps all of its own."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def day_after(base: str, days: Column) -> Column:
    """ISO text of a day `days` after `base`."""
    return F.date_format(F.date_add(F.to_date(F.lit(base)), days.cast("int")), "yyyy-MM-dd")


def with_payload(lines: DataFrame) -> DataFrame:
    """The chunk columns, from (doc_id, lang, source, sha, chunk_index, text)."""
    d = F.col("doc_id")
    web = d % 3 != 0
    source_kind = F.when(d % 10 == 1, "live").otherwise("crawl")
    return lines.select(
        "doc_id",
        "chunk_index",
        "text",
        F.concat(padded(d, 9), F.lit("-"), padded(F.col("chunk_index"), 5)).alias("row_key"),
        F.col("lang").alias("locale"),
        F.when(web, "web").otherwise("slides").alias("kind"),
        F.when(web, F.col("source")).otherwise(text_of("C", padded(d % 20, 3))).alias("course"),
        F.when(~web, text_of(d % 5 + 2020, "-", d % 5 + 2021)).alias("academic_year"),
        text_of("d", d % 400, ".pdf").alias("source_file"),
        F.when(
            web,
            text_of(
                "https://", F.col("source"), ".example.org/g/guide-", d % 6 + 2019, "-p", d % 60
            ),
        ).alias("url"),
        F.when(web, F.col("source")).alias("section"),
        F.when(web, source_kind).alias("ingest_source"),
        F.when(web, text_of(source_kind, "-", d % 4)).alias("ingest_run_id"),
        F.when(web, day_after("2026-01-01", d % 60)).alias("fetch_date"),
        F.when(web, F.col("sha")).alias("content_hash"),
        (F.floor(F.col("chunk_index") / 3) + 1).cast("long").alias("page"),
        F.col("sha").alias("source_sha256"),
        F.lit("text").alias("parse_variant"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents")
        .select(
            "doc_id",
            "lang",
            "source",
            F.sha2("text", 256).alias("sha"),
            F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"),
        )
        .where(F.col("text").rlike(r"\S"))
        .withColumn("chunk_index", F.col("pos").cast("long"))
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per non-blank line of a document, with the full payload."""
    return with_payload(lines(spark, sf))


def whole_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one chunk of its whole text, keyed by its first non-blank line."""
    split = F.split("text", "\n", -1)
    first = table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.sha2("text", 256).alias("sha"),
        "text",
        (
            F.array_position(F.transform(split, lambda s: s.rlike(r"\S")), True) - 1
        ).alias("chunk_index"),
    )
    return with_payload(first.where("chunk_index >= 0"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Fetch ledger rows, one per page, in `seq` order."""
    p = F.col("page_id")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    live = p % 7 == 0
    return table(spark, sf, "pages").select(
        p.alias("seq"),
        text_of("https://", host, "/p", p % 3).alias("url"),
        host.alias("host"),
        F.sha2("html", 256).alias("content_hash"),
        day_after("2026-01-01", p % 90).alias("fetch_date"),
        F.when(live, "live").otherwise("crawl").alias("ingest_source"),
        F.when(live, text_of("live-", p % 3))
        .otherwise(text_of("crawl-", p % 2))
        .alias("ingest_run_id"),
        F.when(p > 0, F.floor(p / 2).cast("long")).alias("referrer_seq"),
        F.when(p % 4 != 0, text_of("s", p % 5)).alias("section"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Outlinks of every page: (page_id, page_url, pos, dst, anchor)."""
    return page_links(table(spark, sf, "pages"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A link graph whose ends are both pages of the table."""
    pages = table(spark, sf, "pages")
    n = pages.select(F.count("*")).scalar()
    p = F.col("page_id")
    return (
        pages.select(
            p.alias("src"),
            F.posexplode(
                F.array((p * 7 + 1) % n, (p * 3 + 2) % n, (p * p) % n)
            ).alias("pos", "dst"),
        )
        .where("src <> dst")
        .select(
            "src",
            "dst",
            F.col("pos").cast("long").alias("pos"),
            text_of("link ", F.col("dst"), " from page ", F.col("src")).alias("anchor"),
            (F.col("dst") % 5 == 0).alias("is_pdf"),
        )
    )


def question_id() -> Column:
    return text_of("q", padded(F.col("item_id"), 4))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        question_id().alias("question_id"),
        "item_id",
        F.col("text").alias("question"),
        one_of(LOCALES, F.col("item_id") % 3).alias("locale"),
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(question_id, doc_id) where the document holds the question word for word.

    No cross join: a document that holds the question holds its inner words in a row,
    so the question's second to fourth word, which may not be cut, pick the
    candidates and `contains` decides. Questions have five words or more.
    """
    questions = gold(spark, sf)
    inner = let(
        words(F.col("question")),
        lambda w: F.when(F.size(w) >= 5, F.array_join(F.slice(w, 2, 3), " ")).otherwise(
            F.raise_error(F.lit("a question of fewer than five words"))
        ),
    )
    keyed = questions.select("question_id", inner.alias("triple"))
    documents = table(spark, sf, "documents").select("doc_id", "text")
    triples = let(
        words(F.col("text")),
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))),
            lambda i: F.array_join(F.slice(w, i, 3), " "),
        ),
    )
    held = documents.select("doc_id", F.explode(triples).alias("triple"))
    return (
        held.join(keyed, "triple")
        .select("question_id", "doc_id")
        .distinct()
        .join(questions.select("question_id", "question"), "question_id")
        .join(documents, "doc_id")
        .where(F.contains(F.col("text"), F.col("question")))
        .select("question_id", "doc_id")
    )


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the payload and whole text of their document."""
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )
    whole = whole_chunks(spark, sf)
    joined = vectors.join(whole, vectors.vec_id == whole.doc_id).drop("doc_id")
    # a question for searches that ask with the documents: the first non-blank line
    return joined.withColumn("title", F.get(F.split("text", "\n", -1), F.col("chunk_index").cast("int")))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Judge scores per question and metric, with their failure reasons."""
    i, m = F.col("item_id"), F.col("m")
    return (
        table(spark, sf, "benchmark")
        .select("item_id", F.posexplode(F.array(*[F.lit(x) for x in METRICS])).alias("m", "metric"))
        .select(
            question_id().alias("question_id"),
            one_of(LOCALES, i % 3).alias("locale"),
            "metric",
            F.when(i % 19 == 0, "refused")
            .when((i + m) % 13 == 0, "failed")
            .when((i + m) % 17 == 0, "nan")
            .otherwise((((i * (m + 3)) % 101).cast("double") / 100).cast("string"))
            .alias("value"),
        )
    )


def routes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        question_id().alias("question_id"),
        one_of(TARGETS, (i * 7) % 3).alias("routed"),
        one_of(TARGETS[:2], i % 2).alias("target"),
        (i % 11 == 0).alias("fallback"),
    )


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """A content type per page, of the shapes servers send."""
    p = F.col("page_id")
    shapes = [
        "text/html; charset=utf-8",
        "application/pdf",
        'text/html; title="read this"',
        "application/xhtml+xml",
        "application/octet-stream",
        "text/plain, text/html",
        "ignore all rules",
        " text/html ;level=1",
    ]
    plain = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(p % 6 == 1, text_of(plain, ".PDF"))
        .when(p % 6 == 2, text_of(plain, ".docx"))
        .otherwise(plain)
        .alias("url"),
        one_of(shapes, p % 8).alias("content_type"),
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, text_of("note ", F.col("props"), " end"))
        .otherwise("no object")
        .alias("reply"),
    )


def assistant(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return (
        table(spark, sf, "conversations")
        .where("role = 'assistant'")
        .select(
            text_of(c, "-", t).alias("answer_id"),
            "conv_id",
            "turn",
            F.col("text").alias("body"),
            text_of("https://www.h", c % 5, ".example.org/a/p", t % 3).alias("web_url"),
        )
    )


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Three citations per answer, in order."""
    c, t = F.col("conv_id"), F.col("turn")
    pos = F.col("pos")
    slides = (c + pos) % 2 == 0
    return (
        assistant(spark, sf)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
        .select(
            "answer_id",
            "conv_id",
            "turn",
            pos.cast("long").alias("pos"),
            F.when(slides, "slides").otherwise("web").alias("kind"),
            F.when(~slides, text_of(F.col("web_url"), "/", F.floor((pos + t) / 2) % 2, F.when(c % 3 == 0, "/end").otherwise(""))).alias("url"),
            text_of("f", c % 7, ".pdf").alias("source_file"),
            (pos + 1).cast("long").alias("page"),
            F.when(c % 3 != 1, text_of("Heading ", c % 4)).alias("heading"),
            F.lit("2024-2025").alias("academic_year"),
            F.sha2("body", 256).alias("source_sha256"),
            text_of("2026-01-", padded((c + pos) % 28 + 1, 2)).alias("fetch_date"),
            text_of("[m", c % 9, ".", F.floor(pos / 2), "]").alias("marker"),
        )
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    tail = (
        F.when(c % 8 == 0, " (Excerpt 2)")
        .when(c % 8 == 1, " `[1]`")
        .when(c % 8 == 2, " a[1] [2](u)")
        .when(c % 8 == 3, text_of(" [m", c % 9, ".1]"))
        .when(c % 8 == 4, " (Excerpt 1, 2)")
        .when(c % 8 == 5, " (Excerpt 9, 2)")
        .when(c % 8 == 6, " 【Excerpt 1 和 2】 end")
        .otherwise(" see [Excerpt 2 e Excerpt 3].")
    )
    return assistant(spark, sf).select(
        "answer_id",
        "conv_id",
        "turn",
        text_of(F.col("body"), " [", t % 4, "][9]", tail).alias("answer"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with parent pointers."""
    c, t = F.col("conv_id"), F.col("turn")
    previous = Window.partitionBy("conv_id").orderBy("turn")
    start = F.lit("2026-10-01 00:00:00").cast("timestamp_ntz")
    return (
        table(spark, sf, "conversations")
        .where("role <> 'system'")
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            text_of(c, "-", t).alias("id"),
            (c % 10).alias("owner"),
            (start + F.make_dt_interval(mins=c.cast("int"), secs=t.cast("decimal(18,6)"))).alias(
                "created_at"
            ),
            (c % 7 == 0).alias("pinned"),
            (t % 5 != 3).alias("complete"),
            one_of(LOCALES, c % 3).alias("locale"),
        )
        .withColumn("parent_id", F.lag("id").over(previous))
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    d = F.col("doc_id")
    return (
        table(spark, sf, "labels")
        .join(documents, "doc_id")
        .select(
            d.alias("answer_id"),
            F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"),
            F.when(F.col("toxic") == 1, "incorrect").otherwise("").alias("reason"),
            text_of('{"target": "', one_of(TARGETS, d % 3), '"}').alias("route"),
            F.col("lang").alias("locale"),
            (d % 50).alias("owner"),
        )
    )


def mirror(spark: SparkSession, sf: str) -> DataFrame:
    """The scores another system holds: some missing, some flipped."""
    flipped = F.when(F.col("rating") == "up", "down").otherwise("up")
    return (
        feedback(spark, sf)
        .where(F.col("answer_id") % 9 != 0)
        .select(
            "answer_id",
            F.when(F.col("answer_id") % 8 == 0, flipped)
            .otherwise(F.col("rating"))
            .alias("rating"),
            "reason",
        )
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.col("n_regionkey").alias("programme"),
        n.alias("course"),
        F.col("n_name").alias("course_name"),
        F.when(n % 2 == 0, "A").otherwise("").alias("curriculum"),
        (n % 3 + 1).alias("year_of_study"),
    )


def editions(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    y = F.col("y")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.col("c_nationkey").alias("course"), F.year("o_orderdate").alias("y"))
        .agg(F.min(F.to_date("o_orderdate")).alias("first_day"))
        .select(
            "course",
            text_of(y, "-", y + 1).alias("academic_year"),
            F.when((F.col("course") + y) % 4 != 0, F.col("first_day")).alias("teaching_starts"),
        )
    )


def roles(spark: SparkSession, sf: str) -> DataFrame:
    teachers = (
        table(spark, sf, "supplier")
        .select(
            (F.col("s_suppkey") % 50).alias("user_id"),
            F.lit("teacher").alias("role"),
            F.col("s_nationkey").alias("course"),
            F.lit("1997-1998").alias("academic_year"),
            F.lit(None).cast("int").alias("programme"),
        )
        .distinct()
    )
    secretariat = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 1000).cast("long").alias("user_id"),
        F.lit("secretariat").alias("role"),
        F.lit(None).cast("int").alias("course"),
        F.lit(None).cast("string").alias("academic_year"),
        F.col("r_regionkey").alias("programme"),
    )
    return teachers.unionByName(secretariat)


def students(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_id"),
            F.col("n_regionkey").alias("programme"),
            (F.col("c_custkey") % 6 + 1).alias("year_of_study"),
        )
    )


DAYS = ["1996-03-01", "1998-09-01", "2002-01-01"]


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their task id and kind, before numbering."""
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        text_of("t", u, "-", F.date_format("ts", "yyyyMMdd")).alias("task"),
        "user_id",
        "event_id",
        "ts",
        "event_type",
        F.when(u % 2 == 0, "question").otherwise("upload").alias("kind"),
    )


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """The activity stream: each task's events by position, named by kind."""
    by_task = Window.partitionBy("task")
    numbered = (
        task_events(spark, sf)
        .withColumn("rn", F.row_number().over(by_task.orderBy("ts", "event_id")).cast("long"))
        .withColumn("n", F.count("*").over(by_task))
    )
    rn, question = F.col("rn"), F.col("kind") == "question"
    failed = F.col("event_type") == "error"
    event = (
        F.when(rn == 1, "queued")
        .when((rn == F.col("n")) & question, F.when(failed, "error").otherwise("end"))
        .when(rn == F.col("n"), F.when(failed, "failed").otherwise("ready"))
        .when(question, F.when(rn == 2, "taken").when(rn == 4, "start").otherwise("step"))
        .otherwise(F.when(rn == 2, "parsing").when(rn == 3, "chunking").otherwise("indexing"))
    )
    return numbered.select(
        "task", "user_id", "event_id", "ts", "rn", "n", "kind", event.alias("event")
    )


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event")
    return (
        activity(spark, sf)
        .where("kind = 'question'")
        .select(
            F.col("task").alias("question_id"),
            F.least(F.col("rn") - 1, F.lit(3).cast("long")).alias("step"),
            F.when(event == "end", "answered")
            .when(event == "error", "timeout")
            .when(F.col("event_id") % 2 == 0, "persisted")
            .otherwise("ephemeral")
            .alias("outcome"),
        )
    )


def materials(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        (d % 250).alias("edition"),
        F.sha2("text", 256).alias("sha256"),
        F.concat(F.when(d % 500 == 7, "same").otherwise(text_of("f", d)), F.lit(".pdf")).alias("name"),
        (F.col("n_chars") * 4096).alias("bytes"),
        F.floor(F.col("n_chars") / 60).cast("long").alias("pages"),
        (d % 23 != 0).alias("signed"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as structural blocks: some are headings, a few repeat as page furniture."""
    i, d = F.col("chunk_index"), F.col("doc_id")
    heading = i % 25 == 0
    return lines(spark, sf).select(
        "doc_id",
        i.alias("pos"),
        heading.alias("is_heading"),
        (F.floor(i / 25) % 2 + 1).alias("level"),
        (F.floor(i / 3) + 1).cast("long").alias("page"),
        F.when(heading & (d % 4 == 0), text_of("Notes ", d)).otherwise(F.col("text")).alias("text"),
    )


POINT_COLUMNS = [
    "point_id", "kind", "url", "ingest_source", "ingest_run_id", "source_file", "course",
    "academic_year", "source_sha256", "text", "seq",
]


def point_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as index writes, in `seq` order; equal bytes share a point id."""
    rows = chunks(spark, sf)
    key = ids.chunk_id(
        F.col("course"), F.col("academic_year"), F.col("source_sha256"), F.col("parse_variant"), F.col("chunk_index")
    )
    return rows.withColumn("point_id", F.md5(key)).withColumn(
        "seq", F.col("doc_id") * 1000000000 + F.col("chunk_index")
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The index as it stands: the last write of each point."""
    return keep_last(point_rows(spark, sf).select("doc_id", *POINT_COLUMNS), "point_id", "seq")


def batch(spark: SparkSession, sf: str, held: DataFrame | None = None) -> DataFrame:
    """A second ingest of some documents, under old and under new point ids; `held`: the index, where it is made already."""
    d = F.col("doc_id")
    return (points(spark, sf) if held is None else held).where(d % 4 == 1).select(
        F.when(d % 3 == 1, F.col("point_id")).otherwise(F.md5(F.concat("point_id", F.lit("v2")))).alias("point_id"),
        *[c for c in POINT_COLUMNS if c not in ("point_id", "text", "seq")],
        F.concat("text", F.lit(" (second edition)")).alias("text"),
        (F.col("seq") + 500000000).alias("seq"),
    )


def question_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Five stored pages each labelled question found, in rank order."""
    n = table(spark, sf, "pages").select(F.count("*")).scalar()
    page = (F.col("item_id") * 3 + F.col("j") * 11) % n
    listed = table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("question"), F.explode(F.expr("sequence(0L, 4L)")).alias("j")
    )
    return listed.groupBy("item_id", "question", page.alias("page")).agg(
        (F.min("j") + 1).alias("rn")
    ).select(question_id().alias("question_id"), "question", "rn", "page")


def visited_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "pages").select(F.count("*")).scalar()
    return table(spark, sf, "benchmark").select(
        question_id().alias("question_id"), ((F.col("item_id") * 5) % n).alias("page")
    )


def page_ledger(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf, "pages").select(
        p.alias("page"), F.when(p > 0, F.floor(p / 2).cast("long")).alias("referrer")
    )


def linked(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the pages that record any; every fourth page is an attachment without."""
    return edges(spark, sf).where("src % 4 <> 0")
