"""Registered queries of sources, the ledger, chunking and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from scriptorium.operators import chunking, index
from scriptorium.operators.table_store import Store
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.views import text_of
from scriptorium.session import scratch_path, written_once
from scriptorium.sources import files, jsonl, ledger

GOLD_SCHEMA = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("locale", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)


@query(
    "s01_jsonl_scan_strict",
    """SELECT question_id, item_id, question, locale, CASE WHEN item_id % 3 = 0 THEN 'web' ELSE 'slides' END AS target FROM v_gold""",
)
def s01(spark, sf):
    """Labelled questions through a JSONL file: typed, complete, with a default target."""
    path = scratch_path(spark, "gold")
    target = F.when(F.col("item_id") % 3 == 0, "web")
    v.gold(spark, sf).withColumn("target", target).write.json(path)
    return jsonl.read_strict(
        spark, path, GOLD_SCHEMA, ["question_id", "question"], {"target": F.lit("slides")}
    )


@query(
    "s02_jsonl_scan_tolerant",
    """SELECT CASE WHEN page_id % 9 = 4 THEN 'rejected' WHEN page_id % 9 = 5 THEN 'rejected' ELSE 'read' END AS lines, count(*) AS n
       FROM pages GROUP BY 1""",
)
def s02(spark, sf):
    """A ledger file with cut and foreign lines: what is read and what is set aside."""
    path = scratch_path(spark, "ledger")
    row = F.to_json(F.struct("seq", "url", "content_hash"))
    line = (
        F.when(F.col("seq") % 9 == 4, F.expr("left(line, length(line) - 7)"))
        .when(F.col("seq") % 9 == 5, F.lit('{"seq": 3}'))
        .otherwise(F.col("line"))
    )
    v.registry(spark, sf).withColumn("line", row).select(line.alias("value")).write.text(path)
    schema = T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("url", T.StringType()),
            T.StructField("content_hash", T.StringType()),
        ]
    )
    good, bad = jsonl.read_tolerant(spark, path, schema, ["seq", "url"])
    return good.agg(F.lit("read").alias("lines"), F.count("*").alias("n")).unionByName(
        bad.agg(F.lit("rejected").alias("lines"), F.count("*").alias("n"))
    )


@query(
    "s03_ledger_append",
    """SELECT ingest_run_id, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq FROM v_registry GROUP BY 1""",
)
def s03(spark, sf):
    """A ledger grown by one append per kind of run."""
    path = scratch_path(spark, "ledger")
    rows = v.registry(spark, sf)
    for kind in ("crawl", "live"):
        jsonl.append_rows(rows.where(F.col("ingest_source") == kind), path)
    return (
        spark.read.schema(rows.schema)
        .json(path)
        .groupBy("ingest_run_id")
        .agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    )


@query(
    "s04_latest_by_url",
    """SELECT url, seq, content_hash, fetch_date, ingest_run_id FROM v_registry
       QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1""",
)
def s04(spark, sf):
    return ledger.latest_by_url(v.registry(spark, sf)).select(
        "url", "seq", "content_hash", "fetch_date", "ingest_run_id"
    )


@query(
    "s05_snapshot_write",
    """SELECT ingest_run_id, count(*) AS pages, count(DISTINCT url) AS urls, min(fetch_date) AS first_fetch, max(fetch_date) AS last_fetch
       FROM v_registry GROUP BY 1""",
)
def s05(spark, sf):
    return ledger.write_snapshot(v.registry(spark, sf), scratch_path(spark, "snapshot"))


MANIFEST_SQL = """(SELECT p.page_id, p.url, CASE WHEN l.seq IS NULL THEN 'no ledger row' ELSE 'parsed' END AS status,
    COALESCE(l.section, 'web') AS section, l.ingest_run_id FROM (
        SELECT seq AS page_id, CASE WHEN seq % 10 = 9 THEN url || '/gone' ELSE url END AS url FROM v_registry) p
    LEFT JOIN (SELECT * FROM v_registry QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1) l USING (url))"""


def manifest_rows(spark, sf):
    gone = F.when(F.col("seq") % 10 == 9, F.concat("url", F.lit("/gone"))).otherwise(F.col("url"))
    manifest = v.registry(spark, sf).select(F.col("seq").alias("page_id"), gone.alias("url"))
    return ledger.manifest_provenance(manifest, v.registry(spark, sf))


@query("s06_manifest_registry_join", f"SELECT * FROM {MANIFEST_SQL}")
def s06(spark, sf):
    return manifest_rows(spark, sf).select("page_id", "url", "status", "section", "ingest_run_id")


@query("s06_manifest_tally", f"SELECT status, count(*) AS pages FROM {MANIFEST_SQL} GROUP BY 1")
def s06_tally(spark, sf):
    return manifest_rows(spark, sf).groupBy("status").agg(F.count("*").alias("pages"))


@query("s07_directory_scan")
def s07(spark, sf):
    """The given folder as a table of its Parquet files."""
    return files.directory_scan(spark, sf, ".PARQUET").select("name", "bytes")


@query(
    "s08_sidecar_pairing",
    """SELECT 'out/d' || doc_id AS stem, CASE WHEN doc_id % 7 = 0 THEN 'no sidecar' WHEN doc_id % 11 = 0 THEN 'no document' ELSE 'paired' END AS status FROM documents""",
)
def s08(spark, sf):
    """A listing of documents and sidecars, some of either alone."""
    d = F.col("doc_id")
    stem = text_of("out/d", d)
    document = F.when((d % 11 != 0) | (d % 7 == 0), F.concat(stem, F.lit(".json")))
    sidecar = F.when(d % 7 != 0, F.concat(stem, F.lit(".meta.json")))
    paths = v.table(spark, sf, "documents").select(
        F.explode(F.array_compact(F.array(document, sidecar))).alias("path")
    )
    return files.sidecar_pairing(paths)


@query("s09_frozen_sink", "SELECT count(*) AS rows, count(DISTINCT answer_id) AS answers FROM v_answers")
def s09(spark, sf):
    """Answers written once, then read back by the identity of what was written."""
    path = scratch_path(spark, "answers")
    identity = jsonl.write_frozen(v.answers(spark, sf), path).first().asDict()
    rows = jsonl.read_frozen(spark, path, identity)
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("answer_id").alias("answers"))


ADMISSION_SQL = """(WITH u AS (SELECT *, CASE WHEN bytes > 52428800 THEN 'oversize' WHEN NOT signed THEN 'no signature' WHEN pages > 300 THEN 'too many pages'
        WHEN count(*) OVER (PARTITION BY edition, name) > 1 THEN 'repeated name' END AS refusal FROM v_materials)
    SELECT edition AS batch, doc_id AS file_id, name, CASE WHEN refusal IS NOT NULL THEN refusal
        WHEN bool_or(refusal IS NOT NULL) OVER (PARTITION BY edition) THEN 'held back'
        WHEN (edition, sha256) IN (SELECT (edition, sha256) FROM v_materials WHERE doc_id % 4 = 0)
          OR name <> min(name) OVER (PARTITION BY edition, sha256) THEN 'skipped' ELSE 'queued' END AS verdict FROM u)"""


def admission(spark, sf):
    uploads = v.materials(spark, sf).select(
        F.col("edition").alias("batch"), "edition", F.col("doc_id").alias("file_id"),
        "name", "sha256", "bytes", "pages", "signed",
    )
    held = v.materials(spark, sf).where("doc_id % 4 = 0").select("edition", "sha256")
    return files.batch_admission(uploads, held)


@query("s10_batch_admission", f"SELECT * FROM {ADMISSION_SQL}")
def s10(spark, sf):
    return admission(spark, sf)


@query("s10_batch_verdicts", f"SELECT verdict, count(*) AS files, count(DISTINCT batch) AS batches FROM {ADMISSION_SQL} GROUP BY 1")
def s10_verdicts(spark, sf):
    return (
        admission(spark, sf)
        .groupBy("verdict")
        .agg(F.count("*").alias("files"), F.countDistinct("batch").alias("batches"))
    )


@query(
    "a11_version_counts",
    """SELECT COALESCE(url, 'none') AS url, COALESCE(ingest_source, 'none') AS ingest_source, count(*) AS points FROM v_points GROUP BY url, ingest_source""",
)
def a11(spark, sf):
    counts = index.version_counts(v.points(spark, sf))
    return counts.select(
        *[F.coalesce(c, F.lit("none")).alias(c) for c in index.WEB_KEY], "points"
    )


@query(
    "a14_furniture_headings",
    """SELECT b.doc_id, b.text FROM (SELECT doc_id, text, count(DISTINCT page) AS pages FROM v_blocks WHERE is_heading GROUP BY 1, 2) b
       JOIN (SELECT doc_id, max(page) AS n FROM v_blocks GROUP BY 1) s USING (doc_id) WHERE pages >= greatest(2, ceil(n / 25))""",
)
def a14(spark, sf):
    """Headings that are page furniture; on these lines a lower bar finds them."""
    return chunking.furniture_headings(v.blocks(spark, sf), floor=2, share=25)


PAGES_SQL = """(SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS chars, page % 3 AS images,
    CASE WHEN doc_id % 4 = 0 AND page = 1 THEN 'CMMI10' WHEN doc_id % 6 = 0 THEN 'SymbolMT' ELSE 'Lato' END AS font FROM v_chunks GROUP BY doc_id, page)"""
PROFILE_SQL = f"""(SELECT doc_id, count(*) AS pages, CAST(floor(sum(chars) / count(*)) AS BIGINT) AS chars_per_page,
    avg(CASE WHEN chars < 50 THEN 1.0 ELSE 0.0 END) AS empty_share, CAST(sum(images) AS BIGINT) AS images,
    COALESCE(string_agg(DISTINCT CASE WHEN font <> 'Lato' THEN font END, ', ' ORDER BY CASE WHEN font <> 'Lato' THEN font END), '') AS fonts FROM {PAGES_SQL} GROUP BY doc_id)"""


def page_facts(spark, sf):
    d, p = F.col("doc_id"), F.col("page")
    facts = v.chunks(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    font = F.when((d % 4 == 0) & (p == 1), "CMMI10").when(d % 6 == 0, "SymbolMT").otherwise("Lato")
    return facts.withColumn("images", p % 3).withColumn("fonts", F.array(font))


@query(
    "a15_document_profile",
    f"SELECT doc_id, pages, chars_per_page, round(empty_share, 9) AS empty_share, images, fonts FROM {PROFILE_SQL}",
)
def a15(spark, sf):
    return chunking.document_profile(page_facts(spark, sf)).select(
        "doc_id", "pages", "chars_per_page", F.round("empty_share", 9).alias("empty_share"), "images",
        F.array_join("math_fonts", ", ").alias("fonts"),
    )


@query(
    "a16_parse_plan",
    f"""SELECT doc_id, empty_share > 0.3 AS ocr, fonts <> '' AS formula, 'classic' || CASE WHEN empty_share > 0.3 THEN '-ocr' ELSE '' END || CASE WHEN fonts <> '' THEN '-formula' ELSE '' END AS variant,
        CASE WHEN empty_share > 0.3 AND fonts <> '' THEN CAST(round(empty_share * 100) AS INTEGER) || '% of pages carry no text layer + math fonts present (' || fonts || ')'
             WHEN empty_share > 0.3 THEN CAST(round(empty_share * 100) AS INTEGER) || '% of pages carry no text layer'
             WHEN fonts <> '' THEN 'math fonts present (' || fonts || ')' ELSE 'text layer intact, no math fonts' END AS reason FROM {PROFILE_SQL}""",
)
def a16(spark, sf):
    return chunking.parse_plan(chunking.document_profile(page_facts(spark, sf)))


CHUNKS_SQL = r"""WITH RECURSIVE heads AS (
      SELECT b.*, f.text IS NOT NULL AS furniture FROM v_blocks b LEFT JOIN (
        SELECT x.doc_id, x.text FROM (SELECT doc_id, text, count(DISTINCT page) AS pages FROM v_blocks WHERE is_heading GROUP BY 1, 2) x
        JOIN (SELECT doc_id, max(page) AS n FROM v_blocks GROUP BY 1) s USING (doc_id) WHERE pages >= greatest(5, ceil(n / 5))) f
      ON f.doc_id = b.doc_id AND f.text = b.text),
    chained AS (SELECT doc_id, pos, page, text, is_heading, count(*) FILTER (is_heading) OVER w AS section,
        max(CASE WHEN is_heading AND level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN is_heading AND level = 2 THEN pos END) OVER w AS p2
        FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    body AS (SELECT c.doc_id, c.pos, c.page, c.section, c.text, list_filter(regexp_split_to_array(c.text, '\s+'), lambda x: x <> '') AS w,
        CASE WHEN h1.furniture THEN NULL ELSE h1.text END AS t1, CASE WHEN h2.furniture OR NOT COALESCE(c.p2 > COALESCE(c.p1, -1), FALSE) THEN NULL ELSE h2.text END AS t2
        FROM chained c LEFT JOIN heads h1 ON h1.doc_id = c.doc_id AND h1.pos = c.p1 LEFT JOIN heads h2 ON h2.doc_id = c.doc_id AND h2.pos = c.p2 WHERE NOT c.is_heading),
    pieces AS (SELECT doc_id, pos, page, section, t1, t2, len(w) AS n, i, CASE WHEN len(w) <= 128 THEN text ELSE array_to_string(w[i * 128 + 1 : i * 128 + 128], ' ') END AS text,
        least(len(w) - i * 128, 128) AS tokens FROM (SELECT *, unnest(range((len(w) - 1) // 128 + 1)) AS i FROM body WHERE len(w) > 0)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS rn FROM pieces),
    packed AS (SELECT doc_id, rn, section, tokens AS used, CAST(0 AS BIGINT) AS pack FROM numbered WHERE rn = 1
        UNION ALL SELECT n.doc_id, n.rn, n.section, CASE WHEN n.section = p.section AND p.used + n.tokens <= 128 THEN p.used + n.tokens ELSE n.tokens END,
            CASE WHEN n.section = p.section AND p.used + n.tokens <= 128 THEN p.pack ELSE p.pack + 1 END
        FROM packed p JOIN numbered n ON n.doc_id = p.doc_id AND n.rn = p.rn + 1)
    SELECT n.doc_id, p.pack AS chunk_index, string_agg(n.text, chr(10) ORDER BY n.rn) AS text, min(n.page) AS page, string_agg(DISTINCT CAST(n.page AS VARCHAR), ' ' ORDER BY CAST(n.page AS VARCHAR)) AS pages,
        COALESCE(first(n.t1), '') || '|' || COALESCE(first(n.t2), '') AS path, CAST(sum(n.tokens) AS BIGINT) AS tokens
    FROM numbered n JOIN packed p ON p.doc_id = n.doc_id AND p.rn = n.rn GROUP BY 1, 2"""


@query("x01_chunk_documents", CHUNKS_SQL.replace("COALESCE(first(n.t1), '') || '|' || COALESCE(first(n.t2), '')", "COALESCE(min(n.t1), '') || CASE WHEN min(n.t1) IS NOT NULL AND min(n.t2) IS NOT NULL THEN '|' ELSE '' END || COALESCE(min(n.t2), '')"))
def x01(spark, sf):
    """Whole documents packed into chunks of at most 128 words under one heading chain."""
    chunks = chunking.chunk_documents(v.blocks(spark, sf), budget=128, fold=False)
    return chunks.select(
        "doc_id", "chunk_index", "text", "page",
        F.array_join(F.array_sort(F.transform("pages", lambda p: p.cast("string"))), " ").alias("pages"),
        F.array_join("heading_path", "|").alias("path"),
        "tokens",
    )


@query("x01_chunk_budget")
def x01_budget(spark, sf):
    """Folded chunks at the full budget: how many, how full, and the largest."""
    chunks = chunking.chunk_documents(v.blocks(spark, sf))
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.countDistinct("doc_id").alias("documents"),
        F.max("tokens").alias("most_tokens"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"),
    )


def printed(points):
    return points.select("point_id", "seq", "kind", F.md5("text").alias("text"))


@query("x13_upsert_points", "SELECT point_id, seq, kind, md5(text) AS text FROM v_after_upsert")
def x13(spark, sf):
    points = v.points(spark, sf).select(*v.POINT_COLUMNS)
    return printed(index.upsert_points(points, v.batch(spark, sf)))


REPLACED_SQL = """SELECT point_id, seq, kind, md5(text) AS text FROM v_after_upsert a WHERE point_id IN (SELECT point_id FROM v_batch)
       OR (kind = 'web' AND NOT EXISTS (SELECT 1 FROM v_batch b WHERE b.kind = 'web' AND b.url = a.url AND b.ingest_source = a.ingest_source))
       OR (kind = 'slides' AND NOT EXISTS (SELECT 1 FROM v_batch b WHERE b.kind = 'slides' AND b.source_file = a.source_file AND b.course = a.course AND b.academic_year = a.academic_year))"""


@query("x14_replace_versions", REPLACED_SQL)
def x14(spark, sf):
    points = v.points(spark, sf).select(*v.POINT_COLUMNS)
    return printed(index.replace_versions(points, v.batch(spark, sf)))


def last_points(spark, sf):
    """`views.points`, of which only points of repeated ids are shuffled."""
    return index.keep_last_where_they_lie(v.point_rows(spark, sf).select("doc_id", *v.POINT_COLUMNS), "point_id", "seq")


def stored_points(spark, sf, points=None):
    """The index as a table at rest, version 1."""
    store = Store(spark, scratch_path(spark, "store"))
    store.create((last_points(spark, sf) if points is None else points).select(*v.POINT_COLUMNS))
    return store


def stored_with_batch(spark, sf):
    """The index as a table at rest and a second ingest, made once: finding its buckets and changing them both read it."""
    points = last_points(spark, sf)
    return stored_points(spark, sf, points), written_once(v.batch(spark, sf, points), "batch")


@query(
    "x13_store_upsert",
    """SELECT a.point_id, a.seq, a.kind, md5(a.text) AS text, b.seq AS seq_before FROM v_after_upsert a LEFT JOIN v_points b USING (point_id)""",
)
def x13_store(spark, sf):
    """The committed table after an upsert, beside the version before it, read as of then."""
    store, batch = stored_with_batch(spark, sf)
    after = store.upsert(batch)
    before = store.read(version=1).select("point_id", F.col("seq").alias("seq_before"))
    return printed(store.read(of=after)).join(before, "point_id", "left")


@query("x14_store_replace", REPLACED_SQL)
def x14_store(spark, sf):
    """The committed table after a batch has replaced what it supersedes."""
    store, batch = stored_with_batch(spark, sf)
    return printed(store.read(of=store.replace(batch)))


SEEN_SQL = "(SELECT DISTINCT source_file, course, academic_year FROM v_points WHERE kind = 'slides' AND doc_id % 6 = 0 AND doc_id % 36 <> 0)"


def seen_files(spark, sf):
    """A full run over some editions, in which a few files are gone."""
    return (
        v.points(spark, sf)
        .where("kind = 'slides' and doc_id % 6 = 0 and doc_id % 36 <> 0")
        .select("source_file", "course", "academic_year")
        .distinct()
    )


@query(
    "x15_sync_editions",
    f"""SELECT point_id, seq, kind, md5(text) AS text FROM v_points p
        WHERE kind = 'web' OR NOT EXISTS (SELECT 1 FROM {SEEN_SQL} s WHERE s.course = p.course AND s.academic_year = p.academic_year)
           OR EXISTS (SELECT 1 FROM {SEEN_SQL} s WHERE s.course = p.course AND s.academic_year = p.academic_year AND s.source_file = p.source_file)""",
)
def x15(spark, sf):
    points = v.points(spark, sf).select(*v.POINT_COLUMNS)
    return printed(index.sync_editions(points, seen_files(spark, sf)))


@query(
    "x15_repeated_files",
    """SELECT source_file, course, academic_year, count(*) AS listed FROM (
        SELECT DISTINCT doc_id, source_file, course, academic_year FROM v_points WHERE kind = 'slides'
        UNION ALL SELECT DISTINCT doc_id, source_file, course, academic_year FROM v_points WHERE kind = 'slides' AND doc_id % 9 = 0) GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def x15_repeated(spark, sf):
    listing = v.points(spark, sf).where("kind = 'slides'").select(
        "doc_id", *index.SLIDES_KEY
    ).distinct()
    return index.repeated_files(listing.unionByName(listing.where("doc_id % 9 = 0")))


@query(
    "x16_delete_scoped",
    """SELECT point_id, seq, kind, md5(text) AS text FROM v_points WHERE NOT (ingest_run_id IS NOT DISTINCT FROM 'live-1' AND ingest_source IS NOT DISTINCT FROM 'live')
       AND NOT (source_sha256 = (SELECT sha256(text) FROM documents WHERE doc_id = 0) AND course IS NOT DISTINCT FROM 'C000' AND academic_year IS NOT DISTINCT FROM '2020-2021')""",
)
def x16(spark, sf):
    """One live run rolled back and one deck of one edition deleted; a crawl run's id does nothing."""
    points = v.points(spark, sf).select(*v.POINT_COLUMNS)
    sha = v.table(spark, sf, "documents").where("doc_id = 0").select(F.sha2("text", 256)).scalar()
    kept = index.delete_run(index.delete_run(points, "live-1"), "crawl-1")
    return printed(index.delete_material(kept, sha, "C000", "2020-2021"))


@query(
    "x15_store_sync",
    f"""SELECT point_id, seq, kind, md5(text) AS text FROM v_points p
        WHERE kind = 'web' OR NOT EXISTS (SELECT 1 FROM {SEEN_SQL} s WHERE s.course = p.course AND s.academic_year = p.academic_year)
           OR EXISTS (SELECT 1 FROM {SEEN_SQL} s WHERE s.course = p.course AND s.academic_year = p.academic_year AND s.source_file = p.source_file)""",
)
def x15_store(spark, sf):
    """The committed table after a full directory run; a run in which a file failed commits nothing."""
    store = stored_points(spark, sf)
    seen = seen_files(spark, sf)
    store.sync(seen, failed=True)
    return printed(store.read(of=store.sync(seen)))


BUCKET_SQL = "CAST('0x' || substr(md5(COALESCE(CASE WHEN kind = 'web' THEN url ELSE source_file END, point_id)), 1, 7) AS BIGINT) % 64"


@query(
    "x16_store_history",
    f"""WITH p AS (SELECT *, {BUCKET_SQL} AS bucket FROM v_points), a AS (SELECT *, {BUCKET_SQL} AS bucket FROM v_after_upsert),
        live AS (SELECT bucket FROM a WHERE ingest_run_id IS NOT DISTINCT FROM 'live-1' AND ingest_source IS NOT DISTINCT FROM 'live')
        SELECT 1 AS version, 'create' AS action, 64 AS buckets, count(DISTINCT bucket) AS rewritten, count(*) AS rows FROM p
        UNION ALL SELECT 2, 'upsert', 64, (SELECT count(DISTINCT bucket) FROM (SELECT {BUCKET_SQL} AS bucket FROM v_batch
            UNION SELECT bucket FROM p WHERE point_id IN (SELECT point_id FROM v_batch))), (SELECT count(*) FROM a)
        UNION ALL SELECT 3, 'delete run', 64, (SELECT count(DISTINCT bucket) FROM live), (SELECT count(*) FROM a) - (SELECT count(*) FROM live)
        UNION ALL SELECT 4, 'delete material', 64,
            (SELECT count(DISTINCT bucket) FROM a WHERE NOT (ingest_run_id IS NOT DISTINCT FROM 'live-1' AND ingest_source IS NOT DISTINCT FROM 'live')
                AND source_sha256 = (SELECT sha256(text) FROM documents WHERE doc_id = 0) AND course IS NOT DISTINCT FROM 'C000' AND academic_year IS NOT DISTINCT FROM '2020-2021'),
            (SELECT count(*) FROM a WHERE NOT (ingest_run_id IS NOT DISTINCT FROM 'live-1' AND ingest_source IS NOT DISTINCT FROM 'live')
                AND NOT (source_sha256 = (SELECT sha256(text) FROM documents WHERE doc_id = 0) AND course IS NOT DISTINCT FROM 'C000' AND academic_year IS NOT DISTINCT FROM '2020-2021'))""",
)
def x16_store(spark, sf):
    """Each commit with the buckets it rewrote, of all, and the rows after it."""
    store, batch = stored_with_batch(spark, sf)
    store.upsert(batch)
    store.delete_run("live-1")
    sha = v.table(spark, sf, "documents").where("doc_id = 0").select(F.sha2("text", 256)).scalar()
    store.delete_material(sha, "C000", "2020-2021")
    return store.history()


@query(
    "x17_incremental_plan",
    """WITH f AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN url || '/new' ELSE url END AS url, ingest_source,
           CASE WHEN seq % 5 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash, seq % 13 <> 0 AS relevant, seq % 17 <> 0 AS complete FROM v_registry),
       l AS (SELECT url, content_hash AS known_hash FROM v_registry QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
       c AS (SELECT url, ingest_source, count(*) AS points FROM v_registry WHERE seq % 3 <> 0 GROUP BY 1, 2)
       SELECT f.seq, f.url, CASE WHEN NOT (relevant AND complete) THEN 'ephemeral' WHEN known_hash IS NULL THEN 'first fetch' WHEN known_hash <> content_hash THEN 'content changed'
              WHEN COALESCE(points, 0) = 0 THEN 'reindexed after rollback' ELSE 'unchanged' END AS action
       FROM f LEFT JOIN l USING (url) LEFT JOIN c ON c.url = f.url AND c.ingest_source = f.ingest_source""",
)
def x17(spark, sf):
    rows = v.registry(spark, sf)
    s = F.col("seq")
    fetched = rows.select(
        "seq",
        F.when(s % 11 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")).alias("url"),
        "ingest_source",
        F.when(s % 5 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"),
        (s % 13 != 0).alias("relevant"),
        (s % 17 != 0).alias("complete"),
    )
    latest = ledger.latest_by_url(rows).withColumnRenamed("content_hash", "known_hash")
    counts = index.version_counts(rows.where("seq % 3 <> 0"))
    return index.incremental_plan(fetched, latest, counts, carry=["seq"]).select("seq", "url", "action")


DIFF_SQL = """SELECT COALESCE(a.url, b.url, 'none') AS url, COALESCE(a.ingest_source, b.ingest_source, 'none') AS ingest_source,
    CASE WHEN b.n IS NULL THEN 'only left' WHEN a.n IS NULL THEN 'only right' WHEN a.n = b.n THEN 'equal' ELSE 'differs' END AS verdict
    FROM (SELECT url, ingest_source, count(*) AS n FROM v_points GROUP BY 1, 2) a FULL OUTER JOIN
         (SELECT url, ingest_source, count(*) AS n FROM v_points WHERE doc_id % 10 <> 2 AND doc_id % 60 <> 5 GROUP BY 1, 2) b
    ON a.url IS NOT DISTINCT FROM b.url AND a.ingest_source IS NOT DISTINCT FROM b.ingest_source"""


def restored(spark, sf):
    """The index after a restore that lost some documents."""
    return v.points(spark, sf).where("doc_id % 10 <> 2 and doc_id % 60 <> 5")


@query("j08_diff_join", DIFF_SQL)
def j08(spark, sf):
    found = index.diff_join(
        index.version_counts(v.points(spark, sf)),
        index.version_counts(restored(spark, sf)),
        index.WEB_KEY,
        "points",
    )
    return found.select(*[F.coalesce(c, F.lit("none")).alias(c) for c in index.WEB_KEY], "verdict")


@query(
    "x27_snapshot_compare",
    f"SELECT verdict, count(*) AS versions FROM ({DIFF_SQL}) GROUP BY 1",
)
def x27(spark, sf):
    """A manifest frozen, read back by its identity and compared with a restore."""
    path = scratch_path(spark, "manifest")
    identity = jsonl.write_frozen(index.version_manifest(v.points(spark, sf)), path).first().asDict()
    frozen = jsonl.read_frozen(spark, path, identity)
    now = index.version_manifest(restored(spark, sf))
    compared = index.diff_join(frozen, now, index.WEB_KEY, "digest")
    return compared.groupBy("verdict").agg(F.count("*").alias("versions"))


@query(
    "x27_store_compare",
    """SELECT COALESCE(a.point_id, b.point_id) AS point_id, CASE WHEN b.point_id IS NULL THEN 'only left' ELSE 'differs' END AS verdict
       FROM v_points a LEFT JOIN (SELECT point_id, seq, CASE WHEN doc_id % 25 = 7 THEN text || '!' ELSE text END AS text FROM v_points WHERE doc_id % 60 <> 5) b USING (point_id)
       WHERE b.point_id IS NULL OR a.text <> b.text""",
)
def x27_store(spark, sf):
    """Two tables at rest, one a restore that lost and changed some: what differs, by digests of buckets first."""
    mine, other = stored_points(spark, sf), Store(spark, scratch_path(spark, "store"))
    d, lost = F.col("doc_id"), v.points(spark, sf).where("doc_id % 60 <> 5")
    text = F.when(d % 25 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    other.create(lost.withColumn("text", text).select(*v.POINT_COLUMNS))
    return mine.compare(other)[0]


@query(
    "j01_registry_chunk",
    """SELECT r.seq, r.url, p.url AS page_url, COALESCE(r.section, 'web') AS section FROM v_registry r LEFT JOIN pages p ON p.page_id = r.seq""",
)
def j01_registry(spark, sf):
    """Ledger rows beside the page they were fetched as."""
    pages = v.table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("page_url"))
    return v.registry(spark, sf).join(pages, "seq", "left").select(
        "seq", "url", "page_url", F.coalesce("section", F.lit("web")).alias("section")
    )
