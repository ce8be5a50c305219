"""Registered queries of the column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from scriptorium.functions import citations as cite, html as page, ids, text as tx, urls, vectors
from scriptorium.operators import scope_intervals
from scriptorium.operators.filters import any_of, json_path_is, payload_filter
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.views import text_of

W = r"[\p{L}\p{N}_]+"


def tag_variants():
    """Language tags as sources write them, by row."""
    d, lang = F.col("doc_id"), F.col("lang")
    return (
        F.when(d % 6 == 0, lang)
        .when(d % 6 == 1, text_of(F.upper(lang), "-XX"))
        .when(d % 6 == 2, text_of(" ", lang, "_Y "))
        .when(d % 6 == 3, "english")
        .when(d % 6 == 4, "")
        .otherwise(text_of(lang, "-Latn-XX"))
    )


TAG_SQL = """CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN ' ' || lang || '_Y '
 WHEN 3 THEN 'english' WHEN 4 THEN '' ELSE lang || '-Latn-XX' END"""


@query("f01_nfkc_fold")
def f01(spark, sf):
    """Clean-up pass: how many texts folding changes, per source."""
    folded = v.table(spark, sf, "documents").select(
        "source", "text", tx.nfkc_fold("text").alias("folded")
    )
    return folded.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("text") != F.col("folded")).alias("changed"),
    )


@query(
    "f02_primary_subtag",
    rf"""SELECT doc_id, CASE WHEN regexp_full_match(s, '[a-z]{{2,3}}') THEN s END AS subtag FROM (
        SELECT doc_id, split_part(replace(lower(trim({TAG_SQL})), '_', '-'), '-', 1) AS s FROM documents)""",
)
def f02(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.primary_subtag(tag_variants()).alias("subtag")
    )


def _list_sql(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _votes_sql(words, pattern):
    return (
        f"len(list_filter(regexp_extract_all(lower(text), '{pattern}'), "
        f"lambda w: list_contains({_list_sql(words)}, w)))"
    )


CJK_SQL = r"""(length(bare) > 0 AND len(regexp_extract_all(bare, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')) >= length(bare) * 0.2)"""
BARE_SQL = r"""regexp_replace(text, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]', '', 'g') AS bare"""
LOCALE_SQL = f"""SELECT doc_id, lang, CASE WHEN {CJK_SQL} THEN 'zh' WHEN it > en THEN 'it' ELSE 'en' END AS locale FROM (
    SELECT doc_id, lang, {BARE_SQL}, {_votes_sql(tx.ENGLISH_WORDS, tx.VOTE_WORD_PATTERN)} AS en,
           {_votes_sql(tx.ITALIAN_WORDS, tx.VOTE_WORD_PATTERN)} AS it FROM documents)"""


@query("f03_detect_locale", f"SELECT doc_id, locale FROM ({LOCALE_SQL})")
def f03(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.detect_locale(F.col("text")).alias("locale")
    )


@query(
    "f03_detect_locale_wide",
    f"""SELECT doc_id, CASE WHEN {CJK_SQL} THEN 'zh' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr'
        WHEN de >= es THEN 'de' ELSE 'es' END AS locale FROM (
    SELECT doc_id, {BARE_SQL}, """
    + ", ".join(
        f"{_votes_sql(ws, tx.WIDE_WORD_PATTERN)} AS {name}"
        for name, ws in tx.WIDE_VOTE_TABLE.items()
    )
    + " FROM documents)",
)
def f03_wide(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id",
        tx.detect_locale(F.col("text"), tx.WIDE_VOTE_TABLE, tx.WIDE_WORD_PATTERN).alias("locale"),
    )


@query(
    "f04_document_locale",
    f"""SELECT doc_id, COALESCE(CASE WHEN regexp_full_match(s, '[a-z]{{2,3}}') THEN s END, locale) AS locale FROM (
        SELECT doc_id, locale, split_part(replace(lower(trim({TAG_SQL})), '_', '-'), '-', 1) AS s FROM ({LOCALE_SQL}))""",
)
def f04(spark, sf):
    declared = tx.primary_subtag(tag_variants())
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.document_locale(declared, F.col("text")).alias("locale")
    )


@query(
    "f05_edition_key",
    r"""SELECT doc_id, CASE WHEN ok THEN split_part(k, ':', 1) END AS course, CASE WHEN ok THEN split_part(k, ':', 2) END AS academic_year FROM (
        SELECT doc_id, k, regexp_full_match(k, '[A-Za-z0-9][A-Za-z0-9._-]*:\d{4}-\d{4}')
             AND TRY_CAST(right(k, 4) AS INTEGER) = TRY_CAST(left(right(k, 9), 4) AS INTEGER) + 1 AS ok FROM (
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || ':2021-2023' WHEN 1 THEN source || '2021-2022' WHEN 2 THEN ':2021-2022'
            ELSE source || ':' || (2018 + doc_id % 7) || '-' || (2019 + doc_id % 7) END AS k FROM documents))""",
)
def f05(spark, sf):
    d, s = F.col("doc_id"), F.col("source")
    key = (
        F.when(d % 5 == 0, text_of(s, ":2021-2023"))
        .when(d % 5 == 1, text_of(s, "2021-2022"))
        .when(d % 5 == 2, ":2021-2022")
        .otherwise(text_of(s, ":", d % 7 + 2018, "-", d % 7 + 2019))
    )
    return v.table(spark, sf, "documents").select(
        "doc_id", ids.edition_key(key).alias("edition")
    ).select("doc_id", "edition.course", "edition.academic_year")


CHUNK_ID_SQL = """CASE WHEN academic_year IS NOT NULL THEN course || ':' || academic_year || ':' ELSE '' END
    || left(source_sha256, 16) || ':' || parse_variant || ':' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INTEGER), '0')"""
POINT_ID_SQL = f"""(SELECT row_key, chunk_id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-'
    || (['8','9','a','b'])[CAST('0x' || h[17] AS INTEGER) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM (
    SELECT row_key, chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM (
        SELECT row_key, {CHUNK_ID_SQL} AS chunk_id FROM v_chunks)))"""


def chunk_id():
    return ids.chunk_id(
        F.col("course"),
        F.col("academic_year"),
        F.col("source_sha256"),
        F.col("parse_variant"),
        F.col("chunk_index"),
    )


@query("f06_chunk_id", f"SELECT row_key, {CHUNK_ID_SQL} AS chunk_id FROM v_chunks")
def f06(spark, sf):
    return v.chunks(spark, sf).select("row_key", chunk_id().alias("chunk_id"))


@query("f07_point_id", f"SELECT * FROM {POINT_ID_SQL}")
def f07(spark, sf):
    return (
        v.chunks(spark, sf)
        .select("row_key", chunk_id().alias("chunk_id"))
        .withColumn("point_id", ids.uuid5(F.col("chunk_id")))
    )


@query(
    "f08_content_digest",
    "SELECT page_id, sha256(html) AS content_hash, left(sha256(url), 16) AS artifact FROM pages",
)
def f08(spark, sf):
    return v.table(spark, sf, "pages").select(
        "page_id",
        F.sha2("html", 256).alias("content_hash"),
        ids.artifact_name(F.col("url")).alias("artifact"),
    )


def scope_rules(spark, sf):
    """Three rules per host of the table: two language sections, then all of it."""
    hosts = v.table(spark, sf, "pages").select(
        "page_id", urls.host_of(F.col("url")).alias("host")
    ).groupBy("host").agg(F.min("page_id").alias("first"))
    prefixes = F.array(
        F.struct(F.lit("/en/").alias("path_prefix"), F.lit("english").alias("section")),
        F.struct(F.lit("/fr/").alias("path_prefix"), F.lit("french").alias("section")),
        F.struct(F.lit("/").alias("path_prefix"), F.lit("any").alias("section")),
    )
    return hosts.select(
        "host", "first", F.posexplode(prefixes).alias("i", "rule")
    ).select(
        (F.col("first") * 3 + F.col("i")).alias("rule_order"),
        "host",
        "rule.path_prefix",
        "rule.section",
    )


SCOPE_SQL = r"""SELECT p.page_id, p.url, min(r.rule_order) AS rule_order, arg_min(r.section, r.rule_order) AS section
        FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
                     regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages) p
        LEFT JOIN (SELECT host, first * 3 + i AS rule_order, (['/en/', '/fr/', '/'])[i + 1] AS prefix,
                          (['english', 'french', 'any'])[i + 1] AS section
                   FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, min(page_id) AS first FROM pages GROUP BY 1),
                        (SELECT unnest([0, 1, 2]) AS i)) r
        ON r.host = p.host AND starts_with(p.path, r.prefix) GROUP BY 1, 2"""


@query("f09_scope_rule", SCOPE_SQL)
def f09(spark, sf):
    pages = v.table(spark, sf, "pages").select("page_id", "url")
    return urls.in_scope(pages, scope_rules(spark, sf), "page_id").select(
        "page_id", "url", "rule_order", "section"
    )


@query("f09_scope_intervals", SCOPE_SQL)
def f09_intervals(spark, sf):
    """The same by intervals of paths: one row an address, however many rules its host has."""
    pages = v.table(spark, sf, "pages").select("page_id", "url")
    return scope_intervals.in_scope(pages, scope_rules(spark, sf), "page_id").select(
        "page_id", "url", "rule_order", "section"
    )


@query(
    "f10_content_class",
    r"""SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\.(doc|docx|xls|xlsx|ppt|pptx|rtf|odt|zip)$') THEN 'skipped'
        WHEN contains(content_type, 'pdf') OR lower(url) LIKE '%.pdf' THEN 'pdf'
        WHEN content_type LIKE 'application/%' AND NOT contains(content_type, 'html') THEN 'unsupported' ELSE 'html' END AS class FROM v_headers""",
)
def f10(spark, sf):
    return v.headers(spark, sf).select(
        "page_id", urls.content_class(F.col("url"), F.col("content_type")).alias("class")
    )


LINKS_SQL = """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, dst, anchor FROM (
    SELECT l.page_id, l.pos, l.dst, l.anchor FROM v_page_links l JOIN pages p USING (page_id)
    WHERE l.dst <> split_part(p.url, '#', 1)
    QUALIFY row_number() OVER (PARTITION BY l.page_id, l.dst ORDER BY l.pos) = 1)"""


@query("f11_extract_links", LINKS_SQL)
def f11(spark, sf):
    return v.links(spark, sf).select("page_id", "pos", "dst", "anchor")


@query(
    "f11_link_degrees",
    f"""SELECT dst AS url, count(*) AS in_links, count(DISTINCT page_id) AS from_pages FROM ({LINKS_SQL}) GROUP BY dst""",
)
def f11_degrees(spark, sf):
    """The link table reduced to in-degrees per target."""
    return (
        v.links(spark, sf)
        .groupBy(F.col("dst").alias("url"))
        .agg(F.count("*").alias("in_links"), F.countDistinct("page_id").alias("from_pages"))
    )


@query(
    "f12_sitemap_urls",
    r"""SELECT page_id, len(u) AS n_urls, array_to_string(u, ' ') AS urls FROM (
        SELECT page_id, list_filter(list_transform(regexp_extract_all(x, '(?is)<loc>(.*?)</loc>', 1), lambda s: trim(s)), lambda s: s <> '') AS u FROM (
        SELECT page_id, '<urlset>' || regexp_replace(html, '<a href="([^"]*)">', '<url><LOC>  \1 </loc></url><loc> </loc>', 'g') AS x FROM pages))""",
)
def f12(spark, sf):
    """Sitemaps written from each page's links, then read back."""
    xml = text_of(
        "<urlset>",
        F.regexp_replace(
            "html", r'<a href="([^"]*)">', r"<url><LOC>  $1 </loc></url><loc> </loc>"
        ),
    )
    found = v.table(spark, sf, "pages").select("page_id", urls.sitemap_urls(xml).alias("u"))
    return found.select(
        "page_id",
        F.size("u").cast("long").alias("n_urls"),
        F.array_join("u", " ").alias("urls"),
    )


@query("f13_visible_text")
def f13(spark, sf):
    """Page text per host beside the share of the markup it makes up."""
    texts = v.table(spark, sf, "pages").select(
        urls.host_of(F.col("url")).alias("host"),
        F.length("html").alias("html_chars"),
        F.length(page.visible_text("html")).alias("text_chars"),
    )
    return texts.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.sum("html_chars").alias("html_chars"),
        F.sum("text_chars").alias("text_chars"),
        F.round(1 - F.sum("text_chars") / F.sum("html_chars"), 6).alias("boilerplate_share"),
    )


@query(
    "f14_html_lang",
    r"""SELECT page_id, CASE WHEN regexp_full_match(s, '[a-z]{2,3}') THEN s END AS lang FROM (
        SELECT page_id, split_part(replace(lower(trim(regexp_extract(html, '(?i)<html[^>]*?\slang\s*=\s*["'']?([^"''\s>]+)', 1))), '_', '-'), '-', 1) AS s FROM pages)""",
)
def f14(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", page.html_lang(F.col("html")).alias("lang"))


@query(
    "f15_inert_url",
    r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(u, ''), lambda c:
            CASE WHEN regexp_full_match(c, '[A-Za-z0-9_.~/:?#@!$&''()*+,;=%-]') THEN c
                 ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') AS url
        FROM (SELECT conv_id, turn, 'https://example.org/s?q=' || text AS u FROM conversations)""",
)
def f15(spark, sf):
    return v.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        urls.inert_url(text_of("https://example.org/s?q=", F.col("text"))).alias("url"),
    )


@query("f16_neutralize_quote")
def f16(spark, sf):
    """Scrub of a text column: how many texts held a quoting-tag look-alike, per source."""
    t = F.when(
        F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit(" ＜/quo­ted> now"))
    ).otherwise(F.col("text"))
    scrubbed = (
        v.table(spark, sf, "documents")
        .select("source", t.alias("text"))
        .withColumn("clean", tx.neutralize("text"))
    )
    return scrubbed.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("text") != F.col("clean")).alias("changed"),
    )


@query(
    "f17_parse_model_json",
    r"""SELECT event_id, k IS NOT NULL AS usable, COALESCE(k, -1) AS k FROM (
        SELECT event_id, TRY_CAST(json_extract_string(TRY_CAST(regexp_extract(reply, '(?s)\{.*\}') AS JSON), '$.k') AS BIGINT) AS k
        FROM v_replies)""",
)
def f17(spark, sf):
    schema = T.StructType([T.StructField("k", T.LongType())])
    parsed = tx.parse_reply(F.col("reply"), schema, ["k"])
    return v.replies(spark, sf).select("event_id", parsed.alias("r")).select(
        "event_id",
        F.col("r").isNotNull().alias("usable"),
        F.coalesce(F.col("r.k"), F.lit(-1).cast("long")).alias("k"),
    )


TOKEN_SQL = tx.TOKEN.replace("'", "''")


@query(
    "f18_inert_media_type",
    rf"""SELECT page_id, CASE WHEN regexp_full_match(f, '{TOKEN_SQL}/{TOKEN_SQL}([ \t]*;[ \t]*{TOKEN_SQL}={TOKEN_SQL})*') THEN f
        WHEN regexp_full_match(h, '{TOKEN_SQL}/{TOKEN_SQL}') THEN h ELSE '' END AS media_type FROM (
        SELECT page_id, trim(split_part(content_type, ',', 1)) AS f, trim(split_part(split_part(content_type, ',', 1), ';', 1)) AS h FROM v_headers)""",
)
def f18(spark, sf):
    return v.headers(spark, sf).select(
        "page_id", tx.inert_media_type(F.col("content_type")).alias("media_type")
    )


@query(
    "f19_edition_year",
    r"""SELECT doc_id, COALESCE(list_max(list_concat(plain, pairs)), -1) AS year FROM (
        SELECT doc_id,
          list_transform(list_filter(regexp_extract_all(seg, '\d+'), lambda x: length(x) = 4 AND starts_with(x, '20')), lambda x: CAST(x AS INTEGER)) AS plain,
          list_transform(list_filter(list_zip(regexp_extract_all(seg, '\d+'), list_append(regexp_extract_all(seg, '\d+')[2:], 'x'), list_append(regexp_extract_all(seg, '\d+([^\d]*)', 1), 'x')),
            lambda t: (length(t[1]) = 2 OR (length(t[1]) = 4 AND starts_with(t[1], '20'))) AND t[3] IN ('-', '_') AND length(t[2]) = 2
              AND TRY_CAST(t[2] AS INTEGER) = (TRY_CAST(right(t[1], 2) AS INTEGER) + 1) % 100), lambda t: 2000 + CAST(t[2] AS INTEGER)) AS pairs
        FROM (SELECT doc_id, url_decode(regexp_extract(url, '([^/]*)/*$', 1)) AS seg FROM (
          SELECT doc_id, 'https://x.example.org/f' || doc_id || '/guide' || CASE doc_id % 7 WHEN 0 THEN '-2019-20' WHEN 1 THEN '_19_20.pdf' WHEN 2 THEN '-2021-2022/'
             WHEN 3 THEN '%2D2018' WHEN 4 THEN '-B271-23-23' WHEN 5 THEN '-' || (2000 + doc_id % 40) || '_11_07' ELSE '-99-00' END AS url FROM documents)))""",
)
def f19(spark, sf):
    d = F.col("doc_id")
    url = text_of(
        "https://x.example.org/f",
        d,
        "/guide",
        F.when(d % 7 == 0, "-2019-20")
        .when(d % 7 == 1, "_19_20.pdf")
        .when(d % 7 == 2, "-2021-2022/")
        .when(d % 7 == 3, "%2D2018")
        .when(d % 7 == 4, "-B271-23-23")
        .when(d % 7 == 5, text_of("-", d % 40 + 2000, "_11_07"))
        .otherwise("-99-00"),
    )
    return v.table(spark, sf, "documents").select(
        "doc_id", F.coalesce(urls.edition_year(url), F.lit(-1)).alias("year")
    )


SHINGLES_SQL = rf"""SELECT row_key, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s,
        list_distinct(regexp_extract_all(j, '\p{{Nd}}+')) AS nums FROM (
        SELECT row_key, j, regexp_extract_all(lower(j), '{W}') AS w FROM (
        SELECT row_key, regexp_replace(text, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS j FROM v_chunks))"""


@query(
    "f20_shingles_numbers",
    f"""SELECT row_key, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS shingles,
        array_to_string(list_sort(nums), ' ') AS numbers FROM ({SHINGLES_SQL})""",
)
def f20(spark, sf):
    features = v.chunks(spark, sf).select(
        "row_key", tx.shingles(F.col("text")).alias("s"), tx.numbers(F.col("text")).alias("n")
    )
    return features.select(
        "row_key",
        F.size("s").cast("long").alias("n_shingles"),
        F.md5(F.array_join(F.array_sort("s"), "|")).alias("shingles"),
        F.array_join(F.array_sort("n"), " ").alias("numbers"),
    )


MARKER_SQL = """CASE WHEN kind = 'web' THEN '[' || url || ' · ' || fetch_date || ']' ELSE '[' || source_file || ' p.' || page || ']' END"""


def marker():
    return urls.source_marker(
        F.col("kind"), F.col("url"), F.col("fetch_date"), F.col("source_file"), F.col("page")
    )


@query("f21_source_marker", f"SELECT row_key, {MARKER_SQL} AS marker FROM v_chunks")
def f21(spark, sf):
    return v.chunks(spark, sf).select("row_key", marker().alias("marker"))


@query(
    "f22_citation_refs",
    "SELECT answer_id, marker FROM v_cited",
)
def f22(spark, sf):
    return cite.cited_markers(v.answers(spark, sf), v.citations(spark, sf))


@query(
    "f23_strip_citations",
    r"""SELECT answer_id, regexp_replace(answer, '\[[^\]]*\]', '', 'g') AS bare, trim(CASE WHEN conv_id % 16 = 15 THEN answer ELSE
        CASE WHEN turn % 4 = 0 THEN body || ' [0][9]' ELSE rtrim(body, E' \t') || '[9]' END
        || CASE conv_id % 8 WHEN 1 THEN ' `[1]`' WHEN 2 THEN ' a[1] [2](u)' WHEN 5 THEN ' (Excerpt 9, 2)' WHEN 6 THEN ' end' WHEN 7 THEN ' see.' ELSE '' END
        END, E' \t\n\r') AS stripped
        FROM v_answers JOIN v_assistant USING (answer_id, conv_id, turn)""",
)
def f23(spark, sf):
    """Answers without their references; some have no citation, so nothing to take out."""
    held = (
        v.citations(spark, sf)
        .where("conv_id % 16 <> 15")
        .groupBy("answer_id")
        .agg(
            F.array_sort(F.collect_set(F.col("pos") + 1)).alias("numbers"),
            F.array_sort(F.collect_set("marker")).alias("markers"),
        )
    )
    return (
        v.answers(spark, sf)
        .join(held, "answer_id", "left")
        .select(
            "answer_id",
            cite.without_brackets(F.col("answer")).alias("bare"),
            cite.strip_citations(F.col("answer"), F.col("numbers"), F.col("markers")).alias(
                "stripped"
            ),
        )
    )


@query(
    "f24_shorten",
    r"""SELECT conv_id, turn, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(left(t, 400)) || '…' END AS short, left(text, 60) AS title
        FROM (SELECT conv_id, turn, text, trim(regexp_replace(text, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', ' ', 'g')) AS t FROM conversations)""",
)
def f24(spark, sf):
    return v.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        tx.shorten(F.col("text"), 400).alias("short"),
        F.left("text", F.lit(60)).alias("title"),
    )


EDGE_URL_SQL = "'https://p.example.org/d/' || dst || CASE WHEN is_pdf THEN '/file.pdf' ELSE '' END"


def edge_url():
    return text_of(
        "https://p.example.org/d/",
        F.col("dst"),
        F.when(F.col("is_pdf"), "/file.pdf").otherwise(""),
    )


@query(
    "f25_ranking_text",
    """SELECT src, pos, anchor || CASE WHEN is_pdf THEN ' file.pdf /d/' || dst || '/file.pdf' ELSE ' /d/' || dst END AS ranking_text FROM v_edges""",
)
def f25(spark, sf):
    return v.edges(spark, sf).select(
        "src", "pos", urls.ranking_text(F.col("anchor"), edge_url()).alias("ranking_text")
    )


POINTERS = {
    "en": "Send the address of a page that answers this and it can be added.",
    "it": "Invia l'indirizzo di una pagina che risponde e potrà essere aggiunta.",
}


@query(
    "f26_localized_text",
    f"""SELECT question_id, CASE locale WHEN 'it' THEN '{POINTERS["it"].replace("'", "''")}' ELSE '{POINTERS["en"]}' END AS pointer FROM v_gold""",
)
def f26(spark, sf):
    return v.gold(spark, sf).select(
        "question_id", tx.localized(F.col("locale"), POINTERS, "en").alias("pointer")
    )


@query(
    "f28_source_label",
    r"""SELECT answer_id, pos, CASE WHEN url IS NULL THEN '' ELSE regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\.', '') END AS host,
        COALESCE(heading, CASE WHEN kind = 'web' THEN regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '') END, source_file) AS title FROM v_citations""",
)
def f28(spark, sf):
    return v.citations(spark, sf).select(
        "answer_id",
        "pos",
        F.coalesce(urls.bare_host(F.col("url")), F.lit("")).alias("host"),
        urls.source_title(
            F.col("heading"), F.col("kind"), F.col("url"), F.col("source_file")
        ).alias("title"),
    )


@query(
    "f29_citation_of",
    """SELECT answer_id, pos, kind, source_file, page, marker, CASE kind WHEN 'slides' THEN academic_year END AS academic_year,
        CASE kind WHEN 'slides' THEN source_sha256 END AS source_sha256, CASE kind WHEN 'web' THEN url END AS url,
        CASE kind WHEN 'web' THEN fetch_date END AS fetch_date FROM v_citations""",
)
def f29(spark, sf):
    hits = v.citations(spark, sf)
    return hits.select("answer_id", "pos", *cite.citation_of({c: F.col(c) for c in hits.columns}))


@query(
    "f30_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2""",
)
def f30(spark, sf):
    e = v.table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("other_vec"))
    return e.join(other, F.floor(F.col("vec_id") / 2) == F.col("other")).select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other_vec")), 9).alias("cosine")
    )


@query(
    "f31_context_block",
    """SELECT answer_id, string_agg('[' || (pos + 1) || '] ' || marker || chr(10) || '<quoted>' || chr(10) || 'Excerpt of ' || source_file || ' page ' || page
        || chr(10) || '</quoted>', chr(10) || chr(10) ORDER BY pos) AS context FROM v_citations GROUP BY answer_id""",
)
def f31(spark, sf):
    from scriptorium.operators.context import context_block

    hits = v.citations(spark, sf).select(
        "answer_id",
        (F.col("pos") + 1).alias("rank"),
        "marker",
        text_of("Excerpt of ", F.col("source_file"), " page ", F.col("page")).alias("text"),
    )
    return context_block(hits, "answer_id")


SCOPES = [("C000", "2020-2021"), ("C003", "2023-2024")]


@query(
    "f32_payload_filter",
    """SELECT * FROM (
        SELECT 'english' AS filter, count(*) AS rows FROM v_chunks WHERE locale = 'en'
        UNION ALL SELECT 'crawl', count(*) FROM v_chunks WHERE ingest_source = 'crawl'
        UNION ALL SELECT 'run', count(*) FROM v_chunks WHERE ingest_source = 'live' AND ingest_run_id = 'live-1'
        UNION ALL SELECT 'all', count(*) FROM v_chunks
        UNION ALL SELECT 'two editions', count(*) FROM v_chunks WHERE (course = 'C000' AND academic_year = '2020-2021') OR (course = 'C003' AND academic_year = '2023-2024')
        UNION ALL SELECT 'none', 0)""",
)
def f32(spark, sf):
    """One pass over the points counts what each filter lets through."""
    points = v.chunks(spark, sf)
    filters = {
        "english": payload_filter(locale="en"),
        "crawl": payload_filter(ingest_source="crawl"),
        "run": payload_filter(ingest_source="live", ingest_run_id="live-1"),
        "all": payload_filter(scope=None),
        "two editions": payload_filter(scope=SCOPES),
        "none": payload_filter(scope=[]),
    }
    counted = points.agg(
        *[F.count_if(condition).alias(name) for name, condition in filters.items()]
    )
    return counted.unpivot([], list(filters), "filter", "rows")


@query(
    "f33_list_filters",
    """SELECT * FROM (
        SELECT 'down' AS filter, count(*) AS rows FROM v_feedback WHERE rating = 'down'
        UNION ALL SELECT 'slides', count(*) FROM v_feedback WHERE json_extract_string(route, '$.target') = 'slides'
        UNION ALL SELECT 'incorrect es', count(*) FROM v_feedback WHERE reason = 'incorrect' AND locale = 'es'
        UNION ALL SELECT 'name', (SELECT count(*) FROM customer WHERE c_name ILIKE '%omer_1%')
        UNION ALL SELECT 'unknown', 0)""",
)
def f33(spark, sf):
    ratings = v.feedback(spark, sf)
    kinds = ["up", "down"]
    filters = {
        "down": any_of(F.col("rating"), "down", kinds),
        "slides": json_path_is(F.col("route"), "$.target", "slides", v.TARGETS),
        "incorrect es": any_of(F.col("reason"), "incorrect", ["", "incorrect"])
        & any_of(F.col("locale"), "es", None),
        "unknown": any_of(F.col("rating"), "sideways", kinds),
    }
    counted = ratings.agg(
        *[F.count_if(condition).alias(name) for name, condition in filters.items()]
    ).unpivot([], list(filters), "filter", "rows")
    people = (
        v.table(spark, sf, "customer")
        .where(F.col("c_name").ilike("%omer_1%"))
        .agg(F.lit("name").alias("filter"), F.count("*").alias("rows"))
    )
    return counted.unionByName(people)
