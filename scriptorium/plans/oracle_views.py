"""The derived views in SQL, composed into each oracle by the names it mentions."""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]+"

VIEWS: dict[str, str] = {
    "v_lines": r"""
        SELECT doc_id, lang, source, sha, n_lines, pos AS chunk_index, line AS text FROM (
            SELECT doc_id, lang, source, sha256(text) AS sha,
                   len(string_split(text, chr(10))) AS n_lines,
                   unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents)
        WHERE regexp_matches(line, '\S')""",
    "v_chunks": r"""
        SELECT doc_id, chunk_index, text,
               lpad(CAST(doc_id AS VARCHAR), CAST(greatest(9, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '-' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(5, length(CAST(chunk_index AS VARCHAR))) AS INTEGER), '0') AS row_key,
               lang AS locale,
               CASE WHEN doc_id % 3 = 0 THEN 'slides' ELSE 'web' END AS kind,
               CASE WHEN doc_id % 3 = 0 THEN 'C' || lpad(CAST(doc_id % 20 AS VARCHAR), CAST(greatest(3, length(CAST(doc_id % 20 AS VARCHAR))) AS INTEGER), '0') ELSE source END AS course,
               CASE WHEN doc_id % 3 = 0 THEN (2020 + doc_id % 5) || '-' || (2021 + doc_id % 5) END AS academic_year,
               'd' || (doc_id % 400) || '.pdf' AS source_file,
               CASE WHEN doc_id % 3 <> 0 THEN 'https://' || source || '.example.org/g/guide-' || (2019 + doc_id % 6) || '-p' || (doc_id % 60) END AS url,
               CASE WHEN doc_id % 3 <> 0 THEN source END AS section,
               CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 10 = 1 THEN 'live' ELSE 'crawl' END END AS ingest_source,
               CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 10 = 1 THEN 'live' ELSE 'crawl' END || '-' || (doc_id % 4) END AS ingest_run_id,
               CASE WHEN doc_id % 3 <> 0 THEN strftime(DATE '2026-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') END AS fetch_date,
               CASE WHEN doc_id % 3 <> 0 THEN sha END AS content_hash,
               chunk_index // 3 + 1 AS page, sha AS source_sha256, 'text' AS parse_variant
        FROM v_lines""",
    "v_registry": r"""
        SELECT page_id AS seq, 'https://' || host || '/p' || (page_id % 3) AS url, host,
               sha256(html) AS content_hash,
               strftime(DATE '2026-01-01' + CAST(page_id % 90 AS INTEGER), '%Y-%m-%d') AS fetch_date,
               CASE WHEN page_id % 7 = 0 THEN 'live' ELSE 'crawl' END AS ingest_source,
               CASE WHEN page_id % 7 = 0 THEN 'live-' || (page_id % 3) ELSE 'crawl-' || (page_id % 2) END AS ingest_run_id,
               CASE WHEN page_id > 0 THEN page_id // 2 END AS referrer_seq,
               CASE WHEN page_id % 4 = 0 THEN NULL ELSE 's' || (page_id % 5) END AS section
        FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)""",
    "v_page_links": r"""
        SELECT page_id, base, pos, href, base || split_part(href, '#', 1) AS dst, anchor FROM (
            SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
                   unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
                   unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS anchor,
                   unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS pos
            FROM pages)""",
    "v_edges": r"""
        SELECT src, dst, CAST(pos AS BIGINT) AS pos, 'link ' || dst || ' from page ' || src AS anchor, dst % 5 = 0 AS is_pdf FROM (
            SELECT page_id AS src, 0 AS pos, (7 * page_id + 1) % n AS dst FROM pages, (SELECT count(*) AS n FROM pages)
            UNION ALL SELECT page_id, 1, (3 * page_id + 2) % n FROM pages, (SELECT count(*) AS n FROM pages)
            UNION ALL SELECT page_id, 2, (page_id * page_id) % n FROM pages, (SELECT count(*) AS n FROM pages))
        WHERE src <> dst""",
    "v_gold": r"""
        SELECT 'q' || lpad(CAST(item_id AS VARCHAR), CAST(greatest(4, length(CAST(item_id AS VARCHAR))) AS INTEGER), '0') AS question_id, item_id, text AS question,
               (['en', 'it', 'zh'])[item_id % 3 + 1] AS locale FROM benchmark""",
    "v_truth": r"""
        SELECT g.question_id, d.doc_id FROM v_gold g JOIN documents d ON contains(d.text, g.question)""",
    "v_dense": r"""
        SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS embedding, e.label, c.row_key, d.text, c.text AS title, c.kind, c.course,
               c.academic_year, c.locale, c.ingest_source, c.ingest_run_id, c.url
        FROM embeddings e JOIN (
            SELECT * FROM v_chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) = 1) c
        ON c.doc_id = e.vec_id JOIN documents d ON d.doc_id = c.doc_id""",
    "v_postings": r"""
        SELECT row_key, term, count(*) AS tf FROM (
            SELECT row_key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM v_chunks)
        GROUP BY row_key, term""",
    "v_lengths": r"""
        SELECT row_key, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS doc_len FROM v_chunks""",
    "v_terms": r"""
        SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
        FROM (SELECT term, count(*) AS df FROM v_postings GROUP BY term), (SELECT count(*) AS n FROM v_lengths)""",
    "v_weights": r"""
        SELECT p.row_key, p.term, p.tf,
               t.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / a.avg_len)) AS weight
        FROM v_postings p JOIN v_terms t USING (term) JOIN v_lengths l USING (row_key),
             (SELECT avg(doc_len) AS avg_len FROM v_lengths) a""",
    "v_query_terms": r"""
        SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM v_gold""",
    "v_sparse_top": r"""
        SELECT question_id, row_key, score, rn FROM (
            SELECT question_id, row_key, score,
                   row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) AS rn
            FROM (SELECT question_id, row_key, round(sum(weight), 9) AS score
                  FROM v_query_terms JOIN v_weights USING (term) GROUP BY question_id, row_key))
        WHERE rn <= 20""",
    "v_hash_terms": r"""
        SELECT row_key, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % 64 AS slot, sum(tf) AS v
        FROM v_postings GROUP BY 1, 2""",
    "v_hash_docs": r"""
        SELECT row_key, slot, v / sqrt(sum(v * v) OVER (PARTITION BY row_key)) AS v FROM v_hash_terms""",
    "v_hash_queries": r"""
        SELECT question_id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY question_id)) AS v FROM (
            SELECT question_id, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % 64 AS slot, count(*) AS v FROM (
                SELECT question_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM v_gold)
            GROUP BY 1, 2)""",
    "v_hash_top": r"""
        SELECT question_id, row_key, score, rn FROM (
            SELECT question_id, row_key, score,
                   row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) AS rn
            FROM (SELECT question_id, row_key, round(sum(q.v * d.v), 9) AS score
                  FROM v_hash_queries q JOIN v_hash_docs d USING (slot) GROUP BY question_id, row_key))
        WHERE rn <= 20""",
    "v_fused": r"""
        SELECT question_id, row_key, score,
               row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_key) AS rn
        FROM (SELECT question_id, row_key, round(sum(1.0 / (rn + 1)), 9) AS score
              FROM (SELECT * FROM v_sparse_top UNION ALL SELECT * FROM v_hash_top) GROUP BY question_id, row_key)""",
    "v_overlap": r"""
        SELECT f.question_id, f.row_key, f.rn AS fused_rank,
               round(CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(g.question), '[\p{L}\p{N}_]+')),
                                  list_distinct(regexp_extract_all(lower(c.text), '[\p{L}\p{N}_]+')))) AS DOUBLE)
                     / len(list_distinct(regexp_extract_all(lower(g.question), '[\p{L}\p{N}_]+'))), 9) AS score
        FROM v_fused f JOIN v_gold g USING (question_id) JOIN v_chunks c USING (row_key)""",
    "v_reranked": r"""
        SELECT question_id, row_key, score,
               row_number() OVER (PARTITION BY question_id ORDER BY score DESC, fused_rank) AS rn FROM v_overlap""",
    "v_ranks": r"""
        SELECT g.question_id, g.locale, a.arm, min(CASE WHEN t.doc_id IS NOT NULL THEN x.rn END) AS rank
        FROM v_gold g CROSS JOIN (VALUES ('fusion'), ('rerank')) a(arm)
        LEFT JOIN (SELECT 'fusion' AS arm, question_id, row_key, rn FROM v_fused WHERE rn <= 10
                   UNION ALL SELECT 'rerank', question_id, row_key, rn FROM v_reranked WHERE rn <= 10) x
               ON x.question_id = g.question_id AND x.arm = a.arm
        LEFT JOIN v_chunks c ON c.row_key = x.row_key
        LEFT JOIN v_truth t ON t.question_id = x.question_id AND t.doc_id = c.doc_id
        GROUP BY g.question_id, g.locale, a.arm""",
    "v_sparse_ranks": r"""
        SELECT g.question_id, g.locale, min(CASE WHEN t.doc_id IS NOT NULL THEN x.rn END) AS rank
        FROM v_gold g LEFT JOIN (SELECT * FROM v_sparse_top WHERE rn <= 10) x ON x.question_id = g.question_id
        LEFT JOIN v_chunks c ON c.row_key = x.row_key
        LEFT JOIN v_truth t ON t.question_id = x.question_id AND t.doc_id = c.doc_id
        GROUP BY g.question_id, g.locale""",
    "v_web_texts": r"""
        SELECT text, min(row_key) AS text_key, count(*) AS copies, min(url || '|' || content_hash) AS low_version,
               max(url || '|' || content_hash) AS high_version FROM v_chunks WHERE kind = 'web' GROUP BY text""",
    "v_text_features": r"""
        SELECT text_key, low_version, high_version,
               list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s,
               list_distinct(regexp_extract_all(text, '\p{Nd}+')) AS nums
        FROM (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM v_web_texts) WHERE len(w) > 0""",
    "v_text_shingles": r"""
        SELECT text_key, unnest(s) AS sh FROM v_text_features""",
    "v_near": r"""
        SELECT p.a, p.b, round(p.shared / (len(x.s) + len(y.s) - p.shared), 9) AS jaccard
        FROM (SELECT l.text_key AS a, r.text_key AS b, CAST(count(*) AS DOUBLE) AS shared
              FROM v_text_shingles l JOIN v_text_shingles r ON l.sh = r.sh AND l.text_key < r.text_key GROUP BY 1, 2) p
        JOIN v_text_features x ON x.text_key = p.a JOIN v_text_features y ON y.text_key = p.b
        WHERE p.shared / (len(x.s) + len(y.s) - p.shared) >= 0.5
          AND CASE WHEN len(x.nums) <= len(y.nums) THEN list_has_all(y.nums, x.nums) ELSE list_has_all(x.nums, y.nums) END
          AND least(x.low_version, y.low_version) <> greatest(x.high_version, y.high_version)""",
    "v_blocks": r"""
        SELECT doc_id, chunk_index AS pos, chunk_index % 25 = 0 AS is_heading, 1 + (chunk_index // 25) % 2 AS level,
               chunk_index // 3 + 1 AS page,
               CASE WHEN chunk_index % 25 = 0 AND doc_id % 4 = 0 THEN 'Notes ' || doc_id ELSE text END AS text FROM v_lines""",
    "v_point_rows": r"""
        SELECT *, doc_id * 1000000000 + chunk_index AS seq, CASE WHEN academic_year IS NOT NULL THEN course || ':' || academic_year || ':' ELSE '' END
            || left(source_sha256, 16) || ':' || parse_variant || ':' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM v_chunks""",
    "v_points": r"""
        SELECT * FROM (SELECT *, md5(chunk_id) AS point_id FROM v_point_rows)
        QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY seq DESC) = 1""",
    "v_batch": r"""
        SELECT * REPLACE (CASE WHEN doc_id % 3 = 1 THEN point_id ELSE md5(point_id || 'v2') END AS point_id, text || ' (second edition)' AS text, seq + 500000000 AS seq)
        FROM v_points WHERE doc_id % 4 = 1""",
    "v_after_upsert": r"""
        SELECT point_id, kind, url, ingest_source, ingest_run_id, source_file, course, academic_year, source_sha256, text, seq FROM v_points
        WHERE point_id NOT IN (SELECT point_id FROM v_batch)
        UNION ALL SELECT point_id, kind, url, ingest_source, ingest_run_id, source_file, course, academic_year, source_sha256, text, seq FROM v_batch
        QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY seq DESC) = 1""",
    "v_marks": r"""
        SELECT *, CASE WHEN academic_year = newest THEN 'current' WHEN academic_year < newest THEN 'past' ELSE 'upcoming' END AS state FROM (
            SELECT e.*, d.day, e.start_day <= d.day AS started,
                   max(CASE WHEN e.start_day <= d.day THEN academic_year END) OVER (PARTITION BY course, day) AS newest FROM v_editions e, v_days d)""",
    "v_covered": r"""
        SELECT user_id, course, bool_or(role = 'teacher') AS as_teacher, bool_or(role = 'secretariat') AS as_secretariat FROM (
            SELECT user_id, course, 'teacher' AS role FROM v_roles WHERE role = 'teacher'
            UNION ALL SELECT r.user_id, e.course, 'secretariat' FROM v_roles r JOIN v_entries e USING (programme) WHERE r.role = 'secretariat') GROUP BY 1, 2""",
    "v_boundary": r"""
        SELECT user_id, course, academic_year, state, bool_or(as_teacher) AS as_teacher,
               state = 'current' OR (bool_or(as_teacher) AND state <> 'past') AS is_default FROM (
            SELECT s.user_id, m.course, m.academic_year, m.state, FALSE AS as_teacher FROM v_students s JOIN v_entries e USING (programme)
                JOIN v_marks m ON m.course = e.course AND m.day = DATE '1998-09-01' AND m.state <> 'upcoming'
            UNION ALL SELECT c.user_id, m.course, m.academic_year, m.state, c.as_teacher FROM v_covered c JOIN v_marks m ON m.course = c.course AND m.day = DATE '1998-09-01')
        GROUP BY 1, 2, 3, 4""",
    "v_hits": r"""
        SELECT 'q' || lpad(CAST(item_id AS VARCHAR), CAST(greatest(4, length(CAST(item_id AS VARCHAR))) AS INTEGER), '0') AS question_id, question, j + 1 AS rn, (item_id * 3 + j * 11) % n AS page
        FROM (SELECT item_id, text AS question FROM benchmark), (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS j), (SELECT count(*) AS n FROM pages)
        QUALIFY row_number() OVER (PARTITION BY item_id, page ORDER BY j) = 1""",
    "v_linked": r"""
        SELECT * FROM v_edges WHERE src % 4 <> 0""",
    "v_carriers": r"""
        SELECT page, CASE WHEN page IN (SELECT src FROM v_linked) THEN page ELSE referrer END AS carrier
        FROM (SELECT page_id AS page, CASE WHEN page_id > 0 THEN page_id // 2 END AS referrer FROM pages)
        WHERE page IN (SELECT src FROM v_linked) OR referrer IS NOT NULL""",
    "v_candidates": r"""
        SELECT question_id, dst, rn, pos, referrer, anchor, is_pdf FROM (
            SELECT h.question_id, l.dst, h.rn, l.pos, l.src AS referrer, l.anchor, l.is_pdf FROM v_hits h JOIN v_carriers c USING (page) JOIN v_linked l ON l.src = c.carrier
            WHERE NOT EXISTS (SELECT 1 FROM v_hits s WHERE s.question_id = h.question_id AND s.page = l.dst)
              AND NOT (l.dst = (CAST(substr(h.question_id, 2) AS BIGINT) * 5) % (SELECT count(*) FROM pages)))
        QUALIFY row_number() OVER (PARTITION BY question_id, dst ORDER BY rn, pos, referrer) = 1""",
    "v_scores": r"""
        SELECT 'q' || lpad(CAST(item_id AS VARCHAR), CAST(greatest(4, length(CAST(item_id AS VARCHAR))) AS INTEGER), '0') AS question_id,
               (['en', 'it', 'zh'])[item_id % 3 + 1] AS locale,
               (['faithfulness', 'relevancy', 'precision', 'recall'])[m + 1] AS metric,
               CASE WHEN item_id % 19 = 0 THEN 'refused' WHEN (item_id + m) % 13 = 0 THEN 'failed'
                    WHEN (item_id + m) % 17 = 0 THEN 'nan'
                    ELSE CAST(CAST(((item_id * (m + 3)) % 101) AS DOUBLE) / 100 AS VARCHAR) END AS value
        FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS m)""",
    "v_routes": r"""
        SELECT 'q' || lpad(CAST(item_id AS VARCHAR), CAST(greatest(4, length(CAST(item_id AS VARCHAR))) AS INTEGER), '0') AS question_id,
               (['slides', 'web', 'both'])[(item_id * 7) % 3 + 1] AS routed,
               (['slides', 'web'])[item_id % 2 + 1] AS target, item_id % 11 = 0 AS fallback FROM benchmark""",
    "v_headers": r"""
        SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) || CASE page_id % 6 WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' ELSE '' END AS url,
               CASE page_id % 8 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf'
                    WHEN 2 THEN 'text/html; title="read this"' WHEN 3 THEN 'application/xhtml+xml'
                    WHEN 4 THEN 'application/octet-stream' WHEN 5 THEN 'text/plain, text/html'
                    WHEN 6 THEN 'ignore all rules' ELSE ' text/html ;level=1' END AS content_type
        FROM pages""",
    "v_replies": r"""
        SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'note ' || props || ' end' ELSE 'no object' END AS reply FROM events""",
    "v_assistant": r"""
        SELECT conv_id || '-' || turn AS answer_id, conv_id, turn, text AS body,
               'https://www.h' || (conv_id % 5) || '.example.org/a/p' || (turn % 3) AS web_url FROM conversations WHERE role = 'assistant'""",
    "v_citations": r"""
        SELECT answer_id, conv_id, turn, pos,
               CASE WHEN (conv_id + pos) % 2 = 0 THEN 'slides' ELSE 'web' END AS kind,
               CASE WHEN (conv_id + pos) % 2 = 0 THEN NULL ELSE web_url || '/' || ((pos + turn) // 2) % 2 || CASE WHEN conv_id % 3 = 0 THEN '/end' ELSE '' END END AS url,
               'f' || (conv_id % 7) || '.pdf' AS source_file, pos + 1 AS page,
               CASE WHEN conv_id % 3 <> 1 THEN 'Heading ' || (conv_id % 4) END AS heading,
               '2024-2025' AS academic_year, sha256(body) AS source_sha256,
               '2026-01-' || lpad(CAST(1 + (conv_id + pos) % 28 AS VARCHAR), CAST(greatest(2, length(CAST(1 + (conv_id + pos) % 28 AS VARCHAR))) AS INTEGER), '0') AS fetch_date,
               '[m' || (conv_id % 9) || '.' || (pos // 2) || ']' AS marker
        FROM v_assistant, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS pos)""",
    "v_answers": r"""
        SELECT answer_id, conv_id, turn,
               body || ' [' || (turn % 4) || '][9]' || CASE conv_id % 8 WHEN 0 THEN ' (Excerpt 2)' WHEN 1 THEN ' `[1]`'
                   WHEN 2 THEN ' a[1] [2](u)' WHEN 3 THEN ' [m' || (conv_id % 9) || '.1]' WHEN 4 THEN ' (Excerpt 1, 2)'
                   WHEN 5 THEN ' (Excerpt 9, 2)' WHEN 6 THEN ' 【Excerpt 1 和 2】 end' ELSE ' see [Excerpt 2 e Excerpt 3].' END AS answer
        FROM v_assistant""",
    # what each answer of v_answers was written to cite, by number
    "v_cited": r"""
        SELECT DISTINCT n.answer_id, c.marker FROM (
            SELECT answer_id, unnest(list_append(CASE conv_id % 8 WHEN 0 THEN [2] WHEN 3 THEN [3] WHEN 4 THEN [1, 2] WHEN 6 THEN [1, 2] WHEN 7 THEN [2, 3] ELSE [] END, turn % 4)) AS number
            FROM v_assistant) n JOIN v_citations c ON c.answer_id = n.answer_id AND c.pos + 1 = n.number""",
    "v_messages": r"""
        SELECT conv_id, turn, role, text, conv_id || '-' || turn AS id,
               lag(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id,
               conv_id % 10 AS owner,
               TIMESTAMP '2026-10-01 00:00:00' + conv_id * INTERVAL 1 MINUTE + turn * INTERVAL 1 SECOND AS created_at,
               conv_id % 7 = 0 AS pinned, turn % 5 <> 3 AS complete,
               (['en', 'it', 'zh'])[conv_id % 3 + 1] AS locale
        FROM conversations WHERE role <> 'system'""",
    "v_feedback": r"""
        SELECT l.doc_id AS answer_id, CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS rating,
               CASE WHEN toxic = 1 THEN 'incorrect' ELSE '' END AS reason,
               '{"target": "' || (['slides', 'web', 'both'])[l.doc_id % 3 + 1] || '"}' AS route,
               d.lang AS locale, l.doc_id % 50 AS owner FROM labels l JOIN documents d USING (doc_id)""",
    "v_mirror": r"""
        SELECT answer_id, CASE WHEN answer_id % 8 = 0 THEN CASE rating WHEN 'up' THEN 'down' ELSE 'up' END ELSE rating END AS rating,
               reason FROM v_feedback WHERE answer_id % 9 <> 0""",
    "v_entries": r"""
        SELECT n_regionkey AS programme, n_nationkey AS course, n_name AS course_name,
               CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE '' END AS curriculum, 1 + n_nationkey % 3 AS year_of_study FROM nation""",
    "v_editions": r"""
        SELECT course, y || '-' || (y + 1) AS academic_year,
               CASE WHEN (course + y) % 4 = 0 THEN NULL ELSE first_day END AS teaching_starts,
               COALESCE(CASE WHEN (course + y) % 4 = 0 THEN NULL ELSE first_day END, make_date(y, 9, 1)) AS start_day
        FROM (SELECT c_nationkey AS course, year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE)) AS first_day
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "v_roles": r"""
        SELECT DISTINCT s_suppkey % 50 AS user_id, 'teacher' AS role, s_nationkey AS course, '1997-1998' AS academic_year, NULL AS programme FROM supplier
        UNION ALL SELECT 1000 + r_regionkey, 'secretariat', NULL, NULL, r_regionkey FROM region""",
    "v_students": r"""
        SELECT c_custkey AS user_id, n_regionkey AS programme, 1 + c_custkey % 6 AS year_of_study
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_days": r"""
        SELECT unnest([DATE '1996-03-01', DATE '1998-09-01', DATE '2002-01-01']) AS day""",
    "v_activity": r"""
        SELECT task, user_id, event_id, ts, rn, n, kind,
               CASE WHEN rn = 1 THEN 'queued'
                    WHEN rn = n THEN CASE WHEN kind = 'question' THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'end' END
                                          ELSE CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END END
                    WHEN kind = 'question' THEN CASE rn WHEN 2 THEN 'taken' WHEN 4 THEN 'start' ELSE 'step' END
                    ELSE CASE rn WHEN 2 THEN 'parsing' WHEN 3 THEN 'chunking' ELSE 'indexing' END END AS event
        FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, event_id) AS rn,
                     count(*) OVER (PARTITION BY task) AS n
              FROM (SELECT 't' || user_id || '-' || strftime(ts, '%Y%m%d') AS task, user_id, event_id, ts, event_type,
                           CASE WHEN user_id % 2 = 0 THEN 'question' ELSE 'upload' END AS kind FROM events))""",
    "v_decisions": r"""
        SELECT task AS question_id, least(rn - 1, 3) AS step,
               CASE WHEN event = 'end' THEN 'answered' WHEN event = 'error' THEN 'timeout'
                    WHEN event_id % 2 = 0 THEN 'persisted' ELSE 'ephemeral' END AS outcome
        FROM v_activity WHERE kind = 'question'""",
    "v_materials": r"""
        SELECT doc_id, doc_id % 250 AS edition, sha256(text) AS sha256, CASE WHEN doc_id % 500 = 7 THEN 'same' ELSE 'f' || doc_id END || '.pdf' AS name,
               n_chars * 4096 AS bytes, n_chars // 60 AS pages, doc_id % 23 <> 0 AS signed FROM documents""",
}


def needed(sql: str) -> list[str]:
    """The views a statement reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """`sql` with the views it reads in front of it."""
    names = needed(sql)
    if not names:
        return sql.strip()
    heads = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:].lstrip()}"
    return f"WITH {heads}\n{body}"
