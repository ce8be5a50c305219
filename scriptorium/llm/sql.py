"""DuckDB twins of the queries, written from the contracts rather than from the Spark plans."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_sql(documents: str = "documents", tail: str = "") -> str:
    """CTEs up to `judged`: every document's counts and verdict. `documents` is a table or CTE."""
    rules = {
        "short": "n_words < 20",
        "repeats": "100 * n_repeat_words > 30 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "lines": "100 * n_dup_lines > 30 * n_lines",
    }
    sums = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS k_{r}" for r, c in rules.items())
    prior = ", ".join(
        f"sum(k_{r}) / sum(n_docs) AS m_{r}, var_pop(k_{r} / n_docs) AS v_{r}" for r in rules
    )
    strength = ", ".join(
        f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), 1e6) ELSE 1e6 END AS s_{r}"
        for r in rules
    )
    bad = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n_docs + s_{r}) > 0.3 AS bad_{r}" for r in rules)
    broken = " OR ".join(f"(bad_{r} AND {c})" for r, c in rules.items())
    return rf"""
q_split AS (
  SELECT row_number() OVER () AS q_row, *, {WORDS} AS q_words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS q_lines
  FROM {documents}),
q_starts AS (
  SELECT q_row, generate_subscripts(runs, 1) AS pos, unnest(runs) AS words FROM (
    SELECT q_row, list_transform(range(1, len(q_words) - 6), lambda i: array_to_string(q_words[i:i + 7], ' ')) AS runs
    FROM q_split WHERE len(q_words) >= 8)),
q_windows AS (SELECT q_row, pos, count(*) OVER (PARTITION BY q_row, words) AS times FROM q_starts),
q_repeats AS (
  SELECT q_row, count(DISTINCT pos + k) AS n_repeat_words
  FROM q_windows, range(0, 8) AS r(k) WHERE times > 1 GROUP BY q_row),
measured AS (
  SELECT s.*, len(q_words)::BIGINT AS n_words,
         length(array_to_string(q_words, ''))::BIGINT AS word_chars,
         (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(q_lines)::BIGINT AS n_lines,
         (len(q_lines) - len(list_distinct(q_lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_split s LEFT JOIN q_repeats USING (q_row)),
q_hosts AS (SELECT source AS q_host, count(*)::DOUBLE AS n_docs, {sums} FROM measured GROUP BY source),
q_prior AS (SELECT {prior} FROM q_hosts),
q_strength AS (SELECT *, {strength} FROM q_prior),
q_bad AS (SELECT q_host, {bad} FROM q_hosts, q_strength),
judged AS (
  SELECT m.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {broken}) AS kept
  FROM measured m JOIN q_bad ON source IS NOT DISTINCT FROM q_host){tail}"""


OP8 = f"""WITH {quality_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""

OP10 = r"""
WITH templates(template, label, tokens) AS (
  SELECT i, l, list_distinct(string_split(t, ' ')) FROM (VALUES
    (0, 'mit', 'released under the mit license'),
    (1, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
    (2, 'apache-2', 'licensed under the apache license version 2 0'),
    (3, 'cc-by-nc', 'licensed under cc by nc 4 0'),
    (4, 'cc-by-nc', 'creative commons attribution noncommercial 4 0 international license'),
    (5, 'gpl-3', 'this work is licensed under the gnu general public license version 3'),
    (6, 'bsd-3', 'redistribution and use in source and binary forms with or without modification are permitted')
  ) AS v(i, l, t)),
split AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
places AS (
  SELECT row_id, pos - 1 AS pos, CASE
    WHEN words[pos:pos + 3] = ['under', 'the', 'mit', 'license'] THEN 'mit'
    WHEN words[pos:pos + 3] = ['apache', 'license', 'version', '2'] THEN 'apache-2'
    WHEN words[pos:pos + 2] = ['cc', 'by', 'nc'] THEN 'cc-by-nc' END AS label
  FROM (SELECT row_id, words, unnest(range(1, len(words) + 1)) AS pos FROM split)),
base AS (
  SELECT row_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places WHERE label IS NOT NULL GROUP BY row_id),
lines AS (
  SELECT row_id, list_distinct(regexp_extract_all(lower(line), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS tokens
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM split)),
met AS (
  SELECT row_id, label, len(list_intersect(l.tokens, t.tokens)) / len(t.tokens) AS containment
  FROM lines l, templates t
  WHERE len(list_intersect(l.tokens, t.tokens)) >= ceil(0.8 * len(t.tokens) - 1e-9)),
more AS (SELECT row_id, list(DISTINCT label) AS labels, max(containment) AS best FROM met GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM split LEFT JOIN base b USING (row_id) LEFT JOIN more m USING (row_id)"""


def decontamination_sql(documents: str = "documents", prefix: str = "") -> str:
    """CTEs up to `{prefix}best`: each text and item with its best window.

    Windows begin at a shared shingle, which loses none (see the operator); every such
    window is compared exactly, without fingerprints.
    """
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
    p = prefix
    return rf"""
{p}items AS (
  SELECT item_id, w, len(w) AS size, least(len(w), 5) AS gram FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
{p}grams AS (
  SELECT item_id, size, gram, g, row_number() OVER (PARTITION BY item_id, g) AS nth FROM (
    SELECT item_id, size, gram, unnest(list_transform(range(1, size - gram + 2), lambda i: array_to_string(w[i:i + gram - 1], ' '))) AS g FROM {p}items)),
{p}texts AS (SELECT row_number() OVER () AS t_row, doc_id, {words} AS w FROM (SELECT DISTINCT doc_id, text FROM {documents})),
{p}lengths AS (SELECT DISTINCT gram FROM {p}items),
{p}places AS (
  SELECT t_row, gram, generate_subscripts(gs, 1) - 1 AS pos, unnest(gs) AS g FROM (
    SELECT t_row, gram, list_transform(range(1, len(w) - gram + 2), lambda i: array_to_string(w[i:i + gram - 1], ' ')) AS gs
    FROM {p}texts, {p}lengths WHERE len(w) >= gram)),
{p}hits AS (
  SELECT DISTINCT t_row, item_id, size, gram, pos FROM {p}places JOIN (SELECT DISTINCT item_id, size, gram, g FROM {p}grams) USING (gram, g)),
{p}windows AS (
  SELECT DISTINCT t_row, doc_id, item_id, gram, greatest(0, least(pos, len(w) - size)) AS start, least(size, len(w)) AS n,
         w[greatest(0, least(pos, len(w) - size)) + 1:greatest(0, least(pos, len(w) - size)) + least(size, len(w))] AS ws
  FROM {p}hits JOIN {p}texts USING (t_row)),
{p}bags AS (
  SELECT t_row, item_id, start, g, row_number() OVER (PARTITION BY t_row, item_id, start, g) AS nth FROM (
    SELECT t_row, item_id, start, unnest(list_transform(range(1, n - gram + 2), lambda i: array_to_string(ws[i:i + gram - 1], ' '))) AS g FROM {p}windows)),
{p}common AS (SELECT t_row, item_id, start, count(*) AS common FROM {p}bags JOIN {p}grams USING (item_id, g, nth) GROUP BY ALL),
{p}judged AS (
  SELECT doc_id, t_row, item_id, start, n, common / ((n - v.gram + 1) + (i.size - i.gram + 1) - common) AS similarity
  FROM {p}common JOIN {p}windows v USING (t_row, item_id, start) JOIN {p}items i USING (item_id)),
{p}best AS (
  SELECT doc_id, t_row, item_id, similarity, start AS first_word, n AS n_words FROM {p}judged WHERE similarity >= 0.75
  QUALIFY row_number() OVER (PARTITION BY t_row, item_id ORDER BY similarity DESC, start, n DESC) = 1)"""


OP4 = f"""WITH {decontamination_sql()}
SELECT doc_id, item_id, similarity, first_word::BIGINT AS first_word, n_words::BIGINT AS n_words FROM best"""

OP2 = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM texts),
flat AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.r AS a, b.r AS b FROM flat a JOIN flat b ON a.g = b.g AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT r, r AS root FROM sets UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.root = edges.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM sets s JOIN reach USING (r) JOIN sets t ON t.r = reach.root GROUP BY s.r, s.doc_id, s.s"""
