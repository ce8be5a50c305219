"""Registered queries of the catalogue, roles, conversations and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import citations as cite
from scriptorium.operators import asof, catalogue as cat, conversations as conv
from scriptorium.operators.context import history_block
from scriptorium.plans import views as v
from scriptorium.plans.registry import query
from scriptorium.plans.views import text_of

DAY = "1998-09-01"


def seen_editions(spark, sf):
    return cat.on_days(v.editions(spark, sf), v.DAYS)


def iso(day):
    return F.date_format(day, "yyyy-MM-dd")


@query(
    "f27_academic_year_check",
    """SELECT course, academic_year, CASE WHEN CAST(right(academic_year, 4) AS INTEGER) <> CAST(left(academic_year, 4) AS INTEGER) + 1 THEN 'not two consecutive years'
        WHEN teaching_starts IS NULL OR teaching_starts BETWEEN make_date(CAST(left(academic_year, 4) AS INTEGER), 9, 1) AND make_date(CAST(right(academic_year, 4) AS INTEGER), 8, 31) THEN ''
        ELSE 'starts outside its year' END AS problem FROM v_editions""",
)
def f27(spark, sf):
    return v.editions(spark, sf).select(
        "course",
        "academic_year",
        cat.edition_problems(F.col("academic_year"), F.col("teaching_starts")).alias("problem"),
    )


@query(
    "j02_exists_join",
    "SELECT c.user_id, e.course, e.academic_year, as_teacher, as_secretariat FROM v_covered c JOIN v_editions e USING (course)",
)
def j02(spark, sf):
    return cat.edition_roles(v.editions(spark, sf), v.roles(spark, sf), v.entries(spark, sf)).select(
        "user_id", "course", "academic_year", "as_teacher", "as_secretariat"
    )


@query(
    "j02_courses_for",
    "SELECT DISTINCT r.user_id, e.course FROM v_roles r JOIN v_entries e USING (programme) WHERE r.role = 'secretariat'",
)
def j02_courses(spark, sf):
    return cat.courses_for(v.entries(spark, sf), v.roles(spark, sf))


LATER_SQL = """SELECT m.course, m.academic_year, strftime(m.day, '%Y-%m-%d') AS day FROM v_marks m WHERE EXISTS (
    SELECT 1 FROM v_marks l WHERE l.course = m.course AND l.day = m.day AND l.started AND l.academic_year > m.academic_year)"""


@query("j04_later_started", LATER_SQL)
def j04(spark, sf):
    return cat.later_started(seen_editions(spark, sf)).select("course", "academic_year", iso("day").alias("day"))


@query("j04_later_started_window", LATER_SQL)
def j04_window(spark, sf):
    """The same editions from one maximum per course: no non-equi join."""
    return cat.edition_states(seen_editions(spark, sf)).where("state = 'past'").select(
        "course", "academic_year", iso("day").alias("day")
    )


AS_OF_SQL = """SELECT course, COALESCE(academic_year, 'none') AS academic_year, count(*) AS orders, strftime(min(day), '%Y-%m-%d') AS first_day FROM (
        SELECT c.c_nationkey AS course, CAST(o.o_orderdate AS DATE) AS day,
               (SELECT max(e.academic_year) FROM v_editions e WHERE e.course = c.c_nationkey AND e.start_day <= CAST(o.o_orderdate AS DATE)) AS academic_year
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) GROUP BY 1, 2"""


def order_days(spark, sf):
    """Every order's day and course."""
    customers = v.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("course"))
    return (
        v.table(spark, sf, "orders")
        .select("o_custkey", F.to_date("o_orderdate").alias("day"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("course", "day")
    )


def counted_editions(found):
    return found.groupBy("course", F.coalesce("academic_year", F.lit("none")).alias("academic_year")).agg(
        F.count("*").alias("orders"), iso(F.min("day")).alias("first_day")
    )


@query("j05_as_of_edition", AS_OF_SQL)
def j05(spark, sf):
    """Every order's day against the edition current on it, counted per edition."""
    return counted_editions(cat.edition_as_of(order_days(spark, sf), v.editions(spark, sf)))


@query("j05_as_of_merge", AS_OF_SQL)
def j05_merge(spark, sf):
    """The same by merging both sides in order of time."""
    starts = cat.start_day(F.col("teaching_starts"), F.col("academic_year"))
    editions = v.editions(spark, sf).withColumn("start_day", starts)
    found = asof.as_of(order_days(spark, sf), editions, ["course"], "day", "start_day", F.struct("academic_year"))
    return counted_editions(found.select("course", "day", "found.academic_year"))


@query("w02_current_past", "SELECT course, academic_year, strftime(day, '%Y-%m-%d') AS day, state FROM v_marks")
def w02(spark, sf):
    return cat.edition_states(seen_editions(spark, sf)).select(
        "course", "academic_year", iso("day").alias("day"), "state"
    )


PERMISSION_SQL = """SELECT user_id, course, academic_year, permission FROM (
    SELECT c.user_id, m.course, m.academic_year, m.state, c.as_teacher, c.as_secretariat, c.user_id % 25 = 24 AS super, c.user_id % 17 <> 16 AS active,
           unnest(['edition.view', 'edition.assign_teacher', 'edition.edit_content', 'edition.manage_materials']) AS permission
    FROM v_covered c JOIN v_marks m ON m.course = c.course AND m.day = DATE '1998-09-01')
    WHERE active AND (super OR as_secretariat OR (as_teacher AND NOT (state = 'past' AND permission = 'edition.assign_teacher')))"""


def edition_scopes(spark, sf):
    """Covered editions with their past mark and the caller's standing."""
    marks = cat.edition_states(cat.on_days(v.editions(spark, sf), [DAY]))
    covered = cat.edition_roles(v.editions(spark, sf), v.roles(spark, sf), v.entries(spark, sf))
    return covered.join(marks.select(*cat.EDITION, "state"), cat.EDITION).withColumns(
        {
            "past": F.col("state") == "past",
            "superuser": F.col("user_id") % 25 == 24,
            "active": F.col("user_id") % 17 != 16,
        }
    )


@query("u02_permission_algebra", PERMISSION_SQL)
def u02(spark, sf):
    return cat.permissions_on(edition_scopes(spark, sf))


def readable(spark, sf):
    marks = cat.edition_states(cat.on_days(v.editions(spark, sf), [DAY]))
    return cat.boundary(marks, v.entries(spark, sf), v.students(spark, sf), v.roles(spark, sf))


@query("u03_boundary", "SELECT user_id, course, academic_year, state, is_default FROM v_boundary")
def u03(spark, sf):
    return readable(spark, sf).select("user_id", "course", "academic_year", "state", "is_default")


@query(
    "u03_search_scope",
    """SELECT user_id, count(*) AS editions FROM v_boundary WHERE is_default OR (user_id % 3 = 0 AND academic_year = '1995-1996') GROUP BY 1""",
)
def u03_scope(spark, sf):
    """How many editions each user's questions search: the defaults and the added ones."""
    mine = readable(spark, sf)
    added = mine.where("user_id % 3 = 0 and academic_year = '1995-1996'")
    return cat.search_scope(mine, added).groupBy("user_id").agg(F.count("*").alias("editions"))


@query(
    "o01_scope_order",
    """SELECT user_id, course, row_number() OVER (PARTITION BY user_id ORDER BY COALESCE(year <> own_year, TRUE), year IS NULL, COALESCE(year, 0), lower(course_name), course) AS place FROM (
        SELECT b.user_id, b.course, s.year_of_study AS own_year, e.year_of_study AS year, n.course_name FROM (SELECT DISTINCT user_id, course FROM v_boundary) b
        LEFT JOIN v_students s USING (user_id) LEFT JOIN v_entries e ON e.programme = s.programme AND e.course = b.course LEFT JOIN v_entries n ON n.course = b.course)""",
)
def o01(spark, sf):
    return cat.scope_order(readable(spark, sf), v.students(spark, sf), v.entries(spark, sf))


@query(
    "a17_programme_rollup",
    """SELECT programme, COALESCE(string_agg(DISTINCT curriculum, ',' ORDER BY curriculum) FILTER (curriculum <> ''), '') AS curricula, count(DISTINCT course) AS courses
       FROM v_entries GROUP BY 1""",
)
def a17(spark, sf):
    return cat.programme_rollup(v.entries(spark, sf)).select(
        "programme", F.array_join("curricula", ",").alias("curricula"), "courses"
    )


@query(
    "a18_nested_prefetch",
    """SELECT n_nationkey AS course, n_name AS name, COALESCE((SELECT string_agg(academic_year, ' ' ORDER BY academic_year) FROM v_editions e WHERE e.course = n_nationkey), '') AS editions,
       COALESCE((SELECT string_agg(CAST(user_id AS VARCHAR), ' ' ORDER BY user_id) FROM v_roles r WHERE r.course = n_nationkey), '') AS teachers,
       COALESCE((SELECT m.academic_year FROM v_marks m WHERE m.course = n_nationkey AND m.day = DATE '1998-09-01' AND m.state = 'current'), '') AS current FROM nation""",
)
def a18(spark, sf):
    """Each course with its editions, its teachers and its current edition."""
    courses = v.entries(spark, sf).select("course", F.col("course_name").alias("name"))
    teachers = v.roles(spark, sf).where("role = 'teacher'").select("course", "user_id")
    marks = cat.edition_states(cat.on_days(v.editions(spark, sf), [DAY]))
    current = marks.where("state = 'current'").select("course", F.col("academic_year").alias("current"))
    nested = cat.with_children(courses, v.editions(spark, sf), "course", ["academic_year"], "editions")
    nested = cat.with_children(nested, teachers, "course", ["user_id"], "teachers")
    return nested.join(current, "course", "left").select(
        "course",
        "name",
        F.array_join("editions.academic_year", " ").alias("editions"),
        F.array_join(F.transform("teachers.user_id", lambda u: u.cast("string")), " ").alias("teachers"),
        F.coalesce("current", F.lit("")).alias("current"),
    )


@query(
    "x06_constraint_report",
    """SELECT rule, count(*) AS broken FROM (
        SELECT 'edition year' AS rule FROM v_editions WHERE NOT (CAST(right(academic_year, 4) AS INTEGER) = CAST(left(academic_year, 4) AS INTEGER) + 1)
        UNION ALL SELECT 'edition start' FROM v_editions WHERE teaching_starts IS NOT NULL AND NOT teaching_starts BETWEEN make_date(CAST(left(academic_year, 4) AS INTEGER), 9, 1) AND make_date(CAST(right(academic_year, 4) AS INTEGER), 8, 31)
        UNION ALL SELECT 'one scope' FROM v_roles WHERE (course IS NOT NULL) = (programme IS NOT NULL)
        UNION ALL SELECT 'why only down' FROM v_feedback WHERE reason <> '' AND rating <> 'down'
        UNION ALL SELECT 'material size' FROM v_materials WHERE bytes > 52428800
        UNION ALL SELECT 'material name' FROM (SELECT edition, name FROM v_materials GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'material bytes' FROM (SELECT edition, sha256 FROM v_materials GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY 1""",
)
def x06(spark, sf):
    Rule = cat.Rule
    problem = cat.edition_problems(F.col("academic_year"), F.col("teaching_starts"))
    reports = [
        cat.constraint_report(
            v.editions(spark, sf),
            F.concat_ws("|", "course", "academic_year"),
            [
                Rule("edition year", problem != "not two consecutive years"),
                Rule("edition start", problem != "starts outside its year"),
            ],
            {"edition key": cat.EDITION},
        ),
        cat.constraint_report(
            v.roles(spark, sf),
            F.col("user_id"),
            [Rule("one scope", F.col("course").isNotNull() != F.col("programme").isNotNull())],
        ),
        cat.constraint_report(
            v.feedback(spark, sf),
            F.col("answer_id"),
            [Rule("why only down", (F.col("reason") == "") | (F.col("rating") == "down"))],
            {"one rating": ["answer_id"]},
        ),
        cat.constraint_report(
            v.materials(spark, sf),
            F.col("doc_id"),
            [Rule("material size", F.col("bytes") <= 50 * 1024 * 1024)],
            {"material name": ["edition", "name"], "material bytes": ["edition", "sha256"]},
        ),
    ]
    rows = reports[0]
    for report in reports[1:]:
        rows = rows.unionByName(report)
    return rows.groupBy("rule").agg(F.count("*").alias("broken"))


@query(
    "x28_reconcile",
    """SELECT COALESCE(f.answer_id, m.answer_id) AS answer_id, CASE WHEN m.answer_id IS NULL THEN 'create' WHEN f.answer_id IS NULL THEN 'delete'
        WHEN f.rating <> m.rating OR f.reason <> m.reason THEN 'update' ELSE 'keep' END AS action
       FROM (SELECT * FROM v_feedback WHERE answer_id % 7 <> 0) f FULL OUTER JOIN v_mirror m ON f.answer_id = m.answer_id""",
)
def x28(spark, sf):
    desired = v.feedback(spark, sf).where("answer_id % 7 <> 0")
    return cat.reconcile(desired, v.mirror(spark, sf), "answer_id", ["rating", "reason"])


@query(
    "x29_merge_if_missing",
    """SELECT COALESCE(a.course, b.course) AS course, COALESCE(a.academic_year, b.academic_year) AS academic_year,
       COALESCE(strftime(COALESCE(a.teaching_starts, b.teaching_starts), '%Y-%m-%d'), 'none') AS teaching_starts
       FROM (SELECT * FROM v_editions WHERE course % 5 <> 0) a FULL OUTER JOIN
            (SELECT course, academic_year, make_date(CAST(left(academic_year, 4) AS INTEGER), 9, 15) AS teaching_starts FROM v_editions WHERE course % 3 <> 0) b
       ON a.course = b.course AND a.academic_year = b.academic_year""",
)
def x29(spark, sf):
    """A seed of editions merged into those already there."""
    held = v.editions(spark, sf).where("course % 5 <> 0")
    day = F.make_date(F.left("academic_year", F.lit(4)).cast("int"), F.lit(9), F.lit(15))
    seed = v.editions(spark, sf).where("course % 3 <> 0").withColumn("teaching_starts", day)
    return cat.merge_if_missing(held, seed, cat.EDITION).select(
        "course", "academic_year", F.coalesce(iso("teaching_starts"), F.lit("none")).alias("teaching_starts")
    )


@query(
    "j01_lookup_join",
    """SELECT f.answer_id, f.rating, d.source, COALESCE(b.text, 'none') AS question FROM v_feedback f JOIN documents d ON d.doc_id = f.answer_id LEFT JOIN benchmark b ON b.item_id = f.answer_id""",
)
def j01(spark, sf):
    """A rating with its answer and, where there is one, the question it answered."""
    answers = v.table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), "source")
    questions = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("q"))
    return (
        v.feedback(spark, sf)
        .join(answers, "answer_id")
        .join(questions, "answer_id", "left")
        .select("answer_id", "rating", "source", F.coalesce("q", F.lit("none")).alias("question"))
    )


@query(
    "j01_question_of",
    """SELECT a.id, COALESCE(q.id, 'none') AS question_id, COALESCE(q.role, 'none') AS asked_by FROM v_messages a LEFT JOIN v_messages q ON q.id = a.parent_id WHERE a.role = 'assistant'""",
)
def j01_question(spark, sf):
    """Each answer with the message it replies to."""
    messages = v.messages(spark, sf)
    asked = messages.select(F.col("id").alias("parent_id"), F.col("role").alias("asked_by"))
    return messages.where("role = 'assistant'").join(asked, "parent_id", "left").select(
        "id",
        F.coalesce(F.when(F.col("asked_by").isNotNull(), F.col("parent_id")), F.lit("none")).alias("question_id"),
        F.coalesce("asked_by", F.lit("none")).alias("asked_by"),
    )


SUMMARY_SQL = """(SELECT conv_id, any_value(owner) AS owner, COALESCE(left(arg_min(text, (created_at, id)) FILTER (role = 'user'), 60), '') AS title,
    COALESCE(arg_min(locale, (created_at, id)) FILTER (role = 'user'), '') AS title_locale, max(created_at) AS last_message_at,
    COALESCE(arg_max(id, (created_at, id)) FILTER (role = 'assistant' AND complete), '') AS last_sourced, bool_or(pinned) AS pinned FROM v_messages GROUP BY conv_id)"""


def summaries(spark, sf):
    return conv.conversation_summary(v.messages(spark, sf).withColumn("sourced", F.col("complete")))


@query(
    "w06_conversation_summary",
    f"SELECT conv_id, title, title_locale, strftime(last_message_at, '%Y-%m-%d %H:%M:%S') AS last_message_at, last_sourced, pinned FROM {SUMMARY_SQL}",
)
def w06(spark, sf):
    return summaries(spark, sf).select(
        "conv_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("title_locale", F.lit("")).alias("title_locale"),
        F.date_format("last_message_at", "yyyy-MM-dd HH:mm:ss").alias("last_message_at"),
        F.coalesce("last_sourced", F.lit("")).alias("last_sourced"),
        "pinned",
    )


@query(
    "o03_list_order",
    f"SELECT conv_id, conv_id % 10 AS owner, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY pinned DESC, last_message_at DESC, conv_id DESC) AS place FROM {SUMMARY_SQL}",
)
def o03(spark, sf):
    listed = summaries(spark, sf).withColumn("owner", F.col("conv_id") % 10)
    return conv.list_order(listed, ["owner"]).select("conv_id", "owner", "place")


@query(
    "o02_newest_n",
    "SELECT answer_id, rating, locale FROM v_feedback ORDER BY answer_id DESC LIMIT 50",
)
def o02(spark, sf):
    """The first page of ratings, newest first."""
    return (
        v.feedback(spark, sf)
        .orderBy(F.col("answer_id").desc())
        .limit(50)
        .select("answer_id", "rating", "locale")
    )


TURNS_SQL = """(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, question, text AS answer FROM (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asked_by, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM (
        SELECT conv_id, turn, role, text FROM v_messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6))
    WHERE role = 'assistant' AND asked_by = 'user')"""


@query("w07_recent_turns", f"SELECT * FROM {TURNS_SQL}")
def w07(spark, sf):
    return conv.recent_turns(v.messages(spark, sf))


@query(
    "f31_history_block",
    rf"""SELECT conv_id, string_agg('<quoted>' || chr(10) || 'Student: ' || question || chr(10) || 'Assistant: ' || CASE WHEN length(a) <= 400 THEN a ELSE rtrim(left(a, 400)) || '…' END
        || chr(10) || '</quoted>', chr(10) || chr(10) ORDER BY pos) AS history FROM (
        SELECT conv_id, pos, question, trim(regexp_replace(regexp_replace(answer, '\[[^\]]*\]', '', 'g'), '[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+', ' ', 'g')) AS a FROM {TURNS_SQL}) GROUP BY 1""",
)
def f31_history(spark, sf):
    return history_block(conv.recent_turns(v.messages(spark, sf)), "conv_id")


@query(
    "w10_sources_of",
    """SELECT answer_id, marker, pos, cited, row_number() OVER (PARTITION BY answer_id ORDER BY cited DESC, pos) AS place FROM (
        SELECT answer_id, marker, min(pos) AS pos, (answer_id, marker) IN (SELECT (answer_id, marker) FROM v_cited) AS cited FROM v_citations GROUP BY 1, 2)""",
)
def w10(spark, sf):
    held = v.citations(spark, sf)
    return conv.sources_of(held, cite.cited_markers(v.answers(spark, sf), held)).select(
        "answer_id", "marker", "pos", "cited", "place"
    )


@query(
    "w12_distinguishing_suffix",
    r"""WITH s AS (SELECT answer_id, pos, fetch_date, regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '^www\.', '') || chr(10) ||
            COALESCE(heading, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '')) AS alike,
            list_filter(string_split(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '/'), lambda x: x <> '') AS seg FROM v_citations WHERE kind = 'web'),
        ends AS (SELECT answer_id, pos, alike, n, array_to_string(seg[len(seg) - n + 1:], '/') AS e FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS n FROM s)),
        uniq AS (SELECT answer_id, pos, arg_min(e, n) AS e FROM (SELECT *, count(*) OVER (PARTITION BY answer_id, alike, n, e) AS k FROM ends) WHERE k = 1 GROUP BY 1, 2)
        SELECT s.answer_id, s.pos, COALESCE(u.e, s.fetch_date, '') AS told FROM (SELECT *, count(*) OVER (PARTITION BY answer_id, alike) AS m FROM s) s
        LEFT JOIN uniq u USING (answer_id, pos) WHERE m > 1""",
)
def w12(spark, sf):
    """Sources of a conversation's host that read alike, told apart."""
    return conv.distinctions(v.citations(spark, sf))


@query(
    "x24_thread_path",
    """SELECT conv_id || '-' || max(turn) OVER (PARTITION BY conv_id) AS leaf, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth, 'complete' AS status FROM v_messages""",
)
def x24(spark, sf):
    """Every conversation's thread from its newest message back to its first."""
    messages = v.messages(spark, sf)
    leaves = messages.groupBy("conv_id").agg(F.max_by("id", "turn").alias("leaf")).select("leaf")
    return conv.thread_paths(leaves, messages.select("id", "parent_id"))
