"""The course catalogue: edition states, roles, what a user may read, data checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions.ids import ACADEMIC_YEAR_PATTERN, consecutive_years

EDITION = ["course", "academic_year"]

# Permissions, the roles that hold them, and what a role loses on past editions.
EDITION_PERMISSIONS = (
    "edition.view",
    "edition.assign_teacher",
    "edition.edit_content",
    "edition.manage_materials",
)
PROGRAMME_PERMISSIONS = ("programme.view", "programme.assign_secretariat")
ROLE_PERMISSIONS = {
    "teacher": EDITION_PERMISSIONS,
    "secretariat": ("programme.view", *EDITION_PERMISSIONS),
}
NOT_ON_PAST = {"teacher": ("edition.assign_teacher",)}
# The day an academic year starts and the month its window opens.
YEAR_START = "-09-01"


def start_day(teaching_starts: Column, academic_year: Column) -> Column:
    """When an edition's teaching starts: its date, or 1 September of its first year."""
    fallback = F.try_to_date(F.concat(F.left(academic_year, F.lit(4)), F.lit(YEAR_START)))
    return F.coalesce(teaching_starts, fallback)


def edition_problems(academic_year: Column, teaching_starts: Column) -> Column:
    """What is wrong with an edition's dates, '' when nothing is."""
    first = F.regexp_extract(academic_year, ACADEMIC_YEAR_PATTERN, 1).try_cast("int")
    opens = F.make_date(first, F.lit(9), F.lit(1))
    closes = F.make_date(first + 1, F.lit(8), F.lit(31))
    return (
        F.when(~consecutive_years(academic_year), "not two consecutive years")
        .when(teaching_starts.isNull() | teaching_starts.between(opens, closes), "")
        .otherwise("starts outside its year")
    )


def on_days(editions: DataFrame, days: Sequence[str]) -> DataFrame:
    """Editions seen from each of a few days, with whether they have started."""
    listed = F.array(*[F.to_date(F.lit(d)) for d in days])
    started = start_day(F.col("teaching_starts"), F.col("academic_year")) <= F.col("day")
    return editions.withColumn("day", F.explode(listed)).withColumn("started", started)


def later_started(editions: DataFrame) -> DataFrame:
    """Editions of whose course a later year has started, by a non-equi semi join.

    `editions`: course, academic_year, day, started.
    """
    later = editions.where("started").select(
        F.col("course").alias("c"), F.col("day").alias("d"), F.col("academic_year").alias("later")
    )
    return editions.join(
        later,
        (F.col("course") == F.col("c"))
        & (F.col("day") == F.col("d"))
        & (F.col("later") > F.col("academic_year")),
        "left_semi",
    )


def edition_states(editions: DataFrame) -> DataFrame:
    """current, past or upcoming, from one maximum per course and day.

    An edition is current when it has started and no later year of its course has,
    past when it is older than the current one.
    """
    by_course = Window.partitionBy("course", "day")
    newest = F.max(F.when(F.col("started"), F.col("academic_year"))).over(by_course)
    state = (
        F.when(F.col("academic_year") == newest, "current")
        .when(F.col("academic_year") < newest, "past")
        .otherwise("upcoming")
    )
    return editions.withColumn("state", state)


def edition_as_of(asks: DataFrame, editions: DataFrame) -> DataFrame:
    """For each (course, day) asked, the newest edition whose teaching has started.

    A course's few editions travel as one array, so the large side of the join keeps
    its row count and a course asked about by a third of all rows splits like any
    skewed key.
    """
    listed = editions.groupBy("course").agg(
        F.collect_list(
            F.struct(
                "academic_year",
                start_day(F.col("teaching_starts"), F.col("academic_year")).alias("starts"),
            )
        ).alias("known")
    )
    begun = F.filter("known", lambda e: e["starts"] <= F.col("day"))
    newest = F.array_max(F.transform(begun, lambda e: e["academic_year"]))
    return asks.join(listed, "course", "left").withColumn("academic_year", newest).drop("known")


def edition_roles(editions: DataFrame, roles: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, course, academic_year, as_teacher, as_secretariat), one row per pair.

    A teacher covers every edition of a course they teach; a secretary covers the
    editions of every course their programme lists, once however often it is listed.
    """
    taught = roles.where("role = 'teacher'").select("user_id", "course").distinct()
    listed = (
        roles.where("role = 'secretariat'")
        .select("user_id", "programme")
        .join(entries.select("programme", "course").distinct(), "programme")
        .select("user_id", "course")
        .distinct()
    )
    covered = taught.withColumn("role", F.lit("teacher")).unionByName(
        listed.withColumn("role", F.lit("secretariat"))
    )
    flags = covered.groupBy("user_id", "course").agg(
        F.bool_or(F.col("role") == "teacher").alias("as_teacher"),
        F.bool_or(F.col("role") == "secretariat").alias("as_secretariat"),
    )
    return editions.select(*EDITION).join(flags, "course")


def courses_for(entries: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, course) of the courses listed by a programme the user may view."""
    viewing = [r for r, held in ROLE_PERMISSIONS.items() if "programme.view" in held]
    seen = roles.where(F.col("role").isin(*viewing)).select("user_id", "programme")
    return entries.select("programme", "course").join(seen, "programme").select(
        "user_id", "course"
    ).distinct()


def _permission_array(role: str, past: bool) -> Column:
    lost = NOT_ON_PAST.get(role, ()) if past else ()
    return F.array(*[F.lit(p) for p in ROLE_PERMISSIONS[role] if p not in lost])


def permissions_on(scopes: DataFrame) -> DataFrame:
    """What each user holds on each edition: one row per permission.

    `scopes`: user_id, course, academic_year, as_teacher, as_secretariat, past,
    superuser, active. Each covering role adds what it holds on its own; only the
    permissions of this kind of scope count.
    """
    none = F.array().cast("array<string>")

    def held_by(role: str, flag: str) -> Column:
        held = F.when(F.col("past"), _permission_array(role, True)).otherwise(
            _permission_array(role, False)
        )
        return F.when(F.col(flag), held).otherwise(none)

    union = F.array_union(held_by("teacher", "as_teacher"), held_by("secretariat", "as_secretariat"))
    scoped = F.array(*[F.lit(p) for p in EDITION_PERMISSIONS])
    granted = (
        F.when(~F.col("active"), none)
        .when(F.col("superuser"), scoped)
        .otherwise(F.array_intersect(union, scoped))
    )
    return scopes.select("user_id", *EDITION, F.explode(granted).alias("permission"))


def boundary(
    editions: DataFrame, entries: DataFrame, students: DataFrame, roles: DataFrame
) -> DataFrame:
    """The editions each user may read: (user_id, course, academic_year, state, is_default).

    `editions` carries its state. Declared programme and started, or viewed through a
    role; searched by default when current, or taught and not past.
    """
    listed = entries.select("programme", "course").distinct()
    started = editions.where(F.col("state").isin("current", "past"))
    declared = (
        students.select("user_id", "programme")
        .join(listed, "programme")
        .join(started, "course")
        .select("user_id", *EDITION, "state", F.lit(False).alias("as_teacher"))
    )
    viewed = (
        edition_roles(editions, roles, entries)
        .join(editions, EDITION)
        .select("user_id", *EDITION, "state", "as_teacher")
    )
    merged = (
        declared.unionByName(viewed)
        .groupBy("user_id", *EDITION, "state")
        .agg(F.bool_or("as_teacher").alias("as_teacher"))
    )
    default = (F.col("state") == "current") | (F.col("as_teacher") & (F.col("state") != "past"))
    return merged.withColumn("is_default", default)


def search_scope(readable: DataFrame, added: DataFrame) -> DataFrame:
    """The editions a question searches: the default ones and those the user added."""
    extra = added.select("user_id", *EDITION).distinct().withColumn("added", F.lit(True))
    return readable.join(extra, ["user_id", *EDITION], "left").where(
        F.col("is_default") | F.col("added")
    ).select("user_id", *EDITION)


def scope_order(readable: DataFrame, students: DataFrame, entries: DataFrame) -> DataFrame:
    """Each user's courses in the order they are listed: (user_id, course, place).

    Own study year first, then the programme's other years, then courses a role
    alone brings; by name and code within each.
    """
    own = students.select("user_id", "programme", F.col("year_of_study").alias("own_year"))
    names = entries.groupBy("course").agg(F.first("course_name").alias("name"))
    years = entries.groupBy("programme", "course").agg(F.min("year_of_study").alias("year"))
    courses = readable.select("user_id", "course").distinct()
    placed = (
        courses.join(own, "user_id", "left")
        .join(years, ["programme", "course"], "left")
        .join(names, "course", "left")
    )
    year = F.col("year")
    order = Window.partitionBy("user_id").orderBy(
        F.coalesce(year != F.col("own_year"), F.lit(True)),
        year.isNull(),
        F.coalesce(year, F.lit(0)),
        F.lower("name"),
        "course",
    )
    return placed.select(
        "user_id", "course", F.row_number().over(order).cast("long").alias("place")
    )


def programme_rollup(entries: DataFrame) -> DataFrame:
    """Per programme its curricula and how many courses it lists."""
    named = F.when(F.col("curriculum") != "", F.col("curriculum"))
    return entries.groupBy("programme").agg(
        F.array_sort(F.collect_set(named)).alias("curricula"),
        F.countDistinct("course").alias("courses"),
    )


def with_children(
    parents: DataFrame, children: DataFrame, on: str | list[str], order: Sequence[str], into: str
) -> DataFrame:
    """Parents with their children as one sorted array, empty when there are none."""
    keys = [on] if isinstance(on, str) else on
    listed = children.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias(into)
    )
    joined = parents.join(listed, keys, "left")
    kind = joined.schema[into].dataType
    return joined.withColumn(into, F.coalesce(into, F.array().cast(kind)))


@dataclass(frozen=True)
class Rule:
    """A named condition every row of a table should meet."""

    name: str
    holds: Column


def constraint_report(
    table: DataFrame, key: Column, rules: Sequence[Rule], unique: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Rows that break a rule: (rule, row_key). All row rules are one pass over the table."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules])
    )
    found = table.select(key.cast("string").alias("row_key"), F.explode(broken).alias("rule"))
    for name, columns in (unique or {}).items():
        repeated = (
            table.groupBy(*columns)
            .agg(F.count("*").alias("n"))
            .where("n > 1")
            .select(F.concat_ws("|", *columns).alias("row_key"), F.lit(name).alias("rule"))
        )
        found = found.unionByName(repeated)
    return found.select("rule", "row_key")


def merge_if_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seed merge: insert what is absent, fill only nulls of what is there, keep the rest."""
    fields = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*fields).alias("old"))
    new = incoming.select(*keys, F.struct(*fields).alias("new"))
    return old.join(new, list(keys), "full_outer").select(
        *keys, *[F.coalesce(f"old.{c}", f"new.{c}").alias(c) for c in fields]
    )


def reconcile(desired: DataFrame, mirrored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """What to do so a mirror holds the desired rows: create, update, delete or nothing."""
    want = desired.select(key, F.struct(*fields).alias("want"))
    have = mirrored.select(key, F.struct(*fields).alias("have"))
    action = (
        F.when(F.col("have").isNull(), "create")
        .when(F.col("want").isNull(), "delete")
        .when(~F.col("want").eqNullSafe(F.col("have")), "update")
        .otherwise("keep")
    )
    return want.join(have, key, "full_outer").select(key, action.alias("action"))
