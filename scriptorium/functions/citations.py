"""References in answers: which citations an answer names, and its text without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How an answer writes a reference.
CODE_PATTERN = r"(?s)```.*?```|`[^`\n]*`"
NUMBER_PATTERN = r"(?<!\w)\[(\d+)\](?!\()"
EXCERPT_PATTERN = r"\[Excerpt\s+\d+\]|\(Excerpt\s+\d+\)|\bExcerpt\s+\d+\b"
EXCERPT_LIST_PATTERN = (
    r"[\[(（【]\s*Excerpt\s+\d+(?:(?:\s*[,;&、，；]\s*|\s+(?:e|ed|and|et|y|und|o|or)\s+|"
    r"\s*[和与及或]\s*)(?:Excerpt\s+)?\d+)+\s*[\])）】]"
)
BRACKETED_PATTERN = r"\[[^\]]*\]"


def without_code(answer: Column) -> Column:
    return F.regexp_replace(answer, CODE_PATTERN, " ")


def referenced_numbers(answer: Column, count: Column) -> Column:
    """The numbers an answer refers to, of an answer with `count` citations.

    A list is read whole: one number without a citation and it is no list, only its
    references that stand by themselves are.
    """
    prose = without_code(answer)
    numbers = lambda s: F.transform(
        F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("long")
    )
    resolves = lambda n: F.coalesce((n >= 1) & (n <= count), F.lit(False))
    lists = F.filter(
        F.transform(F.regexp_extract_all(prose, F.lit(EXCERPT_LIST_PATTERN), F.lit(0)), numbers),
        lambda found: F.forall(found, resolves),
    )
    single = F.transform(
        F.concat(
            F.regexp_extract_all(prose, F.lit(NUMBER_PATTERN), F.lit(1)),
            F.regexp_extract_all(prose, F.lit(EXCERPT_PATTERN), F.lit(0)),
        ),
        numbers,
    )
    return F.array_distinct(F.filter(F.flatten(F.concat(lists, single)), resolves))


def cited_markers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per (answer, cited marker).

    A number names the n-th citation; a marker written out names itself. A number
    with no citation behind it stays prose.
    """
    counted = citations.groupBy("answer_id").agg(F.count_distinct("pos").alias("known"))
    cited = (
        answers.join(counted, "answer_id")
        .withColumn("numbers", referenced_numbers(F.col("answer"), F.col("known")))
        .select("answer_id", "answer", "numbers")
        .join(citations.select("answer_id", "pos", "marker"), "answer_id")
    )
    named = F.array_contains("numbers", F.col("pos") + 1)
    spelled = F.contains(without_code(F.col("answer")), F.col("marker"))
    return cited.where(named | spelled).select("answer_id", "marker").distinct()


def without_brackets(answer: Column) -> Column:
    """An old answer as history shows it: nothing left to cite from."""
    return F.regexp_replace(answer, BRACKETED_PATTERN, "")


def strip_citations(answer: Column, numbers: Column, markers: Column) -> Column:
    """The text without the references that resolve, nor the spaces leading to them.

    A reference that opens a line takes the spaces after it; code is left alone. The
    longest form comes first: whole lists of known numbers, then single references,
    then markers. An answer without citations only loses its outer blanks.
    """
    known = F.concat(F.lit("(?:"), F.array_join(F.transform(numbers, lambda n: n.cast("string")), "|"), F.lit(")(?!\\d)"))
    joiner = r"(?:\s*[,;&、，；]\s*|\s+(?:e|ed|and|et|y|und|o|or)\s+|\s*[和与及或]\s*)"
    longest_first = F.array_sort(markers, lambda a, b: F.length(b) - F.length(a))
    forms = F.when(
        F.size(numbers) > 0,
        F.array(
            F.concat(F.lit(r"[\[(（【]\s*Excerpt\s+"), known, F.lit(f"(?:{joiner}(?:Excerpt\\s+)?"), known, F.lit(r")+\s*[\])）】]")),
            F.concat(F.lit(r"(?<!\w)\["), known, F.lit(r"\](?!\()")),
            F.concat(F.lit(r"\[Excerpt\s+"), known, F.lit(r"\]")),
            F.concat(F.lit(r"\(Excerpt\s+"), known, F.lit(r"\)")),
            F.concat(F.lit(r"\bExcerpt\s+"), known, F.lit(r"\b")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    literal = F.transform(
        F.filter(longest_first, lambda m: m != ""), lambda m: F.concat(F.lit("\\Q"), m, F.lit("\\E"))
    )
    reference = F.concat(F.lit("(?:"), F.array_join(F.concat(forms, literal), "|"), F.lit(")"))
    pattern = F.concat(
        F.lit("(?m)(```(?s:.*?)```|`[^`\\n]*`)|^(?:[ \\t]*"),
        reference,
        F.lit(")+[ \\t]*|[ \\t]*"),
        reference,
    )
    nothing = F.coalesce(F.size(numbers) + F.size(markers), F.lit(0)) <= 0
    return F.btrim(F.when(nothing, answer).otherwise(F.regexp_replace(answer, pattern, F.lit("$1"))))


def citation_of(columns: dict[str, Column]) -> list[Column]:
    """A hit as a citation: a web page has no edition, a slide deck no address."""
    web = columns["kind"] == "web"
    slides = ~web
    return [
        columns["kind"].alias("kind"),
        columns["source_file"].alias("source_file"),
        columns["page"].alias("page"),
        columns["marker"].alias("marker"),
        F.when(slides, columns["academic_year"]).alias("academic_year"),
        F.when(slides, columns["source_sha256"]).alias("source_sha256"),
        F.when(web, columns["url"]).alias("url"),
        F.when(web, columns["fetch_date"]).alias("fetch_date"),
    ]
