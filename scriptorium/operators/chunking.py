"""Documents to chunks: furniture headings, token budgets, page spans, profiles."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scriptorium.functions.text import nfkc_fold

# The token budget, and when a repeated heading is page furniture.
TOKEN_BUDGET = 512
FURNITURE_FLOOR = 5
FURNITURE_SHARE = 5
# What a page without text looks like and when a file needs recognition.
EMPTY_PAGE_CHARS = 50
RECOGNITION_SHARE = 0.3
MATH_FONT_HINTS = (
    "Symbol", "CMMI", "CMEX", "CMSY", "MTSY", "MathematicalPi", "Cambria Math", "STIX",
)


def furniture_headings(
    blocks: DataFrame, floor: int = FURNITURE_FLOOR, share: int = FURNITURE_SHARE
) -> DataFrame:
    """(doc_id, text) of headings on at least max(5, a fifth of the pages) distinct pages."""
    size = blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    repeated = (
        blocks.where("is_heading")
        .groupBy("doc_id", "text")
        .agg(F.countDistinct("page").alias("pages"))
    )
    threshold = F.greatest(F.lit(floor), F.ceil(F.col("n_pages") / share))
    return (
        repeated.join(size, "doc_id").where(F.col("pages") >= threshold).select("doc_id", "text")
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _packs(tokens: pd.Series, sections: pd.Series, budget: pd.Series) -> pd.Series:
    """Greedy packing of one document's pieces: a pack id per piece.

    A piece joins the pack before it while the section is the same and the budget holds.
    """

    def pack(sizes, homes, limit):
        ids, current, used, home = [], -1, 0, None
        for size, section in zip(sizes, homes):
            if section != home or used + size > limit:
                current, used, home = current + 1, 0, section
            used += size
            ids.append(current)
        return ids

    return pd.Series([pack(t, s, b) for t, s, b in zip(tokens, sections, budget)])


def chunk_documents(
    blocks: DataFrame, budget: int = TOKEN_BUDGET, fold: bool = True
) -> DataFrame:
    """Structural blocks -> chunks of at most `budget` tokens.

    `blocks`: doc_id, pos, text, is_heading, level (1 or 2), page. A chunk keeps to
    one heading chain; neighbours are merged while they fit; a block longer than the
    budget is cut. Furniture headings leave the path and the text that is embedded,
    never the chain. Everything after the first shuffle by document stays on it;
    texts stay in the JVM and only token counts visit Python.
    """
    furniture = furniture_headings(blocks).withColumn("furniture", F.lit(True))
    placed = blocks.join(furniture, ["doc_id", "text"], "left").repartition("doc_id")
    order = Window.partitionBy("doc_id").orderBy("pos")
    heading, level = F.col("is_heading"), F.col("level")
    at = F.struct("pos", F.when(F.col("furniture").isNull(), F.col("text")).alias("text"))
    chained = placed.withColumns(
        {
            "section": F.count_if(heading).over(order),
            "h1": F.last(F.when(heading & (level == 1), at), ignorenulls=True).over(order),
            "h2": F.last(F.when(heading & (level == 2), at), ignorenulls=True).over(order),
        }
    ).where(~heading)
    under = F.col("h2.pos") > F.coalesce(F.col("h1.pos"), F.lit(-1))
    path = F.array_compact(
        F.array(F.col("h1.text"), F.when(F.coalesce(under, F.lit(False)), F.col("h2.text")))
    )
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    pieces = (
        chained.select("doc_id", "pos", "page", "section", path.alias("path"), "text", words.alias("w"))
        .where(F.size("w") > 0)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / budget).cast("int"))))
        .select(
            "doc_id",
            "pos",
            "piece",
            "page",
            "section",
            "path",
            F.when(F.size("w") <= budget, F.col("text"))
            .otherwise(F.array_join(F.slice("w", F.col("piece") * budget + 1, budget), " "))
            .alias("text"),
            F.least(F.size("w") - F.col("piece") * budget, F.lit(budget)).alias("tokens"),
        )
    )
    # A document is one row of the source table, so its list of pieces is bounded by it.
    listed = (
        pieces.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "page", "section", "path", "text", "tokens"))).alias("p"))
        .withColumn("packs", _packs(F.col("p.tokens"), F.col("p.section"), F.lit(budget)))
    )
    packed = listed.select(
        "doc_id", F.explode(F.arrays_zip("p", "packs")).alias("x")
    ).select("doc_id", F.col("x.packs").cast("long").alias("chunk_index"), "x.p.*")
    joined = (
        packed.groupBy("doc_id", "chunk_index")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "piece", "text"))).alias("parts"),
            F.array_sort(F.collect_set("page")).alias("pages"),
            F.first("path").alias("heading_path"),
            F.sum("tokens").alias("tokens"),
        )
        .withColumn("text", F.array_join(F.col("parts.text"), "\n"))
    )
    text = nfkc_fold("text") if fold else F.col("text")
    return joined.withColumn("text", text).select(
        "doc_id",
        "chunk_index",
        "text",
        F.array_join(F.concat("heading_path", F.array("text")), "\n").alias("embed_text"),
        "heading_path",
        F.element_at("pages", 1).alias("page"),
        "pages",
        "tokens",
    )


def math_fonts(names: Column) -> Column:
    """The font names that look like mathematical typesetting, sorted."""

    def looks_mathematical(name: Column) -> Column:
        hit = F.lit(False)
        for hint in MATH_FONT_HINTS:
            hit = hit | F.contains(F.lower(name), F.lit(hint.lower()))
        return hit

    return F.array_sort(F.array_distinct(F.filter(names, looks_mathematical)))


def document_profile(pages: DataFrame) -> DataFrame:
    """Per document: pages, mean characters, share of empty pages, images, math fonts.

    `pages`: doc_id, page, chars, images, fonts (array).
    """
    return (
        pages.groupBy("doc_id")
        .agg(
            F.count("*").alias("pages"),
            F.floor(F.sum("chars") / F.count("*")).alias("chars_per_page"),
            F.avg((F.col("chars") < EMPTY_PAGE_CHARS).cast("double")).alias("empty_share"),
            F.sum("images").alias("images"),
            F.flatten(F.collect_set(math_fonts(F.col("fonts")))).alias("fonts"),
        )
        .withColumn("math_fonts", F.array_sort(F.array_distinct("fonts")))
        .drop("fonts")
    )


def parse_plan(profiles: DataFrame) -> DataFrame:
    """How each document should be parsed, and why."""
    recognise = F.col("empty_share") > RECOGNITION_SHARE
    formula = F.size("math_fonts") > 0
    share = F.concat(
        F.round(F.col("empty_share") * 100).cast("int").cast("string"),
        F.lit("% of pages carry no text layer"),
    )
    fonts = F.concat(F.lit("math fonts present ("), F.array_join("math_fonts", ", "), F.lit(")"))
    reasons = F.concat_ws(" + ", F.when(recognise, share), F.when(formula, fonts))
    return profiles.select(
        "doc_id",
        recognise.alias("ocr"),
        formula.alias("formula"),
        F.concat_ws("-", F.lit("classic"), F.when(recognise, "ocr"), F.when(formula, "formula")).alias("variant"),
        F.when(reasons == "", "text layer intact, no math fonts").otherwise(reasons).alias("reason"),
    )
