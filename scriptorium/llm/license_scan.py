"""License scans: an exact containment join of text blocks with license templates.

A block is a line of a text, or a window: as many words in a row as the template has,
wherever lines break. A template meets a block when the block holds at least `threshold`
of the template's words, as sets. The join is a prefix join:
tokens in one global order, rarest first by their count over all blocks of the corpus; a
block that reaches the overlap o = ceil(threshold * |T|) must hold one of the |T| - o + 1
first tokens of T among its own first |B| - o + 1; lengths and positions bound the rest,
and an exact intersection decides. Words of no template can't add to an overlap, so a
block is kept as its template words only. For windows whole texts are joined first, as a
window holds no word its text lacks; only texts met are walked. DataFrame functions only.

The templates are a parameter, a few hundred short lines at most; the corpus is never
gathered. Besides, phrases are looked up word by word wherever they stand (`n_base`).

Defined results: a null text is empty; texts without words have no label; rows are
judged each by its own text, so repeated rows repeat; an empty table gives an empty one;
columns other than the two named are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.columns import let
from scriptorium.session import written_once

# Phrases whose consecutive words name a license.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# License lines, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted"),
]
THRESHOLD = 0.8

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, in order.

    `lower` folds letters beyond A-Z too; the phrases and templates are ASCII, and the
    only other character it folds to a lone ASCII letter (the kelvin sign) gives a k,
    which none of them holds.
    """
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _overlap_needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def _places(words: Column, phrase: list[str]) -> Column:
    """Every index of `words` at which the phrase begins."""

    def here(i: Column) -> Column:
        return reduce(and_, (F.get(words, i + k) == word for k, word in enumerate(phrase)))

    return F.when(
        F.size(words) >= len(phrase),
        F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here),
    ).otherwise(F.array().cast("array<int>"))


def phrase_counts(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Word count, phrase places and phrase labels beside `doc_id` and `digest`; no shuffle.

    A pattern over the text finds the few texts that can hold a phrase; only those are
    walked word by word.
    """
    pattern = "|".join(GAP.join(p.split(" ")) for p in phrases)
    split = docs.select("doc_id", "digest", "text", license_words(F.col("text")).alias("words"))

    def labelled(phrase: str, label: str) -> Column:
        at = _places(F.col("words"), phrase.split(" "))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    places = [labelled(phrase, label) for phrase, label in phrases.items()]
    none = F.array().cast("array<struct<at:int,label:string>>")
    found = F.when(F.lower("text").rlike(pattern), F.concat(*places)).otherwise(none)
    return split.select(
        "doc_id", "digest", F.size("words").cast("bigint").alias("n_words"), found.alias("found")
    ).select(
        "doc_id",
        "digest",
        "n_words",
        F.size("found").cast("bigint").alias("n_base"),
        F.array_min(F.transform("found", lambda x: x["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("found", lambda x: x["at"])).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("base_list"),
    )


def _blocks(docs: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """Lines as arrays of their distinct template words, in the order of `vocabulary`.

    Lines with fewer than `least` such words reach no template and end here.
    """
    order = F.array(*(F.lit(w) for w in vocabulary))
    lines = docs.select(
        "doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("line", "block")
    ).where(F.length("block") >= 2 * least - 1)
    sets = lines.select(
        "doc_id", "digest", "line", F.array_intersect(order, license_words(F.col("block"))).alias("tokens")
    )
    return sets.where(F.size("tokens") >= least)


def _texts(docs: DataFrame, vocabulary: list[str], least: int) -> DataFrame:
    """Texts of several lines, with their distinct template words in the order of `vocabulary`."""
    order = F.array(*(F.lit(w) for w in vocabulary))
    sets = docs.where(F.contains("text", F.lit("\n"))).select(
        "doc_id", "digest", F.lit(None).cast("int").alias("line"), "text",
        F.array_intersect(order, license_words(F.col("text"))).alias("tokens"),
    )
    return sets.where(F.size("tokens") >= least)


def _best_window(text: Column, tokens: Column, size: Column) -> Column:
    """The most distinct `tokens` in `size` words in a row; a best window begins with one of them."""

    def best(words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(tokens, F.get(words, i)))
        return F.array_max(F.transform(at, lambda i: F.size(F.array_intersect(tokens, F.slice(words, i + 1, size)))))

    return let(license_words(text), best)


def _met(blocks: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """Every block with every template it meets as a whole, once, and the words they share."""
    # the shortest prefix any template can ask of a block
    heads = blocks.select(
        "*", F.posexplode(F.slice("tokens", 1, F.greatest(F.lit(1), F.size("tokens") - least + 1))).alias("b_at", "token")
    )
    return (
        heads.join(index, "token")
        .where(F.size("tokens") >= F.col("need"))
        .where(F.col("b_at") <= F.size("tokens") - F.col("need"))
        .where(
            1 + F.least(F.size("tokens") - F.col("b_at") - 1, F.size("t_tokens") - F.col("t_at") - 1) >= F.col("need")
        )
        .withColumn("common", F.array_intersect("t_tokens", "tokens"))
        # a pair is judged at its first common token only
        .where(F.element_at("common", 1) == F.col("token"))
        .where(F.size("common") >= F.col("need"))
    )


def template_matches(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(doc_id, digest, line, template, label, containment) of every block that meets a template.

    `docs` has doc_id, digest and text. A text's windows are one row a template, without a
    line, with the containment of the best.
    """
    spark = docs.sparkSession
    sets = [(i, label, text.split(" ")) for i, (label, text) in enumerate(templates)]
    least = min(_overlap_needed(len(set(s)), threshold) for _, _, s in sets)
    vocabulary = sorted({w for _, _, s in sets for w in s})
    counts = {
        r["token"]: r["n"]  # at most one row a template word
        for r in _blocks(docs, vocabulary, 1)
        .select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(vocabulary)}
    entries = []
    for i, label, words in sets:
        tokens = sorted(set(words), key=rank.get)
        need = _overlap_needed(len(tokens), threshold)
        for at, token in enumerate(tokens[: len(tokens) - need + 1]):
            entries.append((token, at, i, label, need, tokens, len(words)))
    index = spark.createDataFrame(
        entries, "token string, t_at int, template int, label string, need int, t_tokens array<string>, t_words int"
    )
    # a few rows a template, and templates are a parameter: small by construction
    index = F.broadcast(index)
    found = ["doc_id", "digest", "line", "template", "label", "need", "t_tokens"]
    lines = _met(_blocks(docs, vocabulary, least), index, least).select(*found, F.size("common").alias("held"))
    windows = _met(_texts(docs, vocabulary, least), index, least).select(
        *found, _best_window(F.col("text"), F.col("t_tokens"), F.col("t_words")).alias("held")
    )
    met = lines.unionByName(windows.where(F.col("held") >= F.col("need")))
    return met.select(
        "doc_id", "digest", "line", "template", "label", (F.col("held") / F.size("t_tokens")).alias("containment")
    )


def license_scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row a document: phrase places, labels of phrases and templates, and a score.

    The score is 1 where a phrase stands, else the best containment of a template met.
    Matches join by key and text digest, so rows that share a key are still told apart.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("digest", F.xxhash64("text"))
    base = phrase_counts(own, phrases)
    found = (
        template_matches(own, templates, threshold)
        .groupBy(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest"))
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    )
    found = written_once(found, "license-matches")
    joined = base.join(
        found, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest")), "left"
    )
    listed = F.array_sort(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(listed, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
