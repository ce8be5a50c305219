"""Conversations and their citations: threads, summaries, turns, source lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from scriptorium.functions import urls
from scriptorium.session import cut_lineage

# How many earlier exchanges a question sees, and a title's length.
HISTORY_TURNS = 3
TITLE_CHARS = 60


def thread_paths(leaves: DataFrame, messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths by parent pointers: (leaf, id, depth, status).

    Path doubling: round r knows every message's 2^r-th ancestor and extends every
    path by as much, so a thread of n messages takes log n rounds of equi-joins. A leaf
    whose path meets a message again has gone round a cycle and grows no further.
    `depth` counts from the root; status is complete, missing parent or cycle.
    """
    parents = messages.select("id", "parent_id")
    jump = cut_lineage(parents.select(F.col("id").alias("at"), F.col("parent_id").alias("to")))
    path = cut_lineage(
        leaves.select(F.col("leaf"), F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up"))
    )
    growing, reach, looped = path, 1, False
    while True:
        longer = growing.join(jump, path.id == jump["at"]).where("to is not null").select(
            "leaf", F.col("to").alias("id"), (F.col("up") + reach).alias("up")
        )
        grown = cut_lineage(longer)
        if grown.isEmpty():
            break
        again = cut_lineage(grown.join(path.select("leaf", "id"), ["leaf", "id"], "left_semi").select("leaf").distinct())
        looped = looped or not again.isEmpty()
        path = cut_lineage(path.unionByName(grown))
        growing = path.join(grown.select("leaf").distinct(), "leaf", "left_semi").join(again, "leaf", "left_anti")
        step = jump.select(F.col("at").alias("mid"), F.col("to").alias("far"))
        jump = cut_lineage(
            jump.where("to is not null")
            .join(step, F.col("to") == F.col("mid"))
            .select("at", F.col("far").alias("to"))
        )
        reach *= 2
    known = parents.withColumn("known", F.lit(True))
    if looped:
        # a path that went round shows each message once
        path = path.groupBy("leaf", "id").agg(F.min("up").alias("up"))
    placed = path.join(known, "id", "left")
    by_leaf = placed.groupBy("leaf").agg(
        F.max("up").alias("top"),
        F.bool_or(F.col("known").isNull()).alias("lost"),
        F.bool_or(F.col("known") & F.col("parent_id").isNull()).alias("rooted"),
    )
    status = (
        F.when(F.col("rooted"), "complete").when(F.col("lost"), "missing parent").otherwise("cycle")
    )
    return (
        placed.where("known")
        .join(by_leaf, "leaf")
        .select(
            "leaf",
            "id",
            (F.col("top") - F.col("up") - F.when(F.col("lost"), 1).otherwise(0)).alias("depth"),
            status.alias("status"),
        )
    )


def conversation_summary(messages: DataFrame) -> DataFrame:
    """Per conversation its title, last message and last sourced answer, in one aggregate.

    `messages`: conv_id, id, role, text, locale, created_at, pinned, sourced.
    """
    at = F.struct("created_at", "id")
    asked = F.col("role") == "user"
    sourced = (F.col("role") == "assistant") & F.col("sourced")
    return messages.groupBy("conv_id").agg(
        F.left(F.min_by(F.when(asked, F.col("text")), F.when(asked, at)), F.lit(TITLE_CHARS)).alias("title"),
        F.min_by(F.when(asked, F.col("locale")), F.when(asked, at)).alias("title_locale"),
        F.max("created_at").alias("last_message_at"),
        F.max_by(F.when(sourced, F.col("id")), F.when(sourced, at)).alias("last_sourced"),
        F.bool_or("pinned").alias("pinned"),
    )


def list_order(summaries: DataFrame, groups: list[str]) -> DataFrame:
    """Conversations as a sidebar lists them: pinned first, then by last message."""
    order = Window.partitionBy(*groups).orderBy(
        F.col("pinned").desc(), F.col("last_message_at").desc(), F.col("conv_id").desc()
    )
    return summaries.withColumn("place", F.row_number().over(order).cast("long"))


def recent_turns(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """The last exchanges of each thread: (conv_id, pos, question, answer).

    Among a thread's last 2 x turns messages an answer pairs with the message just
    before it when that is a question; a question nobody answered is passed over.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    order = Window.partitionBy("conv_id").orderBy("turn")
    tail = (
        messages.select("conv_id", "turn", "role", "text")
        .withColumn("back", F.row_number().over(newest))
        .where(F.col("back") <= turns * 2)
    )
    paired = tail.withColumns(
        {"asked_by": F.lag("role").over(order), "question": F.lag("text").over(order)}
    ).where("role = 'assistant' and asked_by = 'user'")
    return paired.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("pos"),
        "question",
        F.col("text").alias("answer"),
    )


def sources_of(citations: DataFrame, cited: DataFrame) -> DataFrame:
    """One citation per marker, cited ones first, in retrieval order: adds `cited`, `place`."""
    first = citations.groupBy("answer_id", "marker").agg(F.min("pos").alias("pos"))
    marked = first.join(
        cited.select("answer_id", "marker").withColumn("cited", F.lit(True)),
        ["answer_id", "marker"],
        "left",
    ).withColumn("cited", F.coalesce("cited", F.lit(False)))
    order = Window.partitionBy("answer_id").orderBy(F.col("cited").desc(), "pos")
    return marked.withColumn("place", F.row_number().over(order).cast("long"))


def distinctions(sources: DataFrame, scope: str = "answer_id", key: str = "pos") -> DataFrame:
    """What tells apart web sources that read alike: (scope, key, told).

    The shortest end of the path no other source of the group shares, else the fetch
    date. Suffixes are counted per (group, length, text), so no pairs are formed.
    """
    web = sources.where("kind = 'web' and url is not null").select(
        scope,
        key,
        "fetch_date",
        F.concat_ws(
            "\n",
            urls.bare_host(F.col("url")),
            urls.source_title(F.col("heading"), F.col("kind"), F.col("url"), F.col("source_file")),
        ).alias("alike"),
        F.filter(F.split(urls.path_of(F.col("url")), "/"), lambda s: s != "").alias("segments"),
    )
    group = Window.partitionBy(scope, "alike")
    crowded = web.withColumn("members", F.count("*").over(group)).where("members > 1")
    ends = crowded.where(F.size("segments") > 0).select(
        scope, key, "alike", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("n"), "segments"
    ).withColumn(
        "end", F.array_join(F.slice("segments", F.size("segments") - F.col("n") + 1, F.col("n")), "/")
    )
    same = Window.partitionBy(scope, "alike", "n", "end")
    shortest = (
        ends.withColumn("holders", F.count("*").over(same))
        .where("holders = 1")
        .groupBy(scope, key)
        .agg(F.min_by("end", "n").alias("end"))
    )
    return crowded.select(scope, key, "fetch_date").join(shortest, [scope, key], "left").select(
        scope, key, F.coalesce("end", "fetch_date", F.lit("")).alias("told")
    )
