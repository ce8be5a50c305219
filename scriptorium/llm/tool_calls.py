"""Tool-call linking: calls meet their results, in order, checked and in one spelling.

Messages of assistants hold calls, `{"tool_calls": [{"id", "name", "arguments", "after"}]}`,
messages of tools hold results, `{"tool_call_id", "content"}`. Calls and results are
hash-joined by conversation and identifier. A call comes after the calls it names in
`after`; levels of that order are found by pointer doubling along chains and rounds of
joins where a call has several dependencies, so a conversation is never gathered into one
task and a long one takes few rounds. Sorting
by (level, turn, call_id) is a topological order. Arguments are checked against the
tool's schema (type, required, properties, additionalProperties, enum, minimum, maximum,
minLength, maxLength, items) and written as canonical JSON: keys by code point, no blanks,
whole floats as integers, no escapes but those JSON asks for.

Defined results: messages that are no such JSON, or null, hold no call and no result; a
call with a null conversation or identifier links with nothing and is a row of its own,
unanswered, as is such a result, unasked; of calls (or
results) that repeat an identifier the first by turn, then by text, is linked, the count
is kept in `n_calls` and `n_results`; a dependency on an unknown call is named as a problem
and not waited for; calls on or behind a cycle have no level; arguments nested deeper than
DEPTH are no JSON here; texts are read whole; empty tables give no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.session import written_once

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"
TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}


#: levels of containers that arguments may have
DEPTH = 500


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _plain(value):
    """Whole floats as integers, so that 1.0 and 1 are one spelling."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def too_deep(value, most: int = DEPTH) -> bool:
    """Whether containers are nested deeper than `most`; by levels, not by recursion."""
    level = [value]
    for _ in range(most):
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return False
    return True


def problems_of(value, schema: dict, at: str = "$") -> list[str]:
    """What of `value` the schema does not allow, each with its place."""
    kind = schema.get("type")
    if kind is not None:
        fits = isinstance(value, TYPES[kind]) and (kind in ("boolean",) or not isinstance(value, bool))
        if kind == "integer" and isinstance(value, float) and value.is_integer():
            fits = True
        if not fits:
            return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems_of(v, schema["items"], f"{at}[{i}]")
    return out


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    """(canonical arguments, problems) of one call; no arguments count as an empty object."""
    try:
        value = json.loads(arguments or "{}", object_pairs_hook=_unique, parse_constant=_no_constant)
        if too_deep(value):
            raise RecursionError
        spelled = canonical(value)
        spelled.encode()
    except (ValueError, RecursionError) as error:
        return None, [f"$: not JSON ({type(error).__name__})"]
    if name not in schemas:
        return spelled, ["$: unknown tool"]
    return spelled, problems_of(value, schemas[name])


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """(calls, results) held by the messages."""
    own = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    calls = (
        own.where("role = 'assistant' and text like '{%'")
        .select("conv_id", "turn", F.explode(F.from_json("text", CALLS)["tool_calls"]).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    )
    # a result may hold nulls under its keys
    has_key = F.arrays_overlap(F.json_object_keys("text"), F.array(F.lit("tool_call_id"), F.lit("content")))
    results = (
        own.where("role = 'tool' and text like '{%'")
        .select("conv_id", "turn", F.from_json("text", RESULT).alias("r"), has_key.alias("has_key"))
        .where("r.tool_call_id is not null or r.content is not null or has_key")
        .select("conv_id", F.col("turn").alias("result_turn"), F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    )
    return calls, results


def _known(frame: DataFrame, name: str) -> DataFrame:
    """(d_conv, d_id, ...) of a frame keyed by conv_id, call_id, to be joined by a dependency."""
    return frame.withColumnsRenamed({"conv_id": "d_conv", "call_id": name})


def _chains(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, far): where the chain of single dependencies above a call ends.

    Pointers double, so a chain of n calls takes log n rounds. A round in which no
    pointer arrives leaves only calls on or behind a cycle; those are left out.
    """
    heads = _known(single.select("conv_id", "call_id"), "d_id").withColumn("more", F.lit(True))
    at = (F.col("conv_id") == F.col("d_conv")) & (F.col("to") == F.col("d_id"))
    pointers = single.join(heads, at, "left").select(
        "conv_id", "call_id", "to", F.lit(1).alias("far"), F.coalesce("more", F.lit(False)).alias("more")
    )
    pointers = written_once(pointers, "call-pointers")
    left = pointers.where("more").count()
    while left:
        next_ = _known(pointers, "d_id").withColumnsRenamed({"to": "n_to", "far": "n_far", "more": "n_more"})
        moved = pointers.where("more").join(next_, at).select(
            "conv_id", "call_id", F.col("n_to").alias("to"), (F.col("far") + F.col("n_far")).alias("far"), F.col("n_more").alias("more")
        )
        pointers = written_once(pointers.where("not more").unionByName(moved), "call-pointers")
        before, left = left, pointers.where("more").count()
        if left == before:
            break
    return pointers.where("not more").drop("more")


def levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, unknown): the level of every call that can be placed, and dependencies on no call.

    Chains of calls with one dependency are cut to a pointer at their end first. Then
    rounds place the calls with several, each once all its dependencies are placed, so
    rounds count the calls with several on a path, not the path.
    """
    named = calls.where("conv_id is not null and call_id is not null")
    wanted = named.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("dep"))
    known = _known(calls.select("conv_id", "call_id"), "d_id")
    same = (F.col("conv_id") == F.col("d_conv")) & (F.col("dep") == F.col("d_id"))
    unknown = wanted.join(known, same, "left_anti")
    edges = written_once(wanted.join(known, same, "left_semi"), "call-edges")
    counted = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("to"))
    counted = written_once(counted, "call-degrees")
    chains = _chains(counted.where("n = 1").select("conv_id", "call_id", "to"))
    # what a call with several dependencies waits for: the end of each dependency's chain
    several = edges.join(counted.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    one = _known(counted.where("n = 1").select("conv_id", "call_id"), "d_id").withColumn("single", F.lit(True))
    ends = _known(chains, "e_id").withColumnRenamed("d_conv", "e_conv")
    several = several.join(one, same, "left").join(
        ends, (F.col("conv_id") == F.col("e_conv")) & (F.col("dep") == F.col("e_id")), "left"
    )
    opened = several.select(
        "conv_id", "call_id",
        F.when(F.col("single").isNull(), F.col("dep")).otherwise(F.col("to")).alias("dep"),
        F.coalesce("far", F.lit(0)).alias("far"), F.lit(-1).alias("high"), F.lit(False).alias("met"),
    )  # fmt: skip  # a chain that ends in a cycle has no end: dep is null and never met
    opened = written_once(opened, "call-open")
    placed = fresh = named.select("conv_id", "call_id").join(counted, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    placed = fresh = written_once(placed, "call-levels")
    while not opened.isEmpty():
        told = _known(fresh, "d_id").withColumnRenamed("level", "d_level")
        met = opened.join(told, same, "left").select(
            "conv_id", "call_id", "dep", "far",
            F.greatest("high", F.coalesce(F.col("d_level") + F.col("far"), F.lit(-1))).alias("high"),
            (F.col("met") | F.col("d_level").isNotNull()).alias("met"),
        )
        met = written_once(met, "call-open")
        fresh = (
            met.groupBy("conv_id", "call_id")
            .agg(F.bool_and("met").alias("ready"), (F.max("high") + 1).alias("level"))
            .where("ready")
            .drop("ready")
        )
        fresh = written_once(fresh, "call-levels")
        if fresh.isEmpty():
            break  # what is open is on or behind a cycle
        placed = placed.unionByName(fresh)
        opened = met.join(fresh, ["conv_id", "call_id"], "left_anti")
    along = chains.join(
        _known(placed, "d_id"), (F.col("conv_id") == F.col("d_conv")) & (F.col("to") == F.col("d_id"))
    ).select("conv_id", "call_id", (F.col("level") + F.col("far")).alias("level"))
    return placed.unionByName(along), unknown


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row a call identifier, or a result without a call; calls and results without a key stay single.

    Columns: conv_id, call_id, turn, name, level, status (linked, unanswered, cycle,
    unasked), problems, n_calls, n_results, result_turn, line (canonical JSON of the call
    with its result).
    """
    first = F.struct("turn", "name", "arguments", "after")
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    called = calls.where(keyed).groupBy("conv_id", "call_id").agg(F.min(first).alias("c"), F.count("*").alias("n_calls"))
    called = written_once(called.select("conv_id", "call_id", "c.*", "n_calls"), "calls")
    told = results.where(keyed).groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id")).agg(
        F.min(F.struct("result_turn", "content")).alias("r"), F.count("*").alias("n_results")
    )
    placed, unknown = levels(called)
    lost = unknown.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("dep")).alias("lost"))
    joined = (
        called.join(placed, ["conv_id", "call_id"], "left")
        .join(lost, ["conv_id", "call_id"], "left")
        .join(told, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
    )
    rows = joined.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_id").alias("call_id"),
        "turn",
        "name",
        "level",
        F.when(F.col("n_calls").isNull(), "unasked")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked")
        .alias("status"),
        "arguments",
        F.coalesce("lost", F.array().cast("array<string>")).alias("lost"),
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.col("r.result_turn").alias("result_turn"),
        F.col("r.content").alias("content"),
    )

    # what has no key meets nothing: it goes through neither grouping nor join
    none = F.array().cast("array<string>")
    call = calls.where(~keyed).select(
        "conv_id", "call_id", "turn", "name", F.lit("unanswered").alias("status"), "arguments",
        none.alias("lost"), F.lit(1).cast("bigint").alias("n_calls"), F.lit(0).cast("bigint").alias("n_results"),
    )
    result = results.where(~keyed).select(
        "conv_id", "call_id", F.lit("unasked").alias("status"), none.alias("lost"), F.lit(0).cast("bigint").alias("n_calls"),
        F.lit(1).cast("bigint").alias("n_results"), "result_turn", "content",
    )
    rows = rows.unionByName(call, True).unionByName(result, True)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "call_id", "turn", "name", "level", "status", "n_calls", "n_results", "result_turn"]
        for batch in batches:
            problems, lines = [], []
            for name, arguments, status, lost, key, content in zip(
                *(batch.column(c).to_pylist() for c in ("name", "arguments", "status", "lost", "call_id", "content"))
            ):
                found: list[str] = [f"after {d}: unknown call" for d in lost]
                spelled = None
                if status != "unasked":
                    spelled, wrong = checked(name, arguments, schemas)
                    found += wrong
                problems.append("; ".join(found))
                # put together as text: nested in two levels more, arguments might be too deep to write
                call = f'{{"arguments":{spelled or "null"},"id":{canonical(key)},"name":{canonical(name)}}}'
                lines.append(f'{{"call":{"null" if status == "unasked" else call},"result":{canonical(content)}}}')
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(problems, pa.string()), pa.array(lines, pa.string())], [*names, "problems", "line"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = ["conv_id", "call_id", "turn", "name", "level", "status", "n_calls", "n_results", "result_turn"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", problems string, line string"
    return rows.mapInArrow(spell, schema)


# ---- the query's view of plain conversations ----------------------------------------

SCHEMAS = {
    "answer": {
        "type": "object",
        "required": ["question", "turn"],
        "additionalProperties": False,
        "properties": {
            "question": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
            "words": {"type": "integer", "minimum": 1},
        },
    }
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain turns as tool messages: a user's turn calls `answer`, the next assistant's turn is its result.

    A call waits for the call two turns before it; texts are carried whole.
    """
    def name(t):
        """None without a turn: calls of unknown turns are not one call."""
        return F.when(t.isNotNull(), F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), t.cast("string")))

    turn = F.col("turn")
    question = F.to_json(
        F.struct(F.col("text").alias("question"), turn.alias("turn"), F.size(F.split("text", r"\s+")).alias("words"))
    )
    call = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    name(turn).alias("id"),
                    F.lit("answer").alias("name"),
                    question.alias("arguments"),
                    F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
                )
            ).alias("tool_calls")
        )
    )
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    asked = conversations.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    told = conversations.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text"))
    return asked.unionByName(told)
