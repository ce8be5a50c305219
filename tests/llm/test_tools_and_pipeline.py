"""Tool-call linking, and the pipeline against plain Python."""

from __future__ import annotations

import json

import corpus_pipeline
from llm import brute
from scriptorium.llm import queries, tool_calls


def call(key, name="f", arguments="{}", after=()):
    return {"id": key, "name": name, "arguments": arguments, "after": list(after)}


def message(conv, turn, *calls):
    return (conv, turn, "assistant", json.dumps({"tool_calls": list(calls)}))


def answer(conv, turn, key, content="ok"):
    return (conv, turn, "tool", json.dumps({"tool_call_id": key, "content": content}))


SCHEMA = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}


def test_linking_order_and_checks(spark):
    rows = [
        message(1, 0, call("x", arguments='{"a": 1.0}'), call("y", arguments='{"b":2, "a":0}', after=["x", "gone"])),
        answer(1, 1, "x", "first"), answer(1, 2, "x", "second"), answer(1, 3, "lone"),
        message(1, 4, call("z", name="g", arguments='{"é": [1, 2.5], "A": "\\u0041\\n"}', after=["y", "x"])),
        message(1, 5, call("x", arguments='{"a": 9}')),
        message(2, 0, call("p", arguments="no", after=["q"]), call("q", arguments='{"a":1,"a":2}', after=["p"]), call("r", after=["q"])),
        message(2, 1, call("s", arguments='{"a": NaN}'), call(None)),
        (3, 0, "assistant", "plain"), (3, 1, "assistant", None), (None, 0, "tool", "{}"), (3, 2, "user", '{"tool_calls": []}'),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(*tool_calls.parse(frame), SCHEMA).collect()}
    x, y, z = out[1, "x"], out[1, "y"], out[1, "z"]
    assert (x.level, x.status, x.n_calls, x.n_results, x.result_turn, x.problems) == (0, "linked", 2, 2, 1, "")
    assert x.line == '{"call":{"arguments":{"a":1},"id":"x","name":"f"},"result":"first"}'
    assert (y.level, y.status) == (1, "unanswered")
    assert y.problems == "after gone: unknown call; $.a: below minimum; $.b: not allowed"
    assert z.level == 2 and z.problems == "$: unknown tool"
    assert z.line == '{"call":{"arguments":{"A":"A\\n","é":[1,2.5]},"id":"z","name":"g"},"result":null}'
    assert (out[1, "lone"].status, out[1, "lone"].line) == ("unasked", '{"call":null,"result":"ok"}')
    assert {k[1]: r.status for k, r in out.items() if k[0] == 2} == {"p": "cycle", "q": "cycle", "r": "cycle", "s": "unanswered", None: "unanswered"}
    assert all("not JSON" in out[2, k].problems for k in "pqs")
    empty = frame.limit(0)
    assert tool_calls.link_tool_calls(*tool_calls.parse(empty), SCHEMA).isEmpty()


def test_deep_arguments_and_clashing_columns(spark):
    deep = lambda n: '{"a":' + "[" * n + "]" * n + "}"
    depths = [1, tool_calls.DEPTH - 1, tool_calls.DEPTH, 900, 990, 995, 997, 999, 5000, 200_000]
    rows = [(*message(1, k, call(str(n), arguments=deep(n))), "clash") for k, n in enumerate(depths)]
    rows.append((*message(1, 99, call("long", arguments=json.dumps({"a": "x" * 2_000_000}))), "clash"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level string")
    for name in ("call_id", "status", "line", "problems", "r_conv"):
        frame = frame.withColumn(name, frame["level"])
    out = {r.call_id: r for r in tool_calls.link_tool_calls(*tool_calls.parse(frame), {}).collect()}
    for n in depths:
        fits = n + 1 <= tool_calls.DEPTH
        assert out[str(n)].problems.startswith("$: unknown tool" if fits else "$: not JSON")
        assert (f'"arguments":{deep(n)},' if fits else '"arguments":null,') in out[str(n)].line
    assert len(out["long"].line) > 2_000_000 and len(out) == len(rows)


def test_calls_and_results_without_a_key_stay_single(spark):
    rows = [
        message(1, 0, call(None, arguments='{"a": 1}'), call(None, arguments='{"a": 2}'), call("x", arguments='{"a": 3}')),
        message(None, 0, call("x", arguments='{"a": 4}')), message(None, 0, call("x", arguments='{"a": 5}'), call(None, arguments="no")),
        answer(1, 1, None, "r1"), answer(1, 1, None, "r2"), answer(1, 1, "x", "r3"), answer(1, 2, None, None),
        answer(None, 1, "x", "r4"), answer(None, 1, "x", "r5"), answer(None, 1, None, "r5"), (1, 3, "tool", "{}"), (1, 3, "tool", "{no"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = tool_calls.link_tool_calls(*tool_calls.parse(frame), SCHEMA).collect()
    lines = [(r.status, (json.loads(r.line)["call"] or {}).get("arguments"), json.loads(r.line)["result"]) for r in out]
    assert sorted(lines, key=str) == sorted([
        ("linked", {"a": 3}, "r3"),
        *(("unanswered", {"a": i}, None) for i in (1, 2, 4, 5)), ("unanswered", None, None),
        *(("unasked", None, x) for x in ("r1", "r2", "r4", "r5", "r5", None)),
    ], key=str)
    assert all(r.n_calls + r.n_results == 1 and r.level is None for r in out if r.status != "linked")


def test_turns_without_a_conversation_or_number_stay_single(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (4, None, "user", "c"), (4, None, "user", "d"),
            (4, 0, "user", "e"), (4, 1, "assistant", "f"), (None, 1, "assistant", "g"), (None, 1, "assistant", "h"), (4, None, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = tool_calls.link_tool_calls(*tool_calls.parse(tool_calls.as_tool_messages(turns)), tool_calls.SCHEMAS).collect()
    lines = [json.loads(r.line) for r in out]
    asked = {(x["call"] or {"arguments": {}})["arguments"].get("question"): x["result"] for x in lines if x["call"]}
    assert asked == {"a": None, "b": None, "c": None, "d": None, "e": "f"}
    assert sorted(str(x["result"]) for x in lines if not x["call"]) == ["None", "g", "h"] and len(out) == 8


def test_a_long_chain_is_placed(spark):
    rows = [message(1, i, call(f"c{i}", arguments='{"a":1}', after=[f"c{i - 1}"] if i else [])) for i in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = tool_calls.link_tool_calls(*tool_calls.parse(frame), SCHEMA).collect()
    assert sorted(r.level for r in out) == list(range(12)) and all(r.level == r.turn for r in out)


def test_levels_of_a_mixed_graph(spark):
    """Chains, joins of chains, and calls behind cycles, against a plain longest path."""
    after = {f"a{i}": [f"a{i - 1}"] if i else [] for i in range(40)}
    after |= {"j1": ["a3", "a20"], "k1": ["j1"], "k2": ["k1"], "j2": ["k2", "a39", "j1"], "z": ["j2"]}
    after |= {"c1": ["c2"], "c2": ["c3"], "c3": ["c1"], "d1": ["c1"], "d2": ["d1", "a0"], "d3": ["d2"], "s": ["s"]}
    rows = [message(7, i, call(k, arguments='{"a":1}', after=a)) for i, (k, a) in enumerate(after.items())]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.level for r in tool_calls.link_tool_calls(*tool_calls.parse(frame), SCHEMA).collect()}

    def level(k):
        return max((level(d) + 1 for d in after[k]), default=0)

    bad = {"c1", "c2", "c3", "d1", "d2", "d3", "s"}
    assert got == {k: None if k in bad else level(k) for k in after}


def test_every_turn_of_the_table_is_linked(spark, sf):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    out = queries.op1_tool_calls(spark, sf).collect()
    asked = {k: r for k, r in turns.items() if r.role == "user"}
    assert len([r for r in out if r.status != "unasked"]) == len(asked)
    for r in out:
        reply = turns.get((r.conv_id, (r.turn or 0) + 1))
        line = json.loads(r.line)
        assert line["call"]["arguments"]["question"] == asked[r.conv_id, r.turn].text
        assert line["result"] == (reply.text if reply and reply.role == "assistant" else None)
        assert r.problems == "" and r.level == sum(t < r.turn and c == r.conv_id for c, t in asked)


def test_pipeline_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.written_once(stage(spark, tables[-1], sf), "test"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    before, quality, single, clean, private = ({r.doc_id: r for r in t.collect()} for t in tables[:-1])
    for i, r in before.items():
        w = brute.words(r.text)
        if len(w) < 20 or 100 * brute.repeated_words(w) > 30 * len(w):
            assert i not in quality
    named = brute.components([(i, r.text) for i, r in quality.items()])
    assert set(single) == {i for i, c in named.items() if i == c}
    items = [" ".join(x.decode() for x in brute.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, r in single.items():
        text = " ".join(x.decode() for x in brute.words(r.text))
        if any(f" {item} " in f" {text} " for item in items):
            assert i not in clean
    assert set(clean) == set(private)
    for i, r in private.items():
        assert not brute.personal(r.text) and r.n_chars == len(r.text)
        if not any(c.isdigit() or c == "@" for c in clean[i].text):
            assert r == clean[i]
    mix = tables[-1].collect()
    assert {r.doc_id for r in mix} == set(private)
    assert all(r.size == len(brute.words(private[r.doc_id].text)) and r.taken <= 2 * r.size for r in mix)


def test_pipeline_edges(spark, edge, none, tmp_path):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count()
