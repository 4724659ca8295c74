"""Ingestion state, transcripts and tool calls: edge rows."""

import json

from pyspark.sql import functions as F

from kestrel.operators import state as S


def test_gate_verdicts(spark):
    rows = [
        # the recorded status decides, not the number of rows in progress
        (1, "completed", "in_progress", 1), (1, "in_progress", "in_progress", 2),
        (2, "failed", "in_progress", 1), (2, "completed", "completed", 2),
        (3, "in_progress", "completed", 1),
        (4, "completed", "in_progress", 1), (4, "completed", "completed", 3), (4, "in_progress", "in_progress", 2),
        (5, "completed", None, 1),
    ]
    df = spark.createDataFrame(rows, "run long, state string, status string, t long")
    gate = S.ingest_gate(df, ["run"], "state", "status", ["t"])
    got = {r["run"]: (r["verdict"], r["completed"], r["failed"], r["in_progress"]) for r in gate.collect()}
    assert got == {1: ("processing", 1, 0, 1), 2: ("error_failed", 1, 1, 0), 3: ("error_empty", 0, 0, 1), 4: ("ready", 2, 0, 1), 5: ("processing", 1, 0, 0)}


def test_combined_hash_is_both_hashes_in_plain_text(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    a, b = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", "3e23e8160039594a33894f6564e1b1348bbd7a0088d42c4acb73eeaed59c009d"
    assert [r["h"] for r in df.select(S.content_hash(F.col("x"), F.col("y")).alias("h")).collect()] == [f"{a}:{b}", a]


def test_error_report_cap_and_remainder(spark):
    df = spark.createDataFrame([(r, i, f"m{i}") for r, n in ((1, 25), (2, 3)) for i in range(n)], "run long, eid long, msg string")
    out = S.ingest_error_report(df, "run", "eid", ["msg"], max_items=20).collect()
    by_run = {}
    for r in out:
        by_run.setdefault(r["run"], []).append(r)
    assert len(by_run[1]) == 20 and {r["n_more"] for r in by_run[1]} == {5}
    assert sorted(r["eid"] for r in by_run[1]) == list(range(20))
    assert len(by_run[2]) == 3 and {r["n_more"] for r in by_run[2]} == {0}


def test_latest_status_with_missing_keys(spark):
    recs = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 1), (1, "c", 2, 0), (2, "x", 5, 5)], "g long, status string, ts long, id long")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = {r["k"]: r["status"] for r in S.latest_status(recs, "g", "status", ["ts", "id"], keys, "k").collect()}
    assert got == {1: "b", 2: "x", 3: "NotFound"}


def test_content_hash_change(spark):
    cur = spark.createDataFrame([(1, "AA"), (2, "bb"), (3, "cc")], "k long, hash string")
    prev = spark.createDataFrame([(1, "aa", 4), (2, "zz", 2)], "k long, hash string, version int")
    got = {r["k"]: (r["action"], r["version"]) for r in S.content_hash_change(cur, prev, "k").collect()}
    assert got == {1: ("skip", 4), 2: ("update", 3), 3: ("new", 1)}


def test_transcript_edges(spark):
    schema = "conv long, turn long, role string, content array<struct<type:string, text:string>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "a"), ("text", "b")]), (1, 1, "assistant", []), (1, 2, "user", [("text", "q"), ("image", None)])], schema)
    got = [(r["turn"], r["line"]) for r in S.transcript(df, "conv", "turn", "role", "content").orderBy("turn").collect()]
    assert got == [(0, "user: b")]


def test_pending_calls_edges(spark):
    from kestrel.streaming import events as E

    rows = [
        ("response.output_item.done", 1, "in1", ("function_call", "c1", "search_knowledge_base", '{"query": "q1"}')),
        ("response.output_item.done", 2, "in2", ("function_call", "c2", "search_knowledge_base", "")),
        ("response.output_item.done", 3, "in3", ("function_call", "c3", "search_knowledge_base", '{"other": 1}')),
        ("response.output_item.done", 4, "in4", ("function_call", "c4", "web_search", "{}")),
        ("response.output_item.done", 5, "in5", ("message", None, None, None)),
        ("response.output_text.delta", 6, "in6", None),
        ("response.output_item.done", 7, "in7", ("function_call", "c7", "search_knowledge_base", '{"query": nul')),
        ("response.output_item.done", 8, "in8", ("function_call", "c8", "search_knowledge_base", '{"query": null}')),
        ("response.output_item.done", 9, "in9", ("function_call", "c9", "search_knowledge_base", "[1]")),
    ]
    df = spark.createDataFrame(rows, "type string, response_id long, user_input string, item struct<type:string, call_id:string, name:string, arguments:string>")
    got = {r["call_id"]: (r["query"], r["error"]) for r in E.pending_calls(df).collect()}
    assert got == {"c1": ("q1", None), "c2": ("in2", None), "c3": ("in3", None), "c4": (None, json.dumps({"error": "unknown tool web_search"}, separators=(",", ":"))),
                   "c7": (None, '{"error":"arguments are not a JSON object"}'), "c8": (None, None), "c9": (None, '{"error":"arguments are not a JSON object"}')}
    assert {r["call_id"]: r["arguments"] for r in E.pending_calls(df).collect()}["c7"] == '{"query": nul'


def test_nested_dedupe_first_wins(spark):
    schema = "res long, items array<struct<nic:long, ip:long, f:array<string>>>"
    df = spark.createDataFrame([(2, [(1, 1, ["b"])]), (1, [(1, 1, ["a", "c"]), (2, 2, ["d"])]), (1, [(1, 1, ["a", "b"])])], schema)
    got = {(r["nic"], r["ip"]): (r["res"], r["f"]) for r in S.nested_dedupe_flatten(df, "res", ["items"], ("nic", "ip"), ["res"], "f").collect()}
    assert got == {(1, 1): (1, "a,b"), (2, 2): (1, "d")}  # tie on the resource key broken by the list


def test_nested_levels_with_several_items_each(spark):
    schema = "res string, connections array<struct<conn:long, nics:array<struct<nic:long, configs:array<struct<ip:string, f:array<string>>>>>>>"
    df = spark.createDataFrame(
        [
            ("a", [(1, [(10, [("x", ["f1", "f2"]), ("y", [])]), (11, [])]), (2, [(10, [("x", ["other"])])]), (3, None)]),
            ("b", [(1, [(10, [("y", ["late"])]), (12, [("z", ["f3"])])])]),
            ("c", []),
        ],
        schema,
    )
    out = S.nested_dedupe_flatten(df, "res", ["connections", "nics", "configs"], ("nic", "ip"), ["res", "conn"], "f")
    got = {(r["nic"], r["ip"]): (r["res"], r["conn"], r["f"]) for r in out.collect()}
    assert got == {(10, "x"): ("a", 1, "f1,f2"), (10, "y"): ("a", 1, ""), (12, "z"): ("b", 1, "f3")}
