"""Rounds of tool calls, JSON with unknown keys, and element-wise means."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import openjson as O
from tessera.operators import toolcalls as TC
from tessera.operators import toolloop as L
from tessera.operators import vectors as V


def call(name, arguments):
    return f'<tool_call>{{"name": "{name}", "arguments": {arguments}}}</tool_call>'


def model(rows):
    """Plays the outputs that a conversation's first line names, one for each round."""
    played = F.split(F.get(F.split("text", "\n"), F.lit(0)), r"\|")
    n = F.size(F.regexp_extract_all("text", F.lit("<tool_result"), F.lit(0)))
    return rows.withColumn("output", F.nullif(F.get(played, n), F.lit("null")))


@pytest.fixture
def tools(spark):
    return spark.createDataFrame([("find", '{"q":1}', "one"), ("find", '{"q":2}', "two"), ("list", "{}", "all")], "name string, arguments string, result string")


def test_rounds_of_calls(spark, tools):
    f1, f2, lst, bad, unknown, other = call("find", '{"q":1}'), call("find", '{"q":2}'), '<tool_call>{"name": "list"}</tool_call>', "<tool_call>{'name': 1</tool_call>", call("none", "{}"), call("find", '{"q":9}')
    plays = {1: "answer", 2: f"{f1}|{f2}|done", 3: f"{lst}|end", 4: bad, 5: f"{unknown}|{other}|over", 6: "|".join([f1] * 20), 7: "null", 8: f"{call('find', 2)}|x", 9: "|".join([f1] * 3 + ["late"])}
    rows = {r["id"]: r for r in L.converse(spark.createDataFrame(list(plays.items()), "id int, script string").withColumn("script", F.concat("script", F.lit("\n"))), "id", "script", model, L.lookup(tools), max_calls=3).collect()}
    assert {k: (r["calls"], r["answered"]) for k, r in rows.items()} == {1: (0, True), 2: (2, True), 3: (1, True), 4: (0, True), 5: (2, True), 6: (3, False), 7: (0, True), 8: (1, True), 9: (3, True)}
    assert rows[2]["output"] == "done" and rows[7]["output"] == "" and rows[6]["output"] == f1 and rows[9]["output"] == "late"
    assert rows[2]["text"].count("<tool_result id='call_") == 2 and ">one</tool_result>" in rows[2]["text"] and rows[2]["text"].endswith(">two</tool_result>")
    assert ">all</tool_result>" in rows[3]["text"] and "Error: Tool 'none' not found" in rows[5]["text"] and 'no result for {"q":9}' in rows[5]["text"]
    assert L.converse(spark.createDataFrame([], "id int, script string").withColumn("script", F.concat("script", F.lit("\n"))), "id", "script", model, L.lookup(tools)).count() == 0
    assert {r["id"]: r["calls"] for r in L.converse(spark.createDataFrame([(6, plays[6])], "id int, script string").withColumn("script", F.concat("script", F.lit("\n"))), "id", "script", model, L.lookup(tools)).collect()} == {6: 10}


def test_rounds_are_taken_up_again(spark, tools, tmp_path):
    items = spark.createDataFrame([(k, "|".join([call("find", '{"q":1}')] * k + ["end"])) for k in range(5)], "id int, script string").withColumn("script", F.concat("script", F.lit("\n")))
    want = sorted(map(tuple, L.converse(items, "id", "script", model, L.lookup(tools)).collect()))
    asked = []

    def dies(rows):
        asked.append(1)
        if len(asked) == 3:
            raise RuntimeError("lost")
        return model(rows)

    with pytest.raises(RuntimeError):
        L.converse(items, "id", "script", dies, L.lookup(tools), folder=str(tmp_path / "r"))
    (tmp_path / "r" / "round-2").mkdir()  # a round that began and did not end
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "r" / "round-1").iterdir()}
    assert sorted(map(tuple, L.converse(items, "id", "script", model, L.lookup(tools), folder=str(tmp_path / "r")).collect())) == want
    assert len(asked) == 3
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "r" / "round-1").iterdir()} == files, "a finished round is read, not made again"


def test_rounds_are_made_by_all_tasks(spark, tools, tmp_path):
    items = spark.range(200).selectExpr("id", """concat('<tool_call>{"name": "list"}</tool_call>|end', chr(10)) AS script""").coalesce(1)
    out = L.converse(items, "id", "script", model, L.lookup(tools), folder=str(tmp_path / "r")).collect()
    assert len(out) == 200 and all(r["calls"] == 1 and r["output"] == "end" for r in out)
    for number in range(2):
        assert len(list((tmp_path / "r" / f"round-{number}").glob("*.parquet"))) == 4


def test_popular_calls_are_not_shuffled(spark):
    tools = spark.range(20_000).selectExpr("'get' AS name", "concat('{\"q\":', id, '}') AS arguments", "concat('r', id) AS result")
    calls = spark.range(1000).selectExpr("id", "CASE WHEN id = 0 THEN NULL WHEN id = 1 THEN 'put' ELSE 'get' END AS name", "CASE WHEN id = 2 THEN '{}' ELSE '{\"q\":7}' END AS arguments")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        done = L.lookup(tools)(calls)
        plan = done._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["result"] for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert done.columns == ["id", "name", "arguments", "result"] and len(got) == 1000
    assert got == {0: "Error: Tool 'None' not found", 1: "Error: Tool 'put' not found", 2: "Error executing tool: no result for {}"} | {k: "r7" for k in range(3, 1000)}


def test_entries_of_objects(spark):
    texts = ['{"b": 1, "a": {"x": [1, null]}, "": "e", "a.b": null}', "[1]", "7", "null", "{", None, "{}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, j string")
    got = {r["id"]: None if r["e"] is None else [(x["key"], x["value"].toJson()) for x in r["e"]] for r in rows.select("id", O.entries(F.col("j")).alias("e")).collect()}
    assert got[0] == [("b", "1"), ("a", '{"x":[1,null]}'), ("", '"e"'), ("a.b", "null")] and got[6] == []
    assert all(not got[k] for k in (1, 2, 3, 4, 5))
    kinds = {(r["id"], r["key"]): r["kind"] for r in O.exploded(rows, "j", "id").select("id", "key", "kind").collect()}
    assert set(kinds) == {(0, "a"), (0, "b"), (0, ""), (0, "a.b")} and kinds[0, "b"] == "BIGINT" and kinds[0, "a"].startswith("OBJECT")


def test_prompts_from_schemas(spark):
    one = {"type": "function", "function": {"name": "find", "description": "Finds things", "parameters": {"type": "object", "properties": {"z key": {"type": "string", "description": "a \"quoted\" one"}, "a": {"type": "integer"}}, "required": ["a", "x"]}}}
    two = {"function": {"name": "now", "description": "The time"}}
    three = {"function": {"name": "none", "parameters": {"type": "object", "properties": {}}}}
    rows = spark.createDataFrame([(3, json.dumps(three)), (1, json.dumps(one)), (2, json.dumps(two)), (4, "not json"), (5, None)], "k int, s string")
    want = "- find: Finds things\n  Parameters:\n    - z key: a \"quoted\" one (optional)\n    - a:  (required)\n\n"
    got = {r["k"]: r["x"] for r in rows.select("k", TC.described(F.col("s")).alias("x")).collect()}
    assert got == {1: want, 2: "- now: The time\n\n", 3: "- none: \n  Parameters:\n\n", 4: None, 5: None}
    text = TC.prompt_of(rows, "s", "k").first()["text"]
    assert text == TC.INTRODUCED + want + "- now: The time\n\n- none: \n  Parameters:\n\n" + TC.EXPLAINED


@pytest.mark.parametrize("width", [1, 5, 64, 65, 130])
def test_means_of_vectors(spark, width):
    rng = random.Random(width)
    value = lambda: rng.choice([None, float("nan"), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)])
    rows = [(k % 3, k % 2, k % 5 if k % 7 else None, [value() for _ in range(width if k % 4 else rng.randint(0, width))] if k % 11 else None) for k in range(200)]
    axes = [["a", "b"], ["c"], []]
    got = V.axis_means(spark.createDataFrame(rows, "a int, b int, c int, w array<double>").repartition(5), "w", width, axes, "a", "b", "c").collect()

    def table(own):
        x = np.full((max(1, len(own)), width), np.nan)
        for i, w in enumerate(own):
            if w:
                x[i, : len(w)] = [math.nan if v is None else v for v in w]
        return x

    want = {}
    for a, b, c, w in rows:
        for level, key in ((1, (a, b, None)), (6, (None, None, c)), (7, (None, None, None))):
            want.setdefault((level, *key), []).append(w)
    assert {(r["level"], r["a"], r["b"], r["c"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        x = table(want[r["level"], r["a"], r["b"], r["c"]])
        n = (~np.isnan(x)).sum(axis=0)
        assert len(r["means"]) == width
        for k in range(width):
            assert (r["means"][k] is None) == (n[k] == 0) and (n[k] == 0 or r["means"][k] == pytest.approx(np.nanmean(x[:, k])))
        assert r["mean"] == pytest.approx(np.nansum(x) / n.sum()) if n.sum() else r["mean"] is None
