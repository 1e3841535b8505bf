import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.registered import register
from millrace.operators.parsing import lenient_object, parse_turn, parsed
from millrace.sources.jsonl import fingerprint, read_cache, read_jsonl, todo, unknown_keys, write_sorted
from millrace.sources.worlds import entities, walk


@pytest.mark.parametrize("text,name,args,strict", [
    ('<tool_call>{"name": "search", "arguments": {"query": "x"}}</tool_call>', "search", {"query": "x"}, True), ('<tool_call>{"name": "search", "arguments": {"query": "x",},}</tool_call>', "search", {"query": "x"}, False),
    ("<tool_call>{'tool': 'search', 'args': {'k': True}}</tool_call>", "search", {"k": True}, False), ('<tool_call>{name: "search", arguments: {query: "x"}}</tool_call>', "search", {"query": "x"}, False),
    ('<tool_call>{"name": "search", "arguments": {"query": "x"', "search", {"query": "x"}, False), ('```json\n{"name": "search", "parameters": {"query": "x"}}\n```', "search", {"query": "x"}, False),
    ('<tool_call>search(query="x", top_k=3)</tool_call>', "search", {"query": "x", "top_k": 3}, False), ('<tool_call>{"function": {"name": "search", "arguments": "{\\"query\\": \\"x\\"}"}}</tool_call>', "search", {"query": "x"}, False),
])
def test_calls(text, name, args, strict):
    t = parse_turn(text)
    assert [(c["name"], json.loads(c["arguments"])) for c in t["calls"]] == [(name, args)] and t["strict"] is strict


def test_turns(spark):
    assert parse_turn("<think>a</think><final_answer>b</final_answer>") == {"thinking": "a", "final_answer": "b", "calls": [], "errors": [], "strict": True}
    assert parse_turn("plain")["errors"] == ["untagged_final_answer"] and parse_turn(None)["errors"] == ["empty_turn"]
    assert parse_turn("<tool_call>nothing</tool_call>")["errors"] == ["malformed_tool_call"]
    assert parse_turn("<final_answer>b")["errors"] == ["unterminated_final_answer"]
    assert lenient_object("no object") == (None, [])
    df = spark.createDataFrame([("<final_answer>b</final_answer>",), (None,)], "t string").select(parsed(F.col("t")).alias("x"))
    assert [r["x"]["strict"] for r in df.collect()] == [True, False]


def test_jsonl(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('{"header": 1}\n{"id": "a", "v": 1}\n\n{"id": "b", "v": 2}\n{"id": "a", "v": 3}\n{"id": "c", "v')
    got = {r["key"]: json.loads(r["record"])["v"] for r in read_cache(spark, str(f), "id").collect()}
    assert got == {"a": 3, "b": 2}
    f.write_text('{"id": "a", "v\n{"id": "b", "v": 2}\n')
    with pytest.raises(Exception, match="broken line"):
        read_cache(spark, str(f), "id").collect()
    jobs = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r["id"] for r in todo(jobs, spark.createDataFrame([("a", "x")], "key string, record string"), "id").collect()] == ["z"]
    t = tmp_path / "t.jsonl"
    t.write_text('{"task_id": "1", "seed": 5}\n\n{"task_id": "2", "extra": 1}\n')
    df = read_jsonl(spark, str(t))
    assert df.count() == 2 and [r["key"] for r in unknown_keys(spark, str(t), df.schema).collect()] == ["extra"]
    write_sorted(df.select("task_id", "seed"), str(tmp_path / "out"), "task_id")
    assert read_jsonl(spark, str(tmp_path / "out")).count() == 2
    assert fingerprint(df.repartition(3)).first() == fingerprint(df).first()


def test_world(spark):
    w = entities(spark, spark.range(30).withColumnRenamed("id", "seed"))
    per = w.groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names")).collect()
    assert {(r["n"], r["names"]) for r in per} == {(38, 38)}
    chains = walk(w, "work", ["author", "born_in", "country"])
    assert chains.count() == 90 and chains.filter(F.size(F.array_distinct("chain")) < F.size("chain")).count() == 0
    assert walk(w, "city", ["country", "capital"]).count() == 0  # a city and its country lead back to each other


def test_sql_functions(spark):
    assert "mr_norm_text" in register(spark)
    assert spark.sql("select mr_norm_text('A -- b') as x").first()["x"] == "a b"
