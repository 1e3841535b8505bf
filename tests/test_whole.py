"""Ranking, verification, chains, sinks and texts on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.chains import plain_latin, resolve
from millrace.operators.retrieval import search
from millrace.operators.rewards import centred_mad
from millrace.operators.verify import verify
from millrace.plans.chains import is_name
from millrace.plans.reasoning import as_subquestion, erf, facts_present, fold, rewritten, shorten, spans, surfaced
from millrace.plans.tools import argument_error, corrupted, fold_rank, registry_of
from millrace.sources import sinks
from millrace.streaming.events import last_five

PASSAGES = "world string, doc_id string, title string, text string"


def value(spark, col, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(col.alias("x")).first()["x"]


# Ranking
def test_near_ties_are_ranked_unrounded_and_top_k_is_each_query_s_own(spark):
    # Two passages whose scores agree to four places, the better one with the larger id.
    docs = [("w", "0", "", "mill " + "x " * 20000), ("w", "1", "", "mill " + "x " * 19999), ("w", "2", "", "barn"), ("w", "3", "", "mill mill")]
    p = spark.createDataFrame(docs, PASSAGES)
    q = spark.createDataFrame([("w", "a", "mill", 3), ("w", "b", "mill", 1), ("w", "c", "mill", None), ("w", "d", "mill", 0), ("w", "e", None, 3)], "world string, query_id string, query string, top_k int")
    got = {}
    for r in search(p, q, F.col("top_k")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    hits = sorted(got["a"])
    assert [h[1] for h in hits] == ["3", "1", "0"] and hits[1][2] == hits[2][2]  # by the rounded score 0 would stand before 1
    assert len(got["b"]) == 1 and len(got["c"]) == 3 and len(got["d"]) == 1 and "e" not in got
    assert [h[1] for h in hits] == fold_rank([d[1:] for d in docs], "mill", 3)
    assert search(p.limit(0), q).count() == 0 and search(p, q.limit(0)).count() == 0


# Verification
EPISODE = """task_id string, task_type string, gold struct<kind:string,value:string,tol:double>, required_tools array<string>, required_any array<array<string>>, forbidden_tools array<string>,
oracle_plan array<struct<name:string,arguments:struct<query:string,top_k:int>,expect_error:string>>, stop_reason string, final_answer string,
steps array<struct<parse_errors:array<string>,strict_format:boolean>>, call_log array<struct<name:string,args:string,ok:boolean,coerced:boolean,result:string>>,
expect_side_effect struct<to:string,must_contain:array<string>>, sent_messages array<struct<to:string,subject:string,body:string>>"""
HIT, NONE = '{"num_results": 1, "results": [1]}', '{"num_results": 0, "results": []}'


def episode(task_id, **x):
    base = dict(
        task_type="musique_2hop", gold=("text", '"Oslo"', None), required_tools=["search"], required_any=[], forbidden_tools=[], oracle_plan=[("search", ("Mill Town owner", 3), None), ("search", ("Ann Lee birthplace", 3), None)],
        stop_reason="answered", final_answer="Oslo", steps=[([], True)], call_log=[("search", '{"query": "mill town OWNER", "top_k": "3"}', True, True, HIT)], expect_side_effect=None, sent_messages=[],
    )
    return (task_id, *(base | x).values())


def test_failure_modes_in_order(spark):
    err = ("search", "{}", False, False, '{"error": "invalid_arguments"}')
    rows = [
        episode("ok"), episode("format", steps=[(["malformed_tool_call"], False)], final_answer=None), episode("ran_out_of_steps", stop_reason="max_steps", final_answer="x"), episode("empty_turn", stop_reason="empty_turn", final_answer="x"),
        episode("unnecessary_tool_use", task_type="no_tool", final_answer="x", required_tools=[]), episode("answered_without_tools", call_log=[], final_answer="x"), episode("forbidden_tool", forbidden_tools=["search"]),
        episode("missing_or_wrong_side_effect", expect_side_effect=("ann", ["mill"]), sent_messages=[("bob", "mill", "")]), episode("sent", expect_side_effect=("Ann", ["Mill"]), sent_messages=[("ann", "the", "old mill")]),
        episode("unrequested_side_effect", call_log=[("search", "{}", True, False, HIT), ("send", "{}", True, False, "{}")]), episode("missing_tool:count", required_tools=["count"], final_answer="x"), episode("bad_arguments", call_log=[err], final_answer="x"),
        episode("no_recovery", call_log=[("search", "{}", True, False, HIT), err], final_answer="x"), episode("no_final_answer", final_answer=None), episode("wrong_answer:text_mismatch", final_answer="x"),
    ]
    got = {r["task_id"]: r for r in verify(spark.createDataFrame(rows, EPISODE), side_effect_tools=("send",)).collect()}
    assert {k: r["failure_mode"] for k, r in got.items()} == {k: "" if k in ("ok", "sent") else k for k in got}
    assert got["ok"]["args_strict_frac"] == 0.5 and got["ok"]["arg_coercions"] == 1 and got["bad_arguments"]["error_kinds"] == ["invalid_arguments"]
    assert got["sent"]["side_effect_ok"] and got["ok"]["side_effect_ok"] is None and got["unrequested_side_effect"]["unrequested_side_effect"] == ["send"]


@pytest.mark.parametrize("queries,want", [
    (["Mill Town", "Ann Lee"], (True, 1.0, True)), (["other", "Mill Town"], (False, 0.5, True)), ([], (False, 0.0, False)), (["x", "y"], (False, 0.0, False)), (["Ann Lee", "Mill Town"], (False, 0.5, True)),
])
def test_hop_diagnostics(spark, queries, want):
    log = [("search", json.dumps({"query": q}), True, False, HIT) for q in queries]
    r = verify(spark.createDataFrame([episode("a", call_log=log)], EPISODE)).first()
    assert (r["anchor_ok"], r["progress_frac"], r["reformulate_ok"]) == want


def test_strict_match_refuses_untagged_and_many_numbers(spark):
    rows = [episode("tag", steps=[(["untagged_final_answer"], False)]), episode("shot", gold=("numeric", "5", None), final_answer="5 6 7"), episode("none", gold=("none", None, None), final_answer="no record", steps=[])]
    got = {r["task_id"]: r["answer_reason"] for r in verify(spark.createDataFrame(rows, EPISODE), strict_match=True).collect()}
    assert got == {"tag": "untagged_answer_strict", "shot": "shotgun_strict", "none": "ok"}
    assert verify(spark.createDataFrame([], EPISODE)).count() == 0


@pytest.mark.parametrize("query,name", [("Which Mill Town is in The Old Vale?", "which mill town"), ("is Mill Town in The Old Vale?", "the old vale"), ("Red Mill or Old Barn", "red mill"), ("Elm Row, Oak Row", "elm row"), ("who", ""), (None, ""), ("Ann saw Bob", "ann")])
def test_longest_name(spark, query, name):
    assert value(spark, T.longest_name(F.col("q")), q=query) == name


# Chains
TASK = "world string, prompt string, plan array<string>, support array<string>, gold string"


def test_chains_resolve_or_say_why_not(spark):
    docs = [("0", "Aldwick Mill", "Aldwick Mill was built by Hanna Brole in the old days."), ("1", "Hanna Brole", "The builder Hanna Brole was born in Vessel Bay."), ("2", "Noise", "Nothing is told of the weather.")]
    rows = [
        ("ok", "Where was the builder of Aldwick Mill born?", ["Aldwick Mill builder", "#1 born"], ["0", "1"], "Vessel Bay"), ("empty", "?", [], ["0"], "x"), ("null", None, None, None, None), ("long", "?", ["a"] * 6, [], "x"),
        ("open", "Aldwick Mill", ["Aldwick Mill builder", "#3 born"], ["0", "1"], "Vessel Bay"), ("stale", "Where was the builder of Aldwick Mill born?", ["Aldwick Mill builder", "Aldwick Mill again"], ["0"], "Vessel Bay"),
        ("leak", "Aldwick Mill and Hanna Brole", ["Hanna Brole born", "Aldwick Mill built"], ["0", "1"], "Vessel Bay"), ("never", "Aldwick Mill", ["Aldwick Mill builder"], ["0"], "Atlantis"), ("psychic", "Who built it?", ["Aldwick Mill builder"], ["0"], "Hanna Brole"),
    ]
    p = spark.createDataFrame([(w[0], *d) for w in rows for d in docs], PASSAGES)
    got = {r["world"]: r for r in resolve(spark.createDataFrame(rows, TASK), p, spans, is_name, top_k=1).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "ok": "", "empty": "empty_plan", "null": "empty_plan", "long": "too_long", "open": "unresolvable_placeholder_hop2", "stale": "no_new_evidence_hop2", "leak": "gold_leaks_at_hop1", "never": "gold_never_retrieved", "psychic": "psychic_first_query",
    }
    assert got["ok"]["queries"] == ["Aldwick Mill builder", "Hanna Brole born"] and got["ok"]["chain"] == ["", "Hanna Brole"] and got["ok"]["first_gold_hop"] == 2
    assert resolve(spark.createDataFrame([], TASK), p, spans, is_name).count() == 0


# Texts
def test_texts(spark):
    assert value(spark, shorten(F.col("a"), 19), a="One two. Three four. Five six seven.") == "One two."
    assert value(spark, shorten(F.col("a"), 8), a="Antarctica is cold.") == "Antarcti" and value(spark, shorten(F.col("a"), 8), a=None) == ""
    assert value(spark, fold(F.col("a")), a="Zürich ﬁn") == "Zurich fin" and value(spark, fold(F.col("a")), a=None) == ""
    assert value(spark, plain_latin(F.col("a")), a="Zürich Łódź") == "Zurich Łodz"
    assert value(spark, spans(F.col("a")), a="The Old Mill by Ann Lee, the old mill. Ann lee AN") == ["The Old Mill", "Ann Lee", "Ann"]
    assert value(spark, as_subquestion(F.col("a")), a=" who  ran it ") == "who ran it?"
    assert abs(value(spark, erf(F.col("a").cast("double")), a="0.5") - 0.5204999) < 2e-7


def test_rewriting_keeps_facts_or_falls_back(spark):
    df = spark.createDataFrame([("Aldwick has 1,200 people.", "Aldwick", {"population": "1,200", "river": "Ouse"})], "text string, title string, facts map<string,string>")
    kept = surfaced(F.col("text"), F.col("title"), F.col("facts"))
    r = df.select(kept.alias("kept"), facts_present(kept, F.lit("ALDWICK: 1200")).alias("ok"), facts_present(kept, F.lit("Aldwick: 12")).alias("bad"), rewritten(F.col("text"), kept, [lambda t: F.lit("gone"), F.upper])[1].alias("n"), rewritten(F.col("text"), kept, [lambda t: F.lit("gone")])[0].alias("same")).first()
    assert sorted(r["kept"]) == ["1 200", "aldwick"] and r["ok"] and not r["bad"] and r["n"] == 2 and r["same"].startswith("Aldwick has")


@pytest.mark.parametrize("args,error,coerced", [('{"query": "a", "top_k": "20"}', None, True), ('{"query": "a", "top_k": true}', "wrong_type", False), ("[1]", "not_object", False), ('{"q": 1}', "unknown_argument", False), (None, "missing_argument", False), ('{"query": "a", "top_k": 3.5}', "wrong_type", False)])
def test_argument_errors(spark, args, error, coerced):
    e, c = argument_error(F.col("a"))
    assert tuple(spark.createDataFrame([(args,)], "a string").select(e, c).first()) == (error, coerced)


def test_registry_and_corruption(spark):
    assert registry_of("builtin")[0]["name"] == "search"
    with pytest.raises(ValueError):
        registry_of("official")
    plan = spark.createDataFrame([("x", f"t{i}", s) for i in range(200) for s in range(3)], "arm string, task_id string, step int")
    got = corrupted(plan, F.lit(0.2), F.concat_ws("|", "task_id", F.col("step").cast("string"))).collect()
    share = sum(r["fault"] is not None for r in got) / len(got)
    assert 0.1 < share < 0.3 and all(r["degraded"] for r in got if r["fault"]) and not any(r["fault"] for r in corrupted(plan, F.lit(0.0), F.col("task_id")).collect())


# Sinks and state
def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", None), ("b", "é")], "key string, value string")
    sinks.dump(t, f"{tmp_path}/d")
    assert sorted(json.loads(r[0])["key"] for r in spark.read.text(f"{tmp_path}/d").collect()) == ["a", "b"] and all('"value"' in r[0] for r in spark.read.text(f"{tmp_path}/d").collect())
    sinks.put_object(spark, t.filter("value is not null"), f"{tmp_path}/o")
    assert [tuple(r) for r in sinks.read_any_cache(spark, f"{tmp_path}/o", "key", "value").collect()] == [("b", "é")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x").write_text('{"header": 1}\n{"key": "a", "value": "1"}\n{"key": "a", "value": "2"}\n{"key": "c", "va')
    assert [tuple(r) for r in sinks.read_any_cache(spark, f"{tmp_path}/log", "key", "value").collect()] == [("a", "2")]
    t.write.parquet(f"{tmp_path}/cand")
    assert not sinks.promote(spark, f"{tmp_path}/cand", f"{tmp_path}/out", t) and (tmp_path / "cand").exists() and not (tmp_path / "out").exists()
    assert sinks.promote(spark, f"{tmp_path}/cand", f"{tmp_path}/out", t.limit(0)) and not (tmp_path / "cand").exists() and spark.read.parquet(f"{tmp_path}/out").count() == 2
    h = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "step int, run string")
    assert sorted((r["step"], r["run"]) for r in sinks.resumed(h, "step", 2, spark.createDataFrame([(2, "new"), (3, "new")], "step int, run string")).collect()) == [(1, "old"), (2, "old"), (3, "new")]
    over = sinks.overlaid(*[spark.createDataFrame(x, "key string, value string") for x in ([("n", "1"), ("m", "2")], [("n", "3")], [("n", None), ("m", "4")])])
    assert {r["key"]: r["value"] for r in over.collect()} == {"n": "3", "m": "4"}


def test_mean_distance_in_two_steps(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, r double")
    got = {(x["g"], x["r"]): x["advantage"] for x in centred_mad(df, "r", "g").collect()}
    assert got["b", 2.0] == 0 and abs(got["a", 5.0] - 3 / (2 + 1e-4)) < 1e-9 and got["c", None] is None


def test_last_five_keeps_its_state():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    s, out = State(), []
    for part in ([1, 2, 3, 4], [5, 6, 7]):
        out += list(next(last_five(("u",), iter([pd.DataFrame({"ts": part, "event_id": part, "value": part})]), s))["rolling"])
    assert out == [1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]
