import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.labels import mended_family, mended_label, mended_language
from millrace.operators.common import latest
from millrace.operators.curate import first_k, rebalance
from millrace.operators.retrieval import search
from millrace.operators.rewards import by_efficiency, centred


def one(spark, col, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("gold,pred,f1", [("a red barn", "the red barn", 1.0), ("red barn", "red", 2 / 3), ("red red barn", "red red", 0.8), ("red", "blue", 0.0), ("", "red", 0.0), ("red barn", None, 0.0)])
def test_token_f1(spark, gold, pred, f1):
    got = one(spark, T.token_f1(T.words_squad(F.col("g")), T.words_squad(F.col("p"))), g=gold, p=pred)
    assert math.isclose(got, f1)


@pytest.mark.parametrize("kind,value,answer,reason", [
    ("numeric", "100", "about 100.4 km", "ok"), ("numeric", "100", "101", "wrong_number"), ("numeric", "100", "none", "no_number_in_answer"), ("numeric", "5", "1 2 3 4 5", "matched_but_verbose"),
    ("text", '"Old Mill"', "the old-mill", "ok"), ("text", '"Old Mill"', "new mill", "text_mismatch"), ("text", '"!"', "x", "empty_gold"), ("any_of", '["a b","c"]', "see C", "ok"), ("all_of", '["a","q"]', "a", "missing:q"),
    ("none", "null", "There is no record of it", "ok"), ("none", "null", "It is red", "did_not_abstain"), ("text", '"x"', None, "no_answer"),
])
def test_match_answer(spark, kind, value, answer, reason):
    assert one(spark, T.match_answer(F.col("k"), F.col("v"), F.lit(None).cast("double"), F.col("a"))["reason"], k=kind, v=value, a=answer) == reason


def test_small_text_functions(spark):
    assert one(spark, T.norm_text(F.col("a")), a="  It's -- OK ") == "it s ok"
    assert one(spark, T.clip(F.col("a"), 30), a="x" * 40) == "x" * 10 + "... [+30 chars]"
    assert one(spark, T.cut_at_stop(F.col("a"), ["</b>", "</a>"]), a="1</a>2</b>") == "1</a>"
    assert one(spark, T.tidy(F.col("a")), a="Who , then ?") == "Who, then?"
    assert one(spark, T.invented_names(F.col("a"), F.col("b")), a="What Oslo Rome", b="in rome") == ["Oslo"]
    assert one(spark, T.unseen_numbers(F.col("a"), F.lit("in 1900")), a="1900 and 1,950") == ["1,950"]
    assert one(spark, T.evidence_ids(F.col("a")), a="2hop1__7_7_5") == [5, 7]


def test_labels(spark):
    assert one(spark, mended_label(F.col("a")), a="　Town-Gazetteer ") == "town_gazetteer"
    assert one(spark, mended_label(F.col("a")), a="  ") is None
    assert one(spark, mended_family(F.col("a")), a=" Musique-2Hop") == "musique_2hop"
    assert [one(spark, mended_language(F.col("a")), a=x) for x in ("en-GB", "ger", "und", None, "Jp", "es-419")] == ["en", "de", None, None, "ja", "es"]


def bm25(passages, query):
    import re

    toks = {i: re.findall("[a-z0-9]+", f"{t} {x}".lower()) for i, t, x in passages}
    titles = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t, _ in passages}
    n, avg, out = len(toks), sum(map(len, toks.values())) / len(toks), []
    for i, d in toks.items():
        s = 0.0
        for w in re.findall("[a-z0-9]+", query.lower()):
            tf, df = d.count(w), sum(w in x for x in toks.values())
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
                s *= 1.6 if w in titles[i] else 1
        if s > 0:
            out.append((round(s, 4), i))
    return [i for _, i in sorted(out, key=lambda x: (-x[0], x[1]))][:3]


def test_search_against_brute_force(spark):
    rnd, words = random.Random(1), "river mill town bridge old red stone lake".split()
    p = [(str(i), " ".join(rnd.choices(words, k=2)), " ".join(rnd.choices(words, k=9))) for i in range(12)]
    q = "old mill mill at the river"
    df = spark.createDataFrame([("w", *x) for x in p], "world string, doc_id string, title string, text string")
    hits = search(df, spark.createDataFrame([("w", "q", q), ("w", "none", "zzz"), ("w", "blank", "")], "world string, query_id string, query string")).filter("query_id = 'q'").orderBy("rank").collect()
    assert [h["doc_id"] for h in hits] == bm25(p, q)


def test_windows(spark):
    df = spark.createDataFrame([("a", 1.0, 2, True), ("a", 0.0, 5, False), ("a", 1.0, 4, True), ("b", 0.5, 1, True)], "g string, r double, c int, s boolean")
    rows = df.select("g", F.round(centred(F.col("r"), "g"), 3).alias("adv"), by_efficiency(F.col("r"), F.col("c"), F.col("s"), "g", 0.5).alias("e")).collect()
    assert sorted(r["adv"] for r in rows if r["g"] == "a") == [-1.414, 0.707, 0.707] and [r["adv"] for r in rows if r["g"] == "b"] == [0.0]
    assert sorted(r["e"] for r in rows if r["g"] == "a") == [0.0, 0.5, 1.0]


def test_curation(spark):
    df = spark.createDataFrame([(str(i), "x" if i < 30 else "y", i) for i in range(50)], "id string, kind string, loaded_at int")
    mix = {r["kind"]: r["count"] for r in rebalance(df, "kind", "id", {"x": 0.5, "y": 0.5}).groupBy("kind").count().collect()}
    assert mix == {"x": 20, "y": 20}
    assert first_k(df, ["kind"], [F.desc("loaded_at")], 2).count() == 4
    assert latest(df.withColumn("id", F.lit("k")), "id").first()["loaded_at"] == 49
    assert latest(df.limit(0), "id").count() == 0


def test_every_query_has_rows_and_a_stable_schema(spark):
    from millrace import registry

    d = "/root/testdata/sf0.001"
    for name in ("r02_bm25_top3", "v_scorecard", "d05_pipeline", "a03_grouping_sets", "w01_group_adv", "st_tumbling_streamed"):
        a, b = registry.queries()[name](spark, d), registry.queries()[name](spark, d)
        assert a.schema == b.schema and a.count() > 0


def test_verdict_has_five_axes(spark, tmp_path):
    from millrace import registry

    def hits(text):
        return "tool", '{"results": [{"title": "Mill", "text": "%s", "score": 5.1949}]}' % text

    call = lambda q, t="": ("assistant", (f"<think>{t}</think>" if t else "") + f'<tool_call>{{"name": "search", "arguments": {{"query": "{q}"}}}}</tool_call>')
    end = lambda a: ("assistant", f"<final_answer>{a}</final_answer>")
    clean = [("user", "Who built it?"), call("built it", "First I look."), hits("built by Drask"), end("Drask")]
    cases = {
        "clean": [clean],
        "psychic_first": [[clean[0], call("Oslo mill"), *clean[2:]]],
        "psychic_think": [[clean[0], call("built it", "I will ask for Oslo"), *clean[2:]]],
        "unretrieved": [[*clean[:2], hits("nothing"), end("1949")]],
        "leaky": [[*clean[:3], call("more", "So Drask did it, or Drask again"), hits("none"), end("Drask")]],
        "conflicting": [clean, [("user", " who  built IT?"), call("built it"), hits("Pell"), end("Pell")]],
    }
    schema = "record_id long, source string, lang string, messages array<struct<role:string,content:string,name:string>>, meta struct<difficulty:int>, loaded_at timestamp"
    for name, records in cases.items():
        rows = [(i, "s", "en", [(r, c, None) for r, c in m], (2,), datetime(2026, 1, 1)) for i, m in enumerate(records)]
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/sft_record.parquet")
        run = lambda q: registry.queries()[q](spark, f"{tmp_path}/{name}").collect()  # noqa: B023, E731
        got = run("q06_verdict_five")[0].asDict()
        assert got.pop("records") == len(records) and got.pop("clean") == (name == "clean")
        assert {k for k, n in got.items() if n} == {name} - {"clean"}
        hop = run("q06_hops")[0].asDict()
        assert hop["hop"] == 2 and {k: hop[k] for k in got} == got
        gate = run("q07_data_gate_five")[0]
        assert gate["clean"] == (name == "clean") and not gate["passed"] and not gate["enough"]


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).parent.parent / "millrace"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "millrace.llm" in p.read_text()]
