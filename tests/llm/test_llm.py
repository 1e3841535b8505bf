import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.blending import blend
from millrace.llm.canonical import Ledger, canonical
from millrace.llm.capping import cap_per_contributor
from millrace.llm.components import connected_components
from millrace.llm.leakage import agrees, hard_words, leaked, words
from millrace.llm.mixture import proportional_sample
from millrace.llm.pairs import defective_pairs, defects
from millrace.llm.residue import COUNTERS, _frequencies, _levels, _node, close_pairs, prefix_pairs, residue, shingles_of, similar, simhash, slot, slot_in_reply, whole_label, words_of
from millrace.llm.tokens import Bpe, Tokenizer, merge_plainly, token_budget

CELLS = "mix_name string, cell_id string, sample_share double, kind string, tier int, target_share double, min_rows int"


# 1
def test_sample_meets_quotas_and_reports_unmet(spark):
    rows = spark.createDataFrame([(f"t{i}", "a" if i % 10 else "b", i % 3) for i in range(1000)], "id string, kind string, tier int").withColumn("cell_id", F.lit("clash"))
    cells = spark.createDataFrame([("m", "1", 0.5, "a", None, 0.5, 3), ("m", "2", 0.5, "b", None, 0.5, 3), ("n", "3", 0.1, None, 2, 1.0, 500), ("n", "4", 0.1, None, 9, 0.0, 1)], CELLS)
    s = proportional_sample(rows, cells, "id", ["kind", "tier"], slices=16)
    rep = {r["cell_id"]: r for r in s.report.collect()}
    assert [rep[k]["unmet"] for k in "1234"] == [False, True, True, True]
    assert rep["2"]["taken"] == 100 and rep["1"]["taken"] == 400  # what the short cell lacks goes to the other
    got = s.rows.collect()
    assert Counter(r["cell_id"] for r in got) == {k: r["taken"] for k, r in rep.items() if r["taken"]}
    assert len({(r["mix_name"], r["id"]) for r in got}) == len(got)
    for more in (proportional_sample(rows.repartition(7), cells, "id", ["kind", "tier"], slices=16), proportional_sample(rows, cells, "id", ["kind", "tier"], slices=512)):
        assert sorted(map(str, more.rows.collect())) == sorted(map(str, got))


def test_floors_beyond_the_sample_shrink(spark):
    rows = spark.createDataFrame([(f"t{i}", "abc"[i % 3], 0) for i in range(900)], "id string, kind string, tier int")
    cells = spark.createDataFrame([("m", str(k), 100 / 900, "abc"[k], None, s, f) for k, (s, f) in enumerate([(0.98, 5), (0.01, 50), (0.01, 10)])] + [("n", f"n{k}", 100 / 900, "abc"[k], None, s, 50) for k, s in enumerate([0.98, 0.01, 0.01])], CELLS)
    rep = {r["cell_id"]: r for r in proportional_sample(rows, cells, "id", ["kind", "tier"]).report.collect()}
    assert [rep[k]["drawn"] for k in "012"] == [40, 50, 10] and rep["0"]["below"] and not rep["1"]["below"]
    assert sum(rep[f"n{k}"]["drawn"] for k in range(3)) == 100 and min(rep[f"n{k}"]["drawn"] for k in range(3)) >= 33


def test_sample_edges(spark):
    rows = spark.createDataFrame([(None, "a", 1), ("x", None, None), ("y", "a", None)], "id string, kind string, tier int")
    cells = spark.createDataFrame([("m", "1", 1.0, "a", None, 0.5, 1), ("m", "2", 1.0, None, None, 0.5, 1)], CELLS)
    rep = {r["cell_id"]: r["available"] for r in proportional_sample(rows, cells, "id", ["kind", "tier"]).report.collect()}
    assert rep == {"1": 1, "2": 2}
    empty = proportional_sample(rows.limit(0), cells, "id", ["kind", "tier"])
    assert empty.rows.count() == 0 and all(r["unmet"] for r in empty.report.collect())
    assert proportional_sample(rows, cells.limit(0), "id", ["kind", "tier"]).report.count() == 0


# 2
@pytest.mark.parametrize("a,b,same", [
    ("Who, then?", "﻿who then ", True), ("café", "café", True), ("Ａｂc", "abc", True), ("within 1.5 km", "within 15 km", False), ("-5", "5", False), ("10%", "10", False), ("1,000", "1000", True),
    ('{"a": 1, "b": "x y"}', "b = X Y\na = 1", True), ("a: 1; b: 2", "- b: 2\n- a: 1", True), ("a: 1; b: 2", "a: 2; b: 1", False), ("A=1 | B=2", "(b=2 | a=1)", True),
    ("red dog: big", "big: red dog", False), ("who sold to whom", "whom sold to who", False), ("", " \n", True), ("un­der", "under", True), ("1 2", "12", False),
    ("What is C++?", "What is C?", False), ("x < y", "x > y", False), ("a+b", "ab", False), ("costs $5", "costs 5", False), ("> Who?\n> Me.", "who me", True), ("a + b", "a+b", True),
])
def test_canonical(a, b, same):
    assert (canonical(a) == canonical(b)) is same


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_canonical_ignores_case_and_space(s):
    assert canonical(s) == canonical(f"  {s}\n") and (canonical(s) is None) == (s is None)


def test_ledger_in_batches_equals_one_batch(spark):
    rnd = random.Random(3)
    rows = [(f"t{i:03}", rnd.choice(["Red?", "red", "RED.", "blue", "a: 1; b: 2", "b=2 | a=1", None, ""])) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("key", F.lit("clash"))
    whole = Ledger(spark, buckets=4).update(df, "id", "text")
    parts = Ledger(spark, buckets=4).update(df.filter("id >= 't050'"), "id", "text").update(df, "id", "text").update(df.limit(0), "id", "text")
    want = sorted(map(tuple, whole.duplicates().collect()))
    assert sorted(map(tuple, parts.duplicates().collect())) == want and len(want) == sum(v is not None for _, v in rows) - 4
    assert sorted(r["copies"] for r in parts.groups().collect()) == sorted(r["copies"] for r in whole.groups().collect())
    assert Ledger(spark, buckets=4).update(df.limit(0), "id", "text").groups().count() == 0


def test_ledger_is_opened_again_and_writes_touched_buckets_only(spark, tmp_path):
    first = spark.createDataFrame([(f"a{i:02}", f"Text {i}.") for i in range(60)], "id string, text string")
    Ledger(spark, str(tmp_path), buckets=8).update(first, "id", "text")
    again = Ledger(spark, str(tmp_path))
    before = dict(again.state["counts"])
    again.update(spark.createDataFrame([("b1", "text 7"), ("a03", "another text")], "id string, text string"), "id", "text")
    assert again.version == 2 and sum(before[b] != v for b, v in again.state["counts"].items()) == 1 and sum(n for _, n in again.state["counts"].values()) == 60
    last = Ledger(spark, str(tmp_path))
    assert [tuple(r) for r in last.duplicates().collect()] == [("a07", "b1")] and last.groups().count() == 60 and last.members().count() == 61


def test_ledger_grows_into_more_buckets(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.canonical.BUCKET_ROWS", 5)
    rows = [(f"a{i:02}", f"Text {i % 40}.") for i in range(60)]
    ledger = Ledger(spark, buckets=2)
    for k in range(3):
        ledger.update(spark.createDataFrame(rows[20 * k : 20 * k + 20], "id string, text string"), "id", "text")
    assert ledger.state["buckets"] > 2 and ledger.groups().count() == 40 and ledger.duplicates().count() == 20 and ledger.members().count() == 60


# 3
def test_cap(spark):
    rows = [(f"x{i:03}", "hot", i % 7 / 7) for i in range(300)] + [("n1", None, None), ("n2", None, float("nan")), ("z", "one", 1.0), (None, "one", 2.0)]
    df = spark.createDataFrame(rows, "id string, who string, q double").withColumn("rank", F.lit(0))
    kept = cap_per_contributor(df, "id", "who", ["q"], cap=8).collect()
    want = [i for _, i in sorted((-q, i) for i, w, q in rows if w == "hot")][:8]
    assert [r["id"] for r in sorted(kept, key=lambda r: r["rank"]) if r["who"] == "hot"] == want and len(kept) == 11
    assert cap_per_contributor(df, "id", "who", ["q"], cap=8, max_share=0.01).filter("who = 'hot'").count() == 3
    assert cap_per_contributor(df.limit(0), "id", "who", ["q"]).count() == 0


def test_cap_by_weighted_draw_prefers_better(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("w").alias("who"), (F.col("id") % 2).cast("double").alias("q"))
    good = cap_per_contributor(df, "id", "who", ["q"], cap=1000, temperature=1.0, seed=5).join(df.select("id", "q"), "id").agg(F.avg("q")).first()[0]
    assert 0.6 < good < 0.8  # drawn without replacement with odds e : 1


# 4
@pytest.mark.parametrize("prompt,answer,want", [
    ("Who runs the mill?", None, "empty"), ("Who?", "<final_answer> \n</final_answer>", "empty"), ("Who runs the old mill?", "“WHO RUNS THE OLD MILL”", "copies_question"), ("Who runs the old mill?", "You asked: Who runs the old mill?", "copies_question"),
    ("Who?", "I'm sorry, but I can't help with that.", "refusal"), ("Who?", "This cannot be answered from the given passages.", None), ("Wer?", "Das steht in keinem der Abschnitte.", None), ("Wer ist der Besitzer der alten Mühle und wo ist sie?", "Diese Frage darf ich leider nicht beantworten.", "refusal"),
    ("Who?", "<final_answer>Oslo", "truncated"), ("Who?", "It lies in ... [+40 chars]", "truncated"), ("Who?", "It lies in Oslo,", "truncated"), ("What is the name of the town?", "Das Archiv ist in der Stadt und wurde von dem Rat gegründet.", "other_language"),
    ("Write a sentence in German about the town.", "Das Archiv ist in der Stadt und wurde von dem Rat gegründet.", None), ("Who?", "Oslo", None), ("Who?", "434 km", None), (None, "Oslo", None),
])
def test_pair_rules(prompt, answer, want):
    assert (defects(prompt, answer)[0] or [None])[0] == want


@pytest.mark.parametrize("answer", [
    "Mi dispiace, non posso rispondere a questa domanda.", "Lamento, mas não posso responder a essa pergunta.", "Sorry, dat kan ik niet beantwoorden.", "Przykro mi, nie mogę odpowiedzieć na to pytanie.",
    "很抱歉，我无法回答这个问题。", "죄송합니다. 그 질문에는 답변을 드릴 수 없습니다.", "I am unable to say who that is.", "We are not at liberty to discuss this.",
])
def test_refusals_in_other_languages_than_the_data(answer):
    assert "refusal" in defects("Who?", answer)[0]


@pytest.mark.parametrize("prompt,answer,want", [
    ("Wer ist der Besitzer der alten Mühle und wo ist sie?", "그 방앗간은 강가에 서 있으며 오래된 마을에 속해 있습니다.", True), ("Who owns the old mill of the town?", "这座磨坊属于河边的一个古老村庄。", True), ("Who owns the old mill of the town?", "Il mulino è stato costruito nel villaggio dal figlio della contessa.", True),
    ("Chi è il padrone del mulino che non è nel villaggio?", "Il mulino è stato costruito nel villaggio dal figlio della contessa.", False), ("Write a caption in Korean for the picture of the mill.", "그 방앗간은 강가에 서 있으며 오래된 마을에 속해 있습니다.", False), ("Who owns the old mill of the town?", "Ο μύλος ανήκει στο παλιό χωριό.", True),
    ("Wem gehört die alte Mühle in der Stadt?", "漢字 Mühle", False),
])
def test_languages_by_script_and_words(prompt, answer, want):
    assert ("other_language" in defects(prompt, answer)[0]) is want


def test_terse_prompts_take_the_language_of_their_other_answers(spark):
    fr, en = "Le moulin est dans la ville et le conseil est au bord du lac.", "The mill was built by the people of the town."
    rows = [(f"f{i}", "start=Aldo | question=name the founder", fr) for i in range(3)] + [("e", "start=Aldo | question=name the founder", en)]
    rows += [(f"g{i}", "start=Bela | question=name the founder", en) for i in range(2)] + [("h", "start=Bela | question=name the founder", fr)]
    rows += [("one", "start=Cora | question=name the founder", fr), ("takes", "start=Moulin | question=name the founder", fr), ("pair", "Who owns the old mill of the town?", fr)]
    got = {r["id"]: r["defects"] for r in defective_pairs(spark.createDataFrame(rows, "id string, p string, a string"), "id", "p", "a").collect()}
    assert got == {"h": ["other_language"], "one": ["other_language"], "pair": ["other_language"]}


def test_abrupt_endings_come_from_the_corpus(spark):
    full = [(f"a{i}", "p", f"The mill was built in {1500 + i} by the people of the town.", "answered", i) for i in range(30)]
    odd = [("cut", "p", "The mill was built in 1700 by the", "answered", 1), ("word", "p", "The mill was built in 1700 by the peo", "answered", 1), ("nostop", "p", "The mill was built in 1701 by the people of the town", "answered", 1), ("run", "p", "The mill was", "running", 1), (None, "p", "", "answered", 1), ("re", "p", None, "answered", 1), ("re", "p", "Oslo", "answered", 2)]
    df = spark.createDataFrame(full + odd, "id string, p string, a string, s string, at int").withColumn("shown", F.lit(1))
    got = {r["id"]: r["defects"] for r in defective_pairs(df, "id", "p", "a", "s", order_col="at").collect()}
    assert got == {"cut": ["truncated"], "word": ["truncated"]}
    assert defective_pairs(df.limit(0), "id", "p", "a", "s", order_col="at").count() == 0


# 5
MERGES = [(b"a", b"b"), (b"ab", b"ab"), (b"b", b"c"), (b" ", b"a"), (b"1", b"1"), (b"11", b"11"), (b" a", b"b")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc 1", max_size=24))
def test_token_counts_equal_plain_merging(s):
    bpe = Bpe(MERGES)
    assert bpe.count(s.encode()) == len(merge_plainly(bpe, s.encode()))


def test_public_tokenizer_counts():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import base64

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc, count = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_ranks(path, P.PATTERN).counter()
    for s in ["The mill was built in 1750, wasn't it?", "Wie viele Menschen", "東京 123456789", "", "   \n\n x", "a" * 3000]:
        assert count(s) == len(enc.encode_ordinary(s))
    assert count(None) == 0


def test_budget(spark):
    t = Tokenizer(MERGES)
    df = spark.createDataFrame([(1, "s", ["ab ab", None], 1), (1, "s", ["ab"], 2), (2, None, None, 1), (None, "s", ["c"], 1)], "id int, src string, x array<string>, at int").withColumn("n_tokens", F.lit(9))
    got = {(r["src"], r["all_src"]): (r["n_texts"], r["n_tokens"]) for r in token_budget(df, "x", t, {"src": F.col("src")}, "id", "at").collect()}
    assert got == {("s", 0): (2, 2), (None, 0): (1, 0), (None, 1): (3, 2)}
    assert token_budget(df.limit(0), "x", t, {"src": F.col("src")}).filter("n_texts > 0").count() == 0


# 6
ITEM = "The harbour of Vellamore was closed by Tannis Okerby in 1743, and the keeper of the Ostrand Light moved to Quillby with 12 boats."


def test_leaks(spark):
    other = "Nothing of note happened in the quiet valley that year, and the farmers kept their sheep near the river as before."
    cites = ITEM.replace("closed by", "shut by").replace("closed", "closed").replace(", and", ", [3] and also")
    docs = [(1, f"{other} {ITEM} {other}"), (2, f"{other} **{cites.upper()}**"), (3, ITEM.replace("Quillby", "Ronby").replace("1743", "1744").replace("Okerby", "Elm")), (4, other), (5, None), (6, ""), (7, "Vellamore and Tannis Okerby."), (1, ITEM.replace(" ", "\\n"))]
    df = spark.createDataFrame(docs * 1, "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([("i", ITEM, False, "Quillby"), ("j", None, True, None), ("k", "Which lamp did the keeper Fenn Arbuthnot carry to the Morrow gate in 1801?", True, "x")], "item_id string, text string, whole boolean, answer string")
    got = sorted((r["doc_id"], r["item_id"], r["has_answer"]) for r in leaked(df, items).collect())
    assert got == [(1, "i", True), (1, "i", True), (2, "i", True)]
    assert leaked(df.limit(0), items).count() == 0 and leaked(df, items.limit(0)).count() == 0


def test_alignment():
    item, hard = words(ITEM), hard_words(ITEM, {"the"})
    assert agrees(item, hard, words("x " + ITEM), True)
    assert not agrees(item, hard, item[:12], False) and agrees(item, hard, item[3:18], False)
    stretch = item[3:18]
    assert agrees(item, hard, [stretch[0], "really", *stretch[2:]], False) == (not hard[4])  # an edit may follow the first word
    assert agrees(["b", *item], [False, *hard], item, True) and agrees(item, hard, [w for w in item if w != "the"][:2] + item[2:], True)
    wrong = ["nobody" if w == "okerby" else w for w in item]
    assert not agrees(item, hard, wrong, True)


def test_latent_search_recalls_brute_force(spark):
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choices("bdfgklmnprstvz", k=1) + rnd.choices("aeiou", k=1)) + "".join(rnd.choices("bdklmnrst", k=3) + rnd.choices("aeiou", k=2))
    plain = "the old mill of this town was built near a river and its owner moved to another place in that year".split()
    make = lambda: " ".join(name().title() if rnd.random() < 0.25 else rnd.choice(plain) for _ in range(45))
    items = [(f"i{k}", make(), False, "") for k in range(60)]
    docs = [(k, f"{make()} {' '.join(items[k % 60][1].split()[5:27])} {make()}" if k % 3 == 0 else make()) for k in range(240)]
    got = {(r[0], r[1]) for r in leaked(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string, whole boolean, answer string")).collect()}
    want = {(d, i) for d, t in docs for i, x, _, _ in items if agrees(words(x), hard_words(x, set()), words(t), False)}
    assert len(want) >= 80 and len(got & want) >= 0.9 * len(want)
    few = leaked(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string, whole boolean, answer string"), block_words=200, probes=99)
    assert {(r[0], r[1]) for r in few.collect()} == got  # neither blocks nor the inverted file change the rows here


def test_alignment_against_plain_edit_distance():
    rnd = random.Random(3)

    def least(item, hard, doc):  # edits of the best alignment of the whole item with a part of the document
        cur = [0] * (len(doc) + 1)
        for w, h in zip(item, hard):
            nxt = [10**6 if h else cur[0] + 1]
            for j, d in enumerate(doc):
                nxt.append(min(cur[j] + (0 if d == w else 10**6 if h else 1), 10**6 if h else cur[j + 1] + 1, nxt[j] + (10**6 if d.isdigit() else 1)))
            cur = nxt
        return min(cur)

    for _ in range(300):
        item = [rnd.choice("abcd") for _ in range(rnd.randint(1, 14))]
        hard, doc = [rnd.random() < 0.2 for _ in item], [rnd.choice("abcd1") for _ in range(rnd.randint(1, 20))]
        assert agrees(item, hard, doc, True) == (least(item, hard, doc) <= -(-len(item) // 10) + 1)


# 7
def test_blend(spark):
    rnd = random.Random(2)
    docs = [(i, "big" if i < 900 else "small" if i < 960 else None, rnd.randint(1, 9)) for i in range(1000)] + [(1000, "small", None)]
    df = spark.createDataFrame(docs, "id int, source string, size int").withColumn("copy", F.lit(1))
    w = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 5), ("zero", 0.0, None), ("x", None, 1)], "source string, target_share double, max_repeats int")
    b = blend(df, w, "id", "source", "size", seed=1)
    rep = {r["source"]: r for r in b.report.collect()}
    assert {k for k, r in rep.items() if r["short"]} == {"small", "none"}
    copies = Counter((r["source"], r["id"]) for r in b.rows.collect())
    assert all(n == 3 for (s, _), n in copies.items() if s == "small") and max(copies.values()) == 3
    assert abs(sum(n for (s, _), n in copies.items() if s == "big") - 900 * rep["big"]["expected_copies"]) <= 1
    assert blend(df.limit(0), w, "id", "source", "size").rows.count() == 0 and blend(df, w.limit(0), "id", "source", "size").report.count() == 0


# 8
@pytest.mark.parametrize("text,label", [
    ("404 Not Found\nThe page you asked for is not here.", "error"), ("HOME | SEARCH\n\nPlease enable JavaScript to continue.\n\nTerms | Help", "script"), ("Lorem ipsum dolor sit amet. Magna vestib ornare felis.", "filler"), ("TODO: write this passage\nN/A", "filler"),
    ('{"error": "internal", "status": 500}', "error"), ("Traceback (most recent call last):\n  File x", "error"), ("sample sample sample sample sample sample sample", "filler"), ("Страница не найдена.", "error"),
    ("Pagina non trovata.", "error"), ("페이지를 찾을 수 없습니다.", "error"), ("请启用 JavaScript 后继续。", "script"), ("Proszę włączyć obsługę JavaScript.", "script"), ("- - -\n- - -", "filler"), ("Vault | Search | Home\n\n502\nBad Gateway", "error"),
    (json.dumps({"error": "busy", "message": "no answer " * 900}), "error"), (json.dumps({"message": "a letter home"}), None), ("The Mill - Home - Vault", None),
    ("Run 6: 4 of 600 searches came back with error 404 and were asked again.", None), ('{"query": "x", "num_results": 0, "results": []}', None), ("At the playhouse scripts are required reading; actors without one are sent home.", None), ("434 km", None), ("Oslo", None),
])
def test_whole_labels(text, label):
    assert whole_label(text) == label


@pytest.mark.parametrize("text,found", [
    ("Wool from {{ town }} was sold.", True), ("Born in [your city].", True), ("Founded by %s in 1900.", True), ("Born in <COUNTRY>.", True), ("<b>bold</b> text<br>", False), ("the toll is $x_{2} + 3$ marks", False),
    ('The templates name a slot in braces, as in "Who founded {org}?", and fill it.', False), ("Said [sic] that; [our note: no].", False), ("The sum of {a, b} is 3.", False),
])
def test_slots(text, found):
    assert slot(text) is found


def test_slots_in_search_replies():
    reply = lambda x: json.dumps({"query": "x", "num_results": 1, "results": [{"doc_id": "0", "title": "T", "text": x}]})
    assert slot_in_reply(reply("Wool from ${town} was sold.")) and not slot_in_reply(reply("Wool was sold.")) and not slot_in_reply('{"query": "x", "results": [')


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(120):03}", f"n{rnd.randrange(120):03}") for _ in range(90)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("a", "a"), (None, "b")]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {n: find(n) for n in up}


def test_simhash_tables_hold_close_fingerprints(spark):
    rnd = random.Random(5)
    hashes = [rnd.getrandbits(64) for _ in range(30)]
    near = [h ^ sum(1 << b for b in rnd.sample(range(64), 3)) for h in hashes]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    df = spark.createDataFrame([(f"{i:03}", signed(h)) for i, h in enumerate(hashes + near)], "node string, hash long")
    got = {tuple(r) for r in close_pairs(df).collect()}
    assert got >= {(f"{i:03}", f"{i + 30:03}") for i in range(30)} and all((hashes + near)[int(a)] ^ (hashes + near)[int(b)] for a, b in got)


def test_similar_against_brute_force(spark):
    rnd = random.Random(5)
    sets = {f"{i:02}": set(rnd.sample(range(14), 10)) for i in range(30)}
    df = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node string, shingles array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    got = {tuple(r) for r in similar(spark.createDataFrame(pairs, "a string, b string"), df).collect()}
    assert got == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} and got


def test_residue_links_all_pairs_of_the_stated_similarity(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    texts, common = [], [word() for _ in range(30)]
    for size in [20, 40, 80, 200] * 8:
        base = [word() for _ in range(size)] + common[: rnd.randrange(30)]
        texts.append(" ".join(base))
        for cut in (1, 2, size // 9):  # a run cut off, or words changed
            texts += [" ".join(base[cut:]), " ".join(base[: -cut // 2] + [word()])]
    texts = list(dict.fromkeys(texts))
    sets = [set(shingles_of(words_of(t)).tolist()) for t in texts]
    want = {i: sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["n_links"] for r in residue(df).collect() if r["doc_id"] is not None}
    assert sum(want.values()) > 100 and got == {i: n for i, n in want.items() if i % 9}


def test_counters_are_small_on_the_driver_and_given_back(spark, monkeypatch):
    n = np.r_[0 : 1 << 12, (1 << 32) - 1].astype(np.uint32)
    level = _levels(n)
    assert (np.diff(level.astype(int)) >= 0).all() and (level[:128] == n[:128]).all() and level[-1] > level[-2]
    docs = ["a mill stands by the river", "a mill stands by the river today", "a mill stands by the sea"]
    texts = spark.createDataFrame([(bytearray(_node(words_of(t))), t) for t in docs], "node binary, _text string")
    got, want = _frequencies(texts), Counter(k % COUNTERS for t in docs for k in shingles_of(words_of(t)).tolist())
    assert got.nbytes == COUNTERS and {int(i): int(got[i]) for i in np.flatnonzero(got)} == want and max(want.values()) == 3
    sent, make = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(make(x)) or sent[-1])
    prefix_pairs(texts).collect()
    assert len(sent) == 1 and not os.path.exists(sent[0]._path)


def test_residue_passes_labels_on_but_not_slots(spark):
    err = "The store of passages is closed today and nobody can say when the doors of it will be open for you again my friend"
    docs = [(1, "Please enable JavaScript to view the passage."), (2, None), (3, "  "), (4, "A mill stands in {town} and the river by it is slow, so the wheel turns only in spring when snow melts."), (5, "A mill stands in Oslo and the river by it is slow, so the wheel turns only in spring when snow melts."), (6, err), (6, err), (7, "Please enable JavaScript to view the passage."), (None, err + " today")]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("label", F.lit("clash"))
    got = [(r["doc_id"], r["label"]) for r in residue(df).collect()]
    assert sorted(x for x in got if x[1]) == [(1, "script"), (4, "slot"), (7, "script")] and len(got) == 7
    links = {r["doc_id"]: r["n_links"] for r in residue(df).collect()}
    assert links[6] == 1 and links[None] == 1 and links[1] == 0  # a row without id is linked too
    assert residue(df.limit(0)).count() == 0


def test_residue_passes_labels_on_between_copies_of_equal_words(spark):
    docs = [(1, "404 Not Found"), (2, "404\nNot\nFound"), (3, "The mill stands.")]
    got = {r["doc_id"]: (r["label"], r["by"], r["n_links"]) for r in residue(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {1: ("error", "rule", 0), 2: ("error", "component", 0), 3: (None, None, 0)}


def test_queries_run_on_small_tables(spark):
    from millrace.llm import queries

    found = queries.queries()
    assert {k for k in found if k.endswith("_found")} == {f"p{n}_found" for n in (1, 2, 3, 4, 6, 7, 8)}
    duckdb = pytest.importorskip("duckdb")
    from millrace.llm.oracles import oracle_sql

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("task", "trajectory", "scorecard", "mix_targets"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    for k, sql in oracle_sql().items():
        got = found[k](spark, folder)
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()) and got.count()
    total = found["p5_token_budget"](spark, folder).filter("all_source = 1 and all_lang = 1 and all_task_type = 1").first()
    assert total["n_texts"] == spark.read.parquet(f"{folder}/sft_record.parquet").select("record_id").distinct().count() and total["n_tokens"] > total["n_texts"]
    rep = found["p7_report"](spark, folder).collect()
    assert {r["source"] for r in rep if r["short"]} == {r["source"] for r in found["p7_found"](spark, folder).collect()} and all(abs(r["emitted"] - r["n_docs"] * r["expected_copies"]) <= 1.001 for r in rep)
