"""Text functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.base import TK, TR, norm, tasks, toks, trajectories
from millrace.registry import query
from millrace.sources.tables import table

@query("t01_tokens", f"select doc_id, len({toks('text')}) as n_tokens, {toks('text')}[1] as first_token, len(list_distinct({toks('text')})) as n_distinct from documents where text is not null")
def t01(spark, d):
    x = T.words_bm25(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.size(x).alias("n_tokens"), F.get(x, F.lit(0)).alias("first_token"), F.size(F.array_distinct(x)).alias("n_distinct"))


@query("t02_norm_text", f"select doc_id, md5({norm('text')}) as norm_md5, length({norm('text')}) as norm_length from documents")
def t02(spark, d):
    n = T.norm_text(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_length"))


_PUNCT = "regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
squad = lambda x: f"[w for w in regexp_split_to_array({_PUNCT.format(x=x)}, '\\s+') if w not in ('', 'a', 'an', 'the')]"


@query("t03_squad_tokens", f"select doc_id, len({squad('text')}) as n_tokens, array_to_string({squad('text')}[1:5], ' ') as head from documents")
def t03(spark, d):
    x = T.words_squad(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(x).alias("n_tokens"), F.array_join(F.slice(x, 1, 5), " ").alias("head"))


def _gp(spark, d):
    j = trajectories(spark, d, "final_answer").select("task_id", F.substring_index("task_id", "#", 1).alias("base"), "final_answer")
    return j.join(tasks(spark, d, "oracle_answer", "gold").withColumnRenamed("task_id", "base"), "base")


_GP = f"{TK}, {TR}, gp as (select tr.task_id, final_answer, oracle_answer, gold from tr join tk on tk.task_id = split_part(tr.task_id, '#', 1))"
_CNT = "list_sum([least(len([1 for y in g if y = x]), len([1 for y in p if y = x])) for x in list_distinct(g)])"


@query("t04_token_f1", f"with {_GP}, w as (select task_id, {squad('oracle_answer')} as g, {squad('final_answer')} as p from gp), c as (select *, coalesce({_CNT}, 0) as c from w) select task_id, round(case when c > 0 then 2.0 * c / (len(g) + len(p)) else 0 end, 6)::double as f1 from c")
def t04(spark, d):
    gp = _gp(spark, d)
    return gp.select("task_id", F.round(T.token_f1(T.words_squad(F.col("oracle_answer")), T.words_squad(F.col("final_answer"))), 6).alias("f1"))


@query("t07_numbers", f"with {TR} select task_id, len(regexp_extract_all(coalesce(final_answer, ''), '-?\\d[\\d,]*\\.?\\d*')) as n_numbers, try_cast(replace(regexp_extract_all(coalesce(final_answer, ''), '-?\\d[\\d,]*\\.?\\d*')[1], ',', '') as double) as first_number from tr")
def t07(spark, d):
    n = T.numbers(F.col("final_answer"))
    return trajectories(spark, d, "final_answer").select("task_id", F.size(n).alias("n_numbers"), F.get(n, F.lit(0)).alias("first_number"))


_ABST = " or ".join(f"contains(lower(final_answer), '{m.replace(chr(39), chr(39) * 2)}')" for m in T.ABSTENTIONS)
_LIST = """from_json(gold.value, '["varchar"]')"""
_NUMS = "[try_cast(replace(x, ',', '') as double) for x in regexp_extract_all(final_answer, '-?\\d[\\d,]*\\.?\\d*')]"
_MATCH = f"""select task_id, gold.kind as kind, case
    when final_answer is null then 'no_answer'
    when gold.kind = 'numeric' then case
      when len({_NUMS}) = 0 then 'no_number_in_answer'
      when len([1 for n in {_NUMS} if abs(n - try_cast(gold.value as double)) <= coalesce(gold.tol, greatest(0.01, abs(try_cast(gold.value as double)) * 0.005))]) = 0 then 'wrong_number'
      when len(list_distinct([round(n, 6) for n in {_NUMS}])) > 4 then 'matched_but_verbose' else 'ok' end
    when gold.kind = 'text' then case when {norm('case when gold.value like $$"%"$$ then gold.value[2:-2] else gold.value end')} = '' then 'empty_gold'
      when contains({norm('final_answer')}, {norm('case when gold.value like $$"%"$$ then gold.value[2:-2] else gold.value end')}) then 'ok' else 'text_mismatch' end
    when gold.kind = 'any_of' then case when len([1 for v in {_LIST} if contains({norm('final_answer')}, {norm('v')})]) > 0 then 'ok' else 'text_mismatch' end
    when gold.kind = 'all_of' then case when len([1 for v in {_LIST} if not contains({norm('final_answer')}, {norm('v')})]) = 0 then 'ok' else 'missing:' || array_to_string([v for v in {_LIST} if not contains({norm('final_answer')}, {norm('v')})][1:3], '|') end
    when gold.kind = 'none' then case when {_ABST} then 'ok' else 'did_not_abstain' end end as reason from gp"""


@query("t08_match_answer", f"with {_GP} {_MATCH}")
def t08(spark, d):
    gp = _gp(spark, d)
    m = T.match_answer(F.col("gold.kind"), F.col("gold.value"), F.col("gold.tol"), F.col("final_answer"))
    return gp.select("task_id", F.col("gold.kind").alias("kind"), m["reason"].alias("reason"))


_SURFACE = """case gold.kind when 'any_of' then from_json(gold.value, '["varchar"]') when 'all_of' then [array_to_string(from_json(gold.value, '["varchar"]'), ' ')] when 'none' then [null] else [case when gold.value like '"%"' then gold.value[2:-2] else gold.value end] end"""
F1S = f"sf as (select task_id, unnest({_SURFACE}) as form, final_answer from gp), sw as (select task_id, {squad('form')} as g, {squad('final_answer')} as p from sf), sc as (select *, coalesce({_CNT}, 0) as c from sw), f1s as (select task_id, coalesce(max(case when c > 0 then 2.0 * c / (len(g) + len(p)) else 0 end), 0)::double as f1 from sc group by 1)"


@query("t06_answer_f1", f"with {_GP}, {F1S} select task_id, round(f1, 6)::double as f1 from f1s")
def t06(spark, d):
    return _gp(spark, d).select("task_id", F.round(T.answer_f1(T.gold_forms(F.col("gold.kind"), F.col("gold.value")), F.col("final_answer")), 6).alias("f1"))


STOPS_SQL = _STOPS = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)


@query("t09_psychic_caps", f"with {TK} select task_id, array_to_string([w for w in regexp_extract_all(oracle_plan[1].arguments.query, '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({_STOPS}) and not contains(lower(coalesce(prompt, '')), lower(w))], ' ') as invented from tk where len(oracle_plan) > 0")
def t09(spark, d):
    t = tasks(spark, d, "prompt", "oracle_plan").filter(F.size("oracle_plan") > 0)
    return t.select("task_id", F.array_join(T.invented_names(F.col("oracle_plan")[0]["arguments"]["query"], F.col("prompt")), " ").alias("invented"))


@query("t11_unseen_numbers", f"with {TR} select task_id, array_to_string([n for n in regexp_extract_all(coalesce(final_answer, ''), '\\d[\\d,]*') if {norm('n')} <> '' and not contains({norm('prompt')}, {norm('n')})], ' ') as unseen from tr")
def t11(spark, d):
    return trajectories(spark, d, "prompt", "final_answer").select("task_id", F.array_join(T.unseen_numbers(F.col("final_answer"), T.norm_text(F.col("prompt"))), " ").alias("unseen"))


@query("t22_clip", "select doc_id, md5(case when length(text) > 400 then text[1:380] || '... [+' || (length(text) - 380) || ' chars]' else text end) as clipped_md5 from documents where text is not null")
def t22(spark, d):
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.md5(T.clip(F.col("text"), 400)).alias("clipped_md5"))


_POS = "list_min([p for p in [case when instr(t, '</tool_call>') > 0 then instr(t, '</tool_call>') + 11 end, case when instr(t, '</final_answer>') > 0 then instr(t, '</final_answer>') + 14 end] if p is not null])"


@query("t23_cut_at_stop", f"with {TR}, s as (select task_id, unnest(steps).assistant_text as t, generate_subscripts(steps, 1) - 1 as step from tr) select task_id, step, length(case when {_POS} is not null then t[1:{_POS}] else t end) as kept from s where t is not null")
def t23(spark, d):
    s = trajectories(spark, d, "steps").select("task_id", F.posexplode("steps").alias("step", "s")).select("task_id", "step", F.col("s.assistant_text").alias("t")).filter("t is not null")
    return s.select("task_id", "step", F.length(T.cut_at_stop(F.col("t"), ["</tool_call>", "</final_answer>"])).alias("kept"))


_TIDY = "regexp_replace(regexp_replace(prompt, '[ \\t\\n\\r\\f\\x0b]+([?.,!;:])', '\\1', 'g'), '[ \\t\\n\\r\\f\\x0b]+(''s)\\b', '\\1', 'g')"


@query("t30_tidy", f"with {TK}, y as (select task_id, prompt, {_TIDY} as t from tk) select task_id, md5(case when {toks('t')} = {toks('prompt')} then t else prompt end) as tidy_md5 from y where prompt is not null")
def t30(spark, d):
    return tasks(spark, d, "prompt").filter("prompt is not null").select("task_id", F.md5(T.tidy(F.col("prompt"))).alias("tidy_md5"))


@query("t32_question_norm", "select id, trim(regexp_replace(regexp_replace(lower(trim(question)), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) as question from judge_row")
def t32(spark, d):
    return table(spark, d, "judge_row", "id", "question").select("id", T.norm_question(F.col("question")).alias("question"))


@query("t33_evidence_sig", "select id, array_to_string(list_sort(list_distinct([x::bigint for x in regexp_split_to_array(id, '[_-]+') if regexp_full_match(x, '\\d+')])), ',') as signature from judge_row")
def t33(spark, d):
    return table(spark, d, "judge_row", "id").select("id", F.array_join(F.transform(T.evidence_ids(F.col("id")), lambda x: x.cast("string")), ",").alias("signature"))


@query("t35_hash_seed", f"with {TK} select task_id, ('0x' || sha1(task_id)[1:8])::bigint as seed from tk")
def t35(spark, d):
    return tasks(spark, d, "seed").select("task_id", T.hex_int(F.col("task_id"), 8).alias("seed"))


@query("t36_template_pick", f"with {TK} select task_id, (('0x' || sha1(task_id)[1:2])::bigint % 7)::bigint as template from tk")
def t36(spark, d):
    return tasks(spark, d, "seed").select("task_id", (T.hex_int(F.col("task_id"), 2) % 7).alias("template"))


@query("t51_rank_bucket", "select distinct l_linenumber * 40 as r, list_min([b for b in [8, 16, 32, 64, 128, 256] if b >= l_linenumber * 40]) as bucket from lineitem")
def t51(spark, d):
    r = table(spark, d, "lineitem", "l_linenumber").select((F.col("l_linenumber") * 40).alias("r")).distinct()
    return r.select("r", F.array_min(F.filter(F.array(*[F.lit(b) for b in (8, 16, 32, 64, 128, 256)]), lambda b: b >= F.col("r"))).alias("bucket"))
