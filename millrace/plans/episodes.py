"""Episodes: message islands, call indexes, seen text, repeat guards, verification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import canonical_value, longest_name, norm_text
from millrace.operators.verify import verify
from millrace.plans.base import CA, RE, TK, TR, norm, records, tasks, trajectories
from millrace.plans.text import _GP, _MATCH, _NUMS, F1S
from millrace.registry import query


def messages(spark, d):
    return records(spark, d, "messages").select("record_id", F.posexplode("messages").alias("pos", "m")).select("record_id", "pos", "m.role", F.coalesce("m.content", F.lit("")).alias("content"))


MS = f"{RE}, ms as (select record_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages).role as role, coalesce(unnest(messages).content, '') as content from re)"
_R = "(partition by record_id order by pos)"


def _rw():
    return Window.partitionBy("record_id").orderBy("pos")


@query("w07_merge_tool_turns", f"with {MS}, l as (select *, case when role = 'tool' and lag(role) over {_R} = 'tool' then 0 else 1 end as new from ms), i as (select *, sum(new) over {_R} as island from l) select record_id, island::bigint as island, any_value(role) as role, count(*) as n, sum(length(content))::bigint as chars from i group by 1, 2")
def w07(spark, d):
    m = messages(spark, d).withColumn("new", F.when((F.col("role") == "tool") & (F.lag("role").over(_rw()) == "tool"), 0).otherwise(1))
    m = m.withColumn("island", F.sum("new").over(_rw()))
    return m.groupBy("record_id", "island").agg(F.first("role").alias("role"), F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


_CALL = "role = 'assistant' and contains(content, '<tool_call>')"


@query("w08_call_index", f"with {MS} select record_id, pos, (sum(({_CALL})::int) over {_R})::bigint as calls_so_far from ms where true")
def w08(spark, d):
    call = (F.col("role") == "assistant") & F.contains("content", F.lit("<tool_call>"))
    return messages(spark, d).select("record_id", "pos", F.sum(call.cast("int")).over(_rw()).alias("calls_so_far"))


@query("w11_turn_weights", f"with {MS}, c as (select *, {_CALL} as is_call, sum(({_CALL})::int) over {_R} as i from ms) select record_id, pos, round(case when is_call then 1 + 1.0 / i when contains(content, '<final_answer>') then 0.5 else 1 end, 6)::double as weight from c where role = 'assistant'")
def w11(spark, d):
    call = (F.col("role") == "assistant") & F.contains("content", F.lit("<tool_call>"))
    m = messages(spark, d).withColumn("is_call", call).withColumn("i", F.sum(call.cast("int")).over(_rw())).filter("role = 'assistant'")
    w = F.when(F.col("is_call"), 1 + 1.0 / F.col("i")).when(F.contains("content", F.lit("<final_answer>")), 0.5).otherwise(1.0)
    return m.select("record_id", "pos", F.round(w, 6).alias("weight"))


@query("w09_seen_text", f"with {MS}, n as (select *, case when role in ('user', 'tool') then {norm('content')} else '' end as t from ms) select record_id, pos, md5(coalesce(string_agg(t, ' ' order by pos) filter (where t <> '') over (partition by record_id order by pos rows between unbounded preceding and 1 preceding), '')) as seen_md5 from n where true")
def w09(spark, d):
    t = F.when(F.col("role").isin("user", "tool"), norm_text(F.col("content"))).otherwise("")
    m = messages(spark, d).withColumn("t", F.when(t != "", t))
    before = _rw().rowsBetween(Window.unboundedPreceding, -1)
    return m.select("record_id", "pos", F.md5(F.array_join(F.collect_list("t").over(before), " ")).alias("seen_md5"))


@query("t26_chatml_render", f"with {MS} select record_id, md5(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>', chr(10) order by pos)) as rendered_md5 from ms group by 1")
def t26(spark, d):
    part = F.transform(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string,name:string>>")), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>")))
    return records(spark, d, "messages").filter(F.size("messages") > 0).select("record_id", F.md5(F.array_join(part, "\n")).alias("rendered_md5"))


@query("t27_char_spans", f"with {MS}, l as (select *, (sum(length(content)) over {_R})::bigint as upto from ms) select record_id, pos, upto - length(content) as start, upto as stop from l where role = 'assistant'")
def t27(spark, d):
    m = messages(spark, d).withColumn("stop", F.sum(F.length("content")).over(_rw()))
    return m.filter("role = 'assistant'").select("record_id", "pos", (F.col("stop") - F.length("content")).alias("start"), "stop")


_LOG = f"{TR}, lg as (select task_id, generate_subscripts(call_log, 1) - 1 as idx, unnest(call_log).name as name, unnest(call_log).args as args, unnest(call_log).ok as ok from tr)"


def calls(spark, d):
    return trajectories(spark, d, "call_log").select("task_id", F.posexplode("call_log").alias("idx", "c")).select("task_id", "idx", "c.name", "c.args", "c.ok")


@query("w13_repeat_guard", f"with {_LOG} select task_id, idx, count(*) over (partition by task_id, name, args order by idx rows unbounded preceding) as nth from lg")
def w13(spark, d):
    w = Window.partitionBy("task_id", "name", "args").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return calls(spark, d).select("task_id", "idx", F.count("*").over(w).alias("nth"))


@query("w13_first_repeats", f"with {_LOG}, c as (select *, count(*) over (partition by task_id, name, args order by idx rows unbounded preceding) as nth from lg) select task_id, min(idx) as first_guarded from c where nth > 1 group by 1")
def w13b(spark, d):
    return w13(spark, d).filter("nth > 1").groupBy("task_id").agg(F.min("idx").alias("first_guarded"))


def episodes(spark, d):
    t = tasks(spark, d, "task_type", "gold", "required_tools", "required_any", "forbidden_tools", "oracle_plan", "expect_side_effect").withColumnRenamed("task_id", "base").drop("loaded_at")
    return trajectories(spark, d, "stop_reason", "final_answer", "steps", "call_log", "sent_messages").withColumn("base", F.substring_index("task_id", "#", 1)).join(t, "base")


def _empty(r: str) -> str:
    return f"(coalesce(regexp_matches({r}, '^\\s*\\{{'), false) and (coalesce(json_extract_string({r}, '$.num_results') = '0', false) or json_extract({r}, '$.results') is null or json_array_length({r}, '$.results') = 0))"


_VS = f"""{_GP}, mt as ({_MATCH}), e as (select tr.task_id, tk.task_type, tk.gold.kind as kind, tr.stop_reason, tr.final_answer, steps, call_log, tk.required_tools, tk.required_any, tk.forbidden_tools, tk.oracle_plan, tk.expect_side_effect as want, sent_messages, mt.reason as answer_reason,
    mt.reason in ('ok', 'matched_but_verbose') as final_correct, coalesce(len(steps), 0) as num_steps, coalesce(len(call_log), 0) as num_calls, coalesce(len([1 for c in call_log if not c.ok]), 0) as num_tool_errors,
    coalesce(len(tk.oracle_plan), 0) as oracle_calls, coalesce(len([1 for s in steps if len([1 for x in s.parse_errors if contains(x, 'unterminated_')]) > 0]) > 0, false) as truncated,
    len(steps) > 0 and len([1 for s in steps if not s.strict_format]) = 0 as format_strict, len(steps) > 0 and len([1 for s in steps if list_contains(s.parse_errors, 'malformed_tool_call') or list_contains(s.parse_errors, 'empty_turn')]) = 0 as format_loose,
    coalesce(list_distinct([c.name for c in call_log]), []) as called, coalesce(list_distinct([c.name for c in call_log if c.ok]), []) as ok_calls
    from tr join tk on tk.task_id = split_part(tr.task_id, '#', 1) join mt on mt.task_id = tr.task_id),
  v as (select *, coalesce(task_type <> 'no_tool', true) as needs, [t for t in required_tools if not list_contains(called, t)] || [array_to_string(g, '|') for g in required_any if not list_has_any(g, called)][1:1] as missing, list_has_any(coalesce(forbidden_tools, []), called) as forbidden,
    len([t for t in required_tools if not list_contains(ok_calls, t)]) = 0 and len([1 for g in required_any if not list_has_any(g, ok_calls)]) = 0 as args_ok,
    case when num_tool_errors > 0 then len([1 for i in generate_series(1, len(call_log)) if not call_log[i].ok and len([1 for c in call_log[i + 1:] if c.ok and c.name = call_log[i].name]) > 0]) > 0
      when coalesce(len([1 for c in call_log if c.ok and {_empty('c.result')}]), 0) > 0 then len([1 for i in generate_series(1, len(call_log)) if call_log[i].ok and {_empty('call_log[i].result')} and len([1 for c in call_log[i + 1:] if not {_empty('c.result')}]) > 0]) > 0 end as recovery_ok from e),
  w as (select *, case when task_type = 'compute' then true else (num_calls > 0) = needs end as necessity_ok from v),
  s as (select *, case when want is not null then coalesce(len([1 for m in sent_messages if (coalesce(want."to", '') = '' or lower(m."to") = lower(want."to")) and len([1 for n in want.must_contain if not contains(lower(coalesce(m.subject, '') || ' ' || coalesce(m.body, '')), lower(n))]) = 0]) > 0, false) end as side_effect_ok from w),
  x as (select *, coalesce(final_correct, false) and not forbidden and coalesce(side_effect_ok, true) and (necessity_ok or needs) as success from s)"""


SCORES = ["task_id", "success", "format_strict", "format_loose", "necessity_ok", "selection_ok", "args_ok", "recovery_ok", "final_correct", "num_steps", "num_calls", "num_tool_errors", "oracle_calls", "truncated", "answer_reason", "side_effect_ok", "failure_mode"]


@query("v_scorecard", f"""with {_VS} select task_id, success, format_strict, format_loose, necessity_ok, len(missing) = 0 and not forbidden as selection_ok, args_ok, recovery_ok, final_correct, num_steps, num_calls, num_tool_errors, oracle_calls, truncated, answer_reason, side_effect_ok,
    case when success then '' when not format_loose and final_answer is null then 'format' when stop_reason = 'max_steps' then 'ran_out_of_steps' when stop_reason = 'empty_turn' then 'empty_turn' when not necessity_ok and not needs then 'unnecessary_tool_use' when not necessity_ok then 'answered_without_tools'
    when forbidden then 'forbidden_tool' when want is not null and not side_effect_ok then 'missing_or_wrong_side_effect' when len(missing) > 0 then 'missing_tool:' || missing[1] when not args_ok then 'bad_arguments' when recovery_ok = false then 'no_recovery' when answer_reason = 'no_answer' then 'no_final_answer' else 'wrong_answer:' || answer_reason end as failure_mode from x""")
def v_scorecard(spark, d):
    return verify(episodes(spark, d)).select(*SCORES)


_CANON = lambda v: f"coalesce(cast(round(try_cast(trim({v}, ' ') as double), 6) as varchar), lower(trim({v}, ' ')))"
_SAME = lambda w, g: f"({w} is null or coalesce({_CANON(g)} = {_CANON(w)}, false))"
_MEETS = f"c.name = s.name and {_SAME('s.arguments.query', chr(106) + 'son_extract_string(c.args, ' + repr('$.query') + ')')} and {_SAME('cast(s.arguments.top_k as varchar)', 'json_extract_string(c.args, ' + repr('$.top_k') + ')')}"
_EP = f"{TK}, {TR}, ep as (select tr.task_id, tk.task_type, tk.oracle_plan as plan, coalesce(call_log, []) as log from tr join tk on tk.task_id = split_part(tr.task_id, '#', 1))"


@query("v06_strict_args", f"with {_EP} select task_id, case when len(plan) > 0 then round(len([1 for s in plan if len([1 for c in log if {_MEETS}]) > 0]) / len(plan), 3) end as args_strict_frac, len([1 for c in log if c.coerced]) as arg_coercions from ep")
def v06(spark, d):
    return verify(episodes(spark, d)).select("task_id", "args_strict_frac", "arg_coercions")


@query("v09_error_kinds", f"with {_EP} select task_id, array_to_string(list_sort(list_distinct([coalesce(json_extract_string(c.result, '$.error'), '?') for c in log if not c.ok])), ',') as error_kinds from ep")
def v09(spark, d):
    return verify(episodes(spark, d)).select("task_id", F.array_join("error_kinds", ",").alias("error_kinds"))


_RUNS = "regexp_extract_all({q}, '[A-Z][A-Za-z0-9'']*(?:\\s+[A-Z][A-Za-z0-9'']*)*')"
longest = lambda q: f"coalesce(lower(list_reverse_sort([{{'w': len(regexp_split_to_array(r, '\\s+')), 'n': length(r), 'i': -i, 'r': r}} for r, i in {_RUNS.format(q=f'coalesce({q}, chr(32))')}])[1].r), '')"
_DIAG = f"""with recursive {_EP}, nm as (select task_id, [e for e in [{longest('s.arguments.query')} for s in plan if s.name = 'search' and coalesce(s.arguments.query, '') <> ''] if e <> ''] as names,
      [{norm("json_extract_string(c.args, '$.query')")} for c in log if c.name = 'search' and coalesce(json_extract_string(c.args, '$.query'), '') <> ''] as q from ep where task_type in ('musique_2hop', 'musique_3hop', 'musique_4hop')),
    ok as (select * from nm where len(names) > 0),
    w(task_id, i, covered, start, done) as (select task_id, 0, 0, 0, false from ok
      union all select task_id, i + 1, covered + case when straight or ahead > 0 then 1 else 0 end, case when straight then start + covered + 1 when ahead > 0 then start + ahead else start end, not straight and ahead = 0
        from (select w.*, coalesce(contains(q[start + covered + 1], names[i + 1]), false) as straight, coalesce(list_position([contains(x, names[i + 1]) for x in q[start + 1:]], true), 0)::integer as ahead from w join ok using (task_id) where not done and i < len(names))),
    last as (select task_id, max(covered) as covered from w group by 1)"""


@query("v07_hop_diagnostics", f"{_DIAG} select ok.task_id, coalesce(contains(q[1], names[1]), false) as anchor_ok, round(covered / len(names), 3) as progress_frac, case when len([1 for x in q if contains(x, names[1])]) > 0 then 1.0 else 0.0 end::double as reformulate_frac, len([1 for x in q if contains(x, names[1])]) > 0 as reformulate_ok from ok join last using (task_id)")
def v07(spark, d):
    return verify(episodes(spark, d)).filter("anchor_ok is not null").select("task_id", "anchor_ok", "progress_frac", "reformulate_frac", "reformulate_ok")


@query("t12_oracle_entity", f"with {TK} select task_id, {longest('oracle_plan[1].arguments.query')} as name from tk where len(oracle_plan) > 0")
def t12(spark, d):
    return tasks(spark, d, "oracle_plan").filter(F.size("oracle_plan") > 0).select("task_id", longest_name(F.col("oracle_plan")[0]["arguments"]["query"]).alias("name"))


@query("t13_args_match", f"with {_EP} select task_id, {_CANON("json_extract_string(log[1].args, '$.query')")} as query, {_CANON("json_extract_string(log[1].args, '$.top_k')")} is not null as has_top_k from ep where len(log) > 0")
def t13(spark, d):
    args = F.col("call_log")[0]["args"]
    t = episodes(spark, d).filter(F.size("call_log") > 0)
    return t.select("task_id", canonical_value(F.get_json_object(args, "$.query")).alias("query"), canonical_value(F.get_json_object(args, "$.top_k")).isNotNull().alias("has_top_k"))


@query("v08_recovery", f"with {_VS} select task_id, recovery_ok from x where recovery_ok is not null")
def v08(spark, d):
    return verify(episodes(spark, d)).filter("recovery_ok is not null").select("task_id", "recovery_ok")


@query("v11_side_effects", f"with {_VS} select task_id, side_effect_ok, success from x where want is not null")
def v11(spark, d):
    e = verify(episodes(spark, d))
    return e.filter("side_effect_ok is not null").select("task_id", "side_effect_ok", "success")


@query("v10_strict", f"with {_VS}, y as (select *, coalesce(list_contains(steps[-1].parse_errors, 'untagged_final_answer'), false) as untagged from x) select task_id, case when untagged then 'untagged_answer_strict' when kind = 'numeric' and answer_reason in ('ok', 'matched_but_verbose') and len(list_distinct([round(n, 6) for n in {_NUMS}])) > 2 then 'shotgun_strict' else answer_reason end as answer_reason from y")
def v10s(spark, d):
    return verify(episodes(spark, d), strict_match=True).select("task_id", "answer_reason")


_V10 = f"with {_VS}, {F1S}, o as (select x.task_id, final_correct, round(case when kind = 'none' then final_correct::int else f1 end, 6)::double as final_f1  from x join f1s using (task_id))"


@query("v10_final_f1", f"{_V10} select task_id, final_correct, final_f1 from o")
def v10(spark, d):
    return verify(episodes(spark, d)).select("task_id", "final_correct", "final_f1")


_MODES = "case when success then '' when not format_loose and final_answer is null then 'format' when stop_reason = 'max_steps' then 'ran_out_of_steps' when stop_reason = 'empty_turn' then 'empty_turn' when not necessity_ok and not needs then 'unnecessary_tool_use' when not necessity_ok then 'answered_without_tools' when forbidden then 'forbidden_tool' when want is not null and not side_effect_ok then 'missing_or_wrong_side_effect' when len(missing) > 0 then 'missing_tool' when not args_ok then 'bad_arguments' when recovery_ok = false then 'no_recovery' when answer_reason = 'no_answer' then 'no_final_answer' else 'wrong_answer' end"


@query("v14_failure_histogram", f"with {_VS} select {_MODES} as failure_mode, count(*) as n from x group by 1")
def v14(spark, d):
    return verify(episodes(spark, d)).groupBy(F.substring_index("failure_mode", ":", 1).alias("failure_mode")).agg(F.count("*").alias("n"))
