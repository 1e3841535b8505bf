"""Grouped rates and histograms over scorecards, tasks, records and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.base import CA, RE, TK, cards, records, tasks
from millrace.registry import query
from millrace.sources.jsonl import fingerprint
from millrace.sources.tables import table

RATES = ["success", "format_strict", "format_loose", "necessity_ok", "selection_ok", "args_ok", "recovery_ok", "final_correct", "side_effect_ok"]
MEANS = ["num_steps", "num_calls", "num_tool_errors"]


def block():
    """Null-skipping rates and means of a scorecard report; unusable F1 (NaN) is skipped like null."""
    return [
        F.count("*").alias("n"), *[F.round(F.avg(F.col(r).cast("int")), 4).alias(r) for r in RATES],
        F.round(F.avg(F.nanvl("final_f1", F.lit(None).cast("double"))), 4).alias("final_f1"), F.round(F.avg("detail.args_strict_frac"), 4).alias("args_strict"), *[F.round(F.avg(m), 2).alias(m) for m in MEANS],
    ]


_BLOCK = "count(*) as n, " + ", ".join(f"round(avg({r}::int), 4) as {r}" for r in RATES) + ", round(avg(final_f1) filter (where not isnan(final_f1)), 4) as final_f1, round(avg(detail.args_strict_frac), 4) as args_strict, " + ", ".join(f"round(avg({m}), 2) as {m}" for m in MEANS)
_COLS = ["task_type", "difficulty", "detail", "final_f1", *RATES, *MEANS]


@query("a02_block", f"with {CA} select {_BLOCK} from ca")
def a02(spark, d):
    return cards(spark, d, *_COLS).agg(*block())


@query("a03_grouping_sets", f"with {CA} select task_type, difficulty, cast(grouping(task_type) as integer) as g_type, cast(grouping(difficulty) as integer) as g_difficulty, {_BLOCK} from ca group by grouping sets ((), (task_type), (difficulty))")
def a03(spark, d):
    c = cards(spark, d, *_COLS)
    c = c.groupingSets([[], ["task_type"], ["difficulty"]], "task_type", "difficulty")
    return c.agg(F.grouping("task_type").cast("int").alias("g_type"), F.grouping("difficulty").cast("int").alias("g_difficulty"), *block())


@query("a04_failure_modes", f"with {CA} select split_part(failure_mode, ':', 1) as failure_mode, count(*) as n from ca group by 1")
def a04(spark, d):
    return cards(spark, d, "failure_mode").groupBy(F.substring_index("failure_mode", ":", 1).alias("failure_mode")).agg(F.count("*").alias("n"))


@query("a05_stop_reasons", f"with {CA} select stop_reason, count(*) as n from ca group by 1")
def a05(spark, d):
    return cards(spark, d, "stop_reason").groupBy("stop_reason").agg(F.count("*").alias("n"))


@query("a07_point_biserial", f"with {CA} select task_type, case when count(*) filter (where success is not null and num_calls is not null) >= 3 then round(corr(num_calls, success::int), 4) end as r from ca group by 1")
def a07(spark, d):
    ok = F.col("success").isNotNull() & F.col("num_calls").isNotNull()
    c = cards(spark, d, "task_type", "success", "num_calls").withColumn("x", F.when(ok, F.col("num_calls").cast("double"))).withColumn("y", F.when(ok, F.col("success").cast("double")))
    return c.groupBy("task_type").agg(F.when(F.count(F.when(ok, 1)) >= 3, correlation("x", "y")).alias("r"))


def correlation(x: str, y: str):
    """The correlation of two columns to four places, null where one of them is constant."""
    return F.round(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), 4)


_TERMS = ["final_f1", "num_calls", "num_tool_errors", "oracle_calls"]


@query("a08_term_audit", f"""with {CA}, t as ({' union all '.join(f"select '{t}' as term, coalesce(case when not isnan({t}) then {t} end, 0)::double as x, coalesce(success, false)::int as y from ca" for t in _TERMS)}),
    c as (select term, count(distinct x) as k, round(corr(x, y), 4) as r from t group by 1)
    select term, r, case when k < 2 then 'CONSTANT' when r is null or abs(r) < 0.05 then 'FLAT' when r < -0.10 then 'INVERTED' else 'OK' end as verdict from c""")
def a08(spark, d):
    c = cards(spark, d, "success", *_TERMS)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.nanvl(F.col(t).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias("x")) for t in _TERMS]))
    c = c.select(F.coalesce("success", F.lit(False)).cast("double").alias("y"), pairs.alias("p")).select("y", "p.*").groupBy("term").agg(F.countDistinct("x").alias("k"), correlation("x", "y").alias("r"))
    return c.select("term", "r", F.when(F.col("k") < 2, "CONSTANT").when(F.col("r").isNull() | (F.abs("r") < 0.05), "FLAT").when(F.col("r") < -0.10, "INVERTED").otherwise("OK").alias("verdict"))


@query("a09_hop_rollup", f"with {TK}, {CA}, x as (select len(tk.oracle_plan) as hops, ca.* from ca join tk on tk.task_id = split_part(ca.task_id, '#', 1)) select hops, cast(grouping(hops) as integer) as overall, count(*) as n, round(avg(final_f1) filter (where final_f1 between 0 and 1), 4) as mean_f1, round(avg(final_correct::int), 4) as exact, round(avg(num_calls), 4) as calls from x group by rollup (hops)")
def a09(spark, d):
    c = cards(spark, d, "final_f1", "final_correct", "num_calls").withColumn("base", F.substring_index("task_id", "#", 1)).drop("task_id")
    t = tasks(spark, d, "oracle_plan").select(F.col("task_id").alias("base"), F.size("oracle_plan").alias("hops"))
    return c.join(t, "base").rollup("hops").agg(F.grouping("hops").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("final_f1").between(0, 1), F.col("final_f1"))), 4).alias("mean_f1"), F.round(F.avg(F.col("final_correct").cast("int")), 4).alias("exact"), F.round(F.avg("num_calls"), 4).alias("calls"))


_WS = "len([w for w in regexp_split_to_array(coalesce(m.content, ''), '[ \\t\\n\\r\\f]+') if w <> ''])"


@query("a16_token_stats", f"with {RE}, x as (select record_id, meta.difficulty as hop, list_sum([{_WS} for m in messages]) as n, coalesce(list_sum([{_WS} for m in messages if m.role = 'assistant']), 0) as a from re) select hop, cast(grouping(hop) as integer) as overall, count(*) as n, round(avg(n), 4) as mean_tokens, max(n)::bigint as max_tokens, min(n)::bigint as min_tokens, count(*) filter (where n > 400) as over_length, round(sum(a) / sum(n), 6)::double as supervised from x group by rollup (hop)")
def a16(spark, d):
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != ""))
    r = records(spark, d, "messages", "meta").select(F.col("meta.difficulty").alias("hop"), F.aggregate("messages", F.lit(0), lambda a, m: a + count(m["content"])).alias("t"), F.aggregate(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0), lambda a, m: a + count(m["content"])).alias("a"))
    return r.rollup("hop").agg(F.grouping("hop").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg("t"), 4).alias("mean_tokens"), F.max("t").cast("long").alias("max_tokens"), F.min("t").cast("long").alias("min_tokens"), F.count(F.when(F.col("t") > 400, 1)).alias("over_length"), F.round(F.sum("a") / F.sum("t"), 6).alias("supervised"))


@query("a17_answer_diversity", f"with {TK}, c as (select task_type, oracle_answer, count(*) as k from tk group by 1, 2) select task_type, count(*) as answers, round(max(k) / sum(k), 6)::double as top_share from c group by 1")
def a17(spark, d):
    c = tasks(spark, d, "task_type", "oracle_answer").groupBy("task_type", "oracle_answer").agg(F.count("*").alias("k"))
    return c.groupBy("task_type").agg(F.count("*").alias("answers"), F.round(F.max("k") / F.sum("k"), 6).alias("top_share"))


_Q = "lower(regexp_replace(regexp_replace(prompt, '[ \\t\\r\\n\\f]+', ' ', 'g'), '^ | $', '', 'g'))"


@query("a18_conflicts", f"with {TK}, q as (select {_Q} as q, count(distinct oracle_answer) as answers, count(*) as n from tk group by 1) select count(*) as questions, count(*) filter (where answers > 1) as conflicting, coalesce(sum(n) filter (where answers > 1), 0)::bigint as affected, max(answers) as worst from q")
def a18(spark, d):
    q = F.lower(F.trim(F.regexp_replace("prompt", r"[ \t\r\n\f]+", " ")))
    c = tasks(spark, d, "prompt", "oracle_answer").groupBy(q.alias("q")).agg(F.countDistinct("oracle_answer").alias("answers"), F.count("*").alias("n"))
    bad = F.col("answers") > 1
    return c.agg(F.count("*").alias("questions"), F.count(F.when(bad, 1)).alias("conflicting"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("affected"), F.max("answers").alias("worst"))


@query("a20_composition", f"with {TK} select difficulty, len(oracle_plan) as plan_length, len(route) as route_length, count(*) as n, round(count(*) / sum(count(*)) over (), 6)::double as share from tk group by 1, 2, 3")
def a20(spark, d):
    t = tasks(spark, d, "difficulty", "oracle_plan", "route")
    n = t.agg(F.count("*")).scalar()
    return t.groupBy("difficulty", F.size("oracle_plan").alias("plan_length"), F.size("route").alias("route_length")).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / n, 6))


@query("s05_turn_histogram", f"with {RE} select len([1 for m in messages if m.role = 'assistant']) as turns, count(*) as n from re group by 1")
def s05(spark, d):
    return records(spark, d, "messages").groupBy(F.size(F.filter("messages", lambda m: m["role"] == "assistant")).alias("turns")).agg(F.count("*").alias("n"))


@query("s04_type_histogram", "select task_type, count(*) as n from task group by 1")
def s04(spark, d):
    return table(spark, d, "task", "task_type").groupBy("task_type").agg(F.count("*").alias("n"))


@query("s10_fingerprint", f"""with {TK}, h as (select sha256('{{"prompt":' || coalesce(cast(to_json(prompt) as varchar), 'null') || ',"task_id":' || cast(to_json(task_id) as varchar) || '}}') as h from tk where prompt is null or not regexp_matches(prompt, '[^\\x20-\\x2e\\x30-\\x7e]')),
  b as (select ('0x' || h[1:2])::bigint as b, sha256(string_agg(h, '' order by h)) as h from h group by 1) select sha256(string_agg(lpad(cast(b as varchar), 3, '0') || ':' || h, ',' order by b)) as fingerprint, (select count(*) from h) as n_rows from b""")
def s10(spark, d):
    t = tasks(spark, d, "prompt").select("task_id", "prompt").filter("prompt is null or not prompt rlike '[^\\\\x20-\\\\x2e\\\\x30-\\\\x7e]'")  # JSON writers differ beyond plain characters
    return fingerprint(t, nulls=True).withColumn("n_rows", F.lit(t.agg(F.count("*")).scalar()))


@query("d14_sorted_ids", f"with {TK} select row_number() over (order by task_id) as place, task_id from tk")
def d14(spark, d):
    """Places in the order of ids, without ranking the table in one task: ranges of ids first, then places within them."""
    ids = tasks(spark, d, "seed").select("task_id").withColumn("b", F.substring("task_id", 1, 14))
    per = ids.groupBy("b").agg(F.count("*").alias("k"))
    before = per.select("b", F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a range
    return ids.join(before, "b").select((F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("task_id"))).alias("place"), "task_id")


@query("d16_term_order", f"""with {CA}, t as ({' union all '.join(f"select '{t}' as term, coalesce(case when not isnan({t}) then {t} end, 0)::double as x, coalesce(success, false)::int as y from ca" for t in _TERMS)}),
    c as (select term, round(corr(x, y), 4) as r from t group by 1) select row_number() over (order by r desc nulls last, term) as place, term, r from c""")
def d16(spark, d):
    return a08(spark, d).select(F.row_number().over(Window.orderBy(F.desc_nulls_last("r"), "term")).alias("place"), "term", "r")  # one row a term


@query("s09_judge_checks", "select count(*) as n, count(distinct id) as ids, count(*) filter (where trim(answer) = '' or answer is null) as blank_gold, min(len(context)) as least_passages from judge_row")
def s09(spark, d):
    return table(spark, d, "judge_row", "id", "answer", "context").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count(F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", 1)).alias("blank_gold"), F.min(F.size("context")).alias("least_passages"))


@query("s32_sample_suffix", f"with {TK} select task_id || case when k > 0 then '#s' || k else '' end as sample_id, seed from tk, (select unnest(generate_series(0, 3)) as k)")
def s32(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return tasks(spark, d, "seed").select("task_id", "seed", k.alias("k")).select(F.when(F.col("k") > 0, F.concat("task_id", F.lit("#s"), F.col("k").cast("string"))).otherwise(F.col("task_id")).alias("sample_id"), "seed")
