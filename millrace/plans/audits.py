"""Audits of training records, parsing of turns, and the last of the group windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import FUNCTION_WORDS, invented_names, norm_text
from millrace.operators.audit import audited_axes
from millrace.operators.parsing import parsed
from millrace.plans.base import RE, TR, norm, records, trajectories
from millrace.plans.episodes import MS, calls, messages, _LOG
from millrace.plans.rl import RO, rollouts
from millrace.registry import query
from millrace.sources.worlds import entities, walk

_STOPS = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
_FIRST = f"{MS}, au as (select record_id, max(content) filter (where role = 'user') as prompt, min_by(regexp_extract(content, '\"query\": \"([^\"]*)\"', 1), pos) filter (where role = 'assistant' and contains(content, '<tool_call>')) as query, max_by(regexp_extract(content, '<final_answer>(.*)</final_answer>', 1, 's'), pos) filter (where role = 'assistant') as answer, count(*) filter (where role = 'tool') as n_tool from ms group by 1)"


def audited(spark, d):
    m = messages(spark, d)
    is_call = (F.col("role") == "assistant") & F.contains("content", F.lit("<tool_call>"))
    return m.groupBy("record_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("prompt"), F.min_by(F.when(is_call, F.regexp_extract("content", r'"query": "([^"]*)"', 1)), F.when(is_call, F.col("pos"))).alias("query"),
        F.max_by(F.when(F.col("role") == "assistant", F.regexp_extract("content", r"(?s)<final_answer>(.*)</final_answer>", 1)), F.when(F.col("role") == "assistant", F.col("pos"))).alias("answer"), F.count(F.when(F.col("role") == "tool", 1)).alias("n_tool"),
    )


@query("q01_psychic_first", f"with {_FIRST} select record_id, coalesce(len([w for w in regexp_extract_all(query, '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({_STOPS}) and not contains(lower(coalesce(prompt, '')), lower(w))]), 0) as invented from au")
def q01(spark, d):
    return audited(spark, d).select("record_id", F.size(invented_names(F.col("query"), F.col("prompt"))).alias("invented"))


_HIT = f"{_FIRST}, tl as (select record_id, pos, row_number() over (partition by record_id order by pos) as nth, {norm('content')} as blob from ms where role = 'tool'), ht as (select au.record_id, n_tool, min(nth) filter (where {norm('answer')} <> '' and contains(blob, {norm('answer')})) as first_hit from au left join tl using (record_id) group by 1, 2)"


def hits(spark, d):
    w = Window.partitionBy("record_id").orderBy("pos")
    t = messages(spark, d).filter("role = 'tool'").withColumn("nth", F.row_number().over(w)).select("record_id", "nth", norm_text(F.col("content")).alias("blob"))
    a = audited(spark, d).select("record_id", "n_tool", norm_text(F.col("answer")).alias("want"))
    return a.join(t, "record_id", "left").groupBy("record_id", "n_tool").agg(F.min(F.when((F.col("want") != "") & F.contains("blob", F.col("want")), F.col("nth"))).alias("first_hit"))


@query("q02_unretrieved", f"with {_HIT} select record_id, n_tool > 0 and first_hit is null as unretrieved from ht")
def q02(spark, d):
    return hits(spark, d).select("record_id", ((F.col("n_tool") > 0) & F.col("first_hit").isNull()).alias("unretrieved"))


@query("q04_prefix", f"with {_HIT} select record_id, coalesce(first_hit < n_tool, false) as leaky from ht")
def q04(spark, d):
    return hits(spark, d).select("record_id", F.coalesce(F.col("first_hit") < F.col("n_tool"), F.lit(False)).alias("leaky"))


@query("a19_first_hit", f"with {_HIT} select n_tool, first_hit, count(*) as n from ht group by 1, 2")
def a19(spark, d):
    return hits(spark, d).groupBy("n_tool", "first_hit").agg(F.count("*").alias("n"))


@query("q06_verdict", f"with {_HIT} select count(*) as records, count(*) filter (where n_tool > 0 and first_hit is null) as unretrieved, count(*) filter (where first_hit < n_tool) as leaky, count(*) filter (where (n_tool > 0 and first_hit is null) or first_hit < n_tool) = 0 as clean from ht")
def q06(spark, d):
    miss, leak = (F.col("n_tool") > 0) & F.col("first_hit").isNull(), F.col("first_hit") < F.col("n_tool")
    return hits(spark, d).agg(F.count("*").alias("records"), F.count(F.when(miss, 1)).alias("unretrieved"), F.count(F.when(leak, 1)).alias("leaky"), (F.count(F.when(miss | leak, 1)) == 0).alias("clean"))


@query("q07_data_gate", f"with {RE} select count(*) >= 500 as enough, count(*) = count(distinct record_id) as unique_ids, bool_and(len(messages) > 0) as has_messages from re")
def q07(spark, d):
    return records(spark, d, "messages").agg((F.count("*") >= 500).alias("enough"), (F.count("*") == F.countDistinct("record_id")).alias("unique_ids"), F.bool_and(F.size("messages") > 0).alias("has_messages"))


def axes(spark, d):
    x = audited_axes(F.col("messages"))
    return records(spark, d, "messages", "meta").select("record_id", F.col("meta.difficulty").alias("hop"), x.alias("x")).select("record_id", "hop", "x.*")


_AXES = ["psychic_first", "psychic_think", "unretrieved", "leaky", "conflicting"]
def _found():
    return [F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in _AXES]


def by_question(spark, d):
    """The axes counted per question and hop; conflicting: records with an answer whose question has another one too."""
    g = axes(spark, d).groupBy("question", "hop").agg(
        F.count("*").alias("records"), F.count("answer").alias("answered"), F.min("answer").alias("least"), F.max("answer").alias("most"), F.collect_set("calls").alias("calls"),
        *[F.count_if(F.col(a)).alias(a) for a in _AXES[:-1]],
    )
    w = Window.partitionBy("question")
    return g.withColumn("conflicting", F.when(F.min("least").over(w) != F.max("most").over(w), F.col("answered")).otherwise(0))


def whole_verdict(spark, d):
    found = by_question(spark, d).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), *_found())
    return found.withColumn("clean", F.greatest(*_AXES) == 0)


@query("q05_psychic_think")
def q05(spark, d):
    return axes(spark, d).select("record_id", "psychic_think")


@query("q06_verdict_five")
def q06_five(spark, d):
    return whole_verdict(spark, d)


@query("q06_hops")
def q06_hops(spark, d):
    calls = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("calls")))).cast("array<string>"), "/")
    return by_question(spark, d).groupBy("hop").agg(F.sum("records").alias("records"), calls.alias("calls"), *_found())


@query("q07_data_gate_five")
def q07_five(spark, d):
    gate = q07(spark, d).crossJoin(whole_verdict(spark, d).select("clean"))
    return gate.withColumn("passed", F.col("enough") & F.col("unique_ids") & F.coalesce("has_messages", F.lit(False)) & F.col("clean"))


_ST = f"{TR}, st as (select task_id, generate_subscripts(steps, 1) - 1 as step, unnest(steps).assistant_text as t from tr)"


def turns(spark, d):
    return trajectories(spark, d, "steps").select("task_id", F.posexplode("steps").alias("step", "s")).select("task_id", "step", F.col("s.assistant_text").alias("t"))


@query("t20_parse_canonical", f"with {_ST} select task_id, step, nullif(regexp_extract(t, '<think>(.*?)</think>', 1, 's'), '') as thinking, nullif(regexp_extract(t, '<tool_call>.*?\"name\": \"([^\"]*)\".*?</tool_call>', 1, 's'), '') as call, nullif(regexp_extract(t, '<final_answer>(.*?)</final_answer>', 1, 's'), '') as answer from st")
def t20(spark, d):
    get = lambda p: F.nullif(F.regexp_extract("t", p, 1), F.lit(""))
    return turns(spark, d).select("task_id", "step", get(r"(?s)<think>(.*?)</think>").alias("thinking"), get(r'(?s)<tool_call>.*?"name": "([^"]*)".*?</tool_call>').alias("call"), get(r"(?s)<final_answer>(.*?)</final_answer>").alias("answer"))


@query("t16_lenient_parse")
def t16(spark, d):
    return turns(spark, d).select("task_id", "step", parsed(F.col("t")).alias("x")).select("task_id", "step", F.size("x.calls").alias("n_calls"), F.array_join("x.errors", ",").alias("errors"), F.col("x.strict").alias("strict"), F.col("x.final_answer").alias("answer"))


@query("t21_strict_format", f"with {TR}, st as (select task_id, unnest(steps) as s from tr) select task_id, bool_and(s.strict_format) as strict from st group by 1")
def t21(spark, d):
    return trajectories(spark, d, "steps").select("task_id", F.explode("steps.strict_format").alias("s")).groupBy("task_id").agg(F.bool_and("s").alias("strict"))


@query("w05_micro_adv", f"with {_LOG}, {RO.split(', ro as', 1)[0]}, ro as{RO.split(', ro as', 1)[1]}, px as (select task_id, split_part(task_id, '#', 1) as grp, idx, md5(string_agg(name || ':' || coalesce(args, ''), '|' order by idx) over (partition by task_id order by idx rows unbounded preceding)) as prefix from lg), j as (select px.*, reward from px join ro using (task_id)), k as (select *, count(*) over (partition by grp, prefix) as members, avg(reward) over (partition by grp, prefix) as mean from j) select task_id, idx, round(case when members >= 2 then reward - mean else 0 end, 10) + 0.0 as micro from k")
def w05(spark, d):
    w = Window.partitionBy("task_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sig = F.concat("name", F.lit(":"), F.coalesce("args", F.lit("")))
    p = calls(spark, d).withColumn("prefix", F.md5(F.array_join(F.collect_list(sig).over(w), "|"))).select("task_id", "idx", "prefix").join(rollouts(spark, d).select("task_id", "grp", "reward"), "task_id")
    g = Window.partitionBy("grp", "prefix")
    return p.select("task_id", "idx", (F.round(F.when(F.count("*").over(g) >= 2, F.col("reward") - F.avg("reward").over(g)).otherwise(0.0), 10) + F.lit(0.0)).alias("micro"))


@query("d11_refill", f"with {RO}, l as (select grp, min(task_id) as arrived, coalesce(stddev_pop(reward) filter (where not void) >= 1e-4, false) as live from ro group by 1), c as (select *, sum(live::int) over (order by md5(arrived), arrived) as so_far from l) select grp, so_far::bigint as so_far from c where live and so_far <= 100")
def d11(spark, d):
    live = F.coalesce(F.stddev_pop(F.when(~F.col("void"), F.col("reward"))) >= 1e-4, F.lit(False))
    g = rollouts(spark, d).groupBy("grp").agg(F.min("task_id").alias("arrived"), live.alias("live")).filter("live")
    first = g.orderBy(F.md5("arrived"), "arrived").limit(100)  # the target of the refill
    return first.select("grp", F.row_number().over(Window.orderBy(F.md5("arrived"), "arrived")).cast("long").alias("so_far"))


@query("s22_world")
def s22(spark, d):
    return entities(spark, spark.range(200).withColumnRenamed("id", "seed"))


@query("g01_walks")
def g01(spark, d):
    world = entities(spark, spark.range(200).withColumnRenamed("id", "seed"))
    return walk(world, "work", ["author", "born_in", "country"])
