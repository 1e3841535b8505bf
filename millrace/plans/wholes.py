"""Fuller forms of operators whose first query shows a part: whole reports, derived columns, rounds, merged renderings, resumed logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import clip, gold_forms, invented_names, norm_text, unseen_numbers
from millrace.operators.curate import quality_reason
from millrace.operators.rewards import reward_parts
from millrace.operators.verify import empty_retrieval
from millrace.plans.audits import _ST, turns
from millrace.plans.base import CA, TK, TR, cards, norm, tasks, trajectories
from millrace.plans.curation import _BEST, _H, _SC, _WSQ, best, hashed, scored
from millrace.plans.episodes import MS, _LOG, _empty, _rw, calls, messages
from millrace.plans.extras import OPENERS, _OPEN
from millrace.plans.reports import correlation
from millrace.plans.retrieval import _FORMS, _STEPS, plan_hits
from millrace.plans.rl import RO, _ALL, _DAYS, _days, rollouts
from millrace.plans.text import STOPS_SQL, _SURFACE
from millrace.registry import query
from millrace.session import shared_dir
from millrace.sources.jsonl import TASK, read_cache, read_jsonl, todo
from millrace.sources.tables import table
from millrace.sources.worlds import KINDS, entities
from millrace.streaming.events import last_five, run_to_end

# Reports
_A06 = "count(*) as n_in, count(*) filter (where reason is null) as n_out, round(count(*) filter (where reason is null) / count(*), 4)::double as keep_rate, count(*) filter (where reason is null and recovered) as with_recovery, round(avg(num_calls) filter (where reason is null), 2) as avg_calls"


@query("a06_filter_report", f"with {_SC}, x as (select qr.*, difficulty from qr join ca using (task_id)) select task_type, difficulty, cast(grouping(task_type) as integer) as g_type, cast(grouping(difficulty) as integer) as g_difficulty, {_A06} from (select x.* exclude (task_type), x.task_type from x) group by grouping sets ((), (task_type), (difficulty))")
def a06r(spark, d):
    x = scored(spark, d).join(cards(spark, d, "difficulty").select("task_id", "difficulty"), "task_id").withColumn("reason", quality_reason())
    kept = F.col("reason").isNull()
    return x.groupingSets([[], ["task_type"], ["difficulty"]], "task_type", "difficulty").agg(
        F.grouping("task_type").cast("int").alias("g_type"), F.grouping("difficulty").cast("int").alias("g_difficulty"), F.count("*").alias("n_in"), F.count_if(kept).alias("n_out"),
        F.round(F.count_if(kept) / F.count("*"), 4).alias("keep_rate"), F.count_if(kept & F.col("recovered")).alias("with_recovery"), F.round(F.avg(F.when(kept, F.col("num_calls"))), 2).alias("avg_calls"),
    )


_PART = {
    "final_correct": "coalesce(case when not isnan(final_f1) then final_f1 end, 0) * 0.3", "selection": "coalesce(selection_ok::int, 0) * 0.1", "args": "coalesce(args_ok::int, 0) * 0.1", "format": "coalesce(format_strict::int, 0) * 0.05", "recovery": "coalesce(recovery_ok::int, 0) * 0.1",
    "necessity": "case when not coalesce(necessity_ok, false) then -0.2 else 0 end", "no_answer": "case when detail.answer_reason = 'no_answer' then -0.2 else 0 end", "overlong": "case when detail.truncated then -0.15 else 0 end",
}
_TERM = " union all ".join(f"select '{k}' as term, ({v})::double as x, coalesce(success, false)::int as y from ca" for k, v in _PART.items())


@query("a08_reward_terms", f"with {CA}, t as ({_TERM}), c as (select term, count(distinct x) as k, round(corr(x, y), 4) as r from t group by 1) select term, r, case when k < 2 then 'CONSTANT' when r is null or abs(r) < 0.05 then 'FLAT' when r < -0.10 then 'INVERTED' else 'OK' end as verdict from c")
def a08r(spark, d):
    """Each part of the reward against success; a part that did not fire counts as 0."""
    c = reward_parts(cards(spark, d, *_ALL))
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), F.coalesce(F.col(f"part_{k}"), F.lit(0.0)).alias("x")) for k in _PART]))
    c = c.select(F.coalesce("success", F.lit(False)).cast("double").alias("y"), p.alias("p")).select("y", "p.*").groupBy("term").agg(F.countDistinct("x").alias("k"), correlation("x", "y").alias("r"))
    return c.select("term", "r", F.when(F.col("k") < 2, "CONSTANT").when(F.col("r").isNull() | (F.abs("r") < 0.05), "FLAT").when(F.col("r") < -0.10, "INVERTED").otherwise("OK").alias("verdict"))


@query("a13_sampled_full", f"with {CA} select split_part(task_id, '-', 1) as source, cast(grouping(split_part(task_id, '-', 1)) as integer) as overall, count(*) as n, round(avg(final_f1) filter (where final_f1 between 0 and 1), 4) as f1, round(avg(format_strict::int), 4) as format, round(avg((coalesce(detail.truncated, false))::int), 4) as truncated, count(*) filter (where stop_reason = 'answered') as answered, count(*) filter (where stop_reason = 'max_steps') as max_steps, count(*) filter (where stop_reason = 'empty_turn') as empty_turn from ca group by rollup (split_part(task_id, '-', 1))")
def a13f(spark, d):
    c = cards(spark, d, "final_f1", "format_strict", "detail", "stop_reason").withColumn("source", F.substring_index("task_id", "-", 1))
    return c.rollup("source").agg(
        F.grouping("source").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("final_f1").between(0, 1), F.col("final_f1"))), 4).alias("f1"), F.round(F.avg(F.col("format_strict").cast("int")), 4).alias("format"), F.round(F.avg(F.coalesce("detail.truncated", F.lit(False)).cast("int")), 4).alias("truncated"),
        *[F.count_if(F.col("stop_reason") == s).alias(s) for s in ("answered", "max_steps", "empty_turn")],
    )


@query("d02_drop_counts", f"with {TK}, {_BEST}, q as (select best.task_id, oracle_answer, {_WSQ} as q, row_number() over (partition by {_WSQ} order by {_H('dedup', 'best.task_id')}, best.task_id) as rank from best join tk on tk.task_id = best.base), k as (select q, oracle_answer as kept from q where rank = 1) select count(*) filter (where rank = 1) as kept, count(*) filter (where rank > 1 and oracle_answer is not distinct from k.kept) as duplicates, count(*) filter (where rank > 1 and oracle_answer is distinct from k.kept) as conflicting from q join k on k.q is not distinct from q.q")
def d02c(spark, d):
    """Records kept, and those dropped for a question that has a kept record with the same answer or another."""
    t = tasks(spark, d, "prompt", "oracle_answer").select(F.col("task_id").alias("base"), F.lower(F.trim(F.regexp_replace("prompt", r"[ \t\r\n\f]+", " "))).alias("q"), "oracle_answer")
    x = best(spark, d).join(t, "base")
    first = x.groupBy("q").agg(F.min_by("oracle_answer", F.struct(hashed("dedup", F.col("task_id")), "task_id")).alias("kept"), F.count("*").alias("n"))
    per = x.groupBy("q", "oracle_answer").agg(F.count("*").alias("k"))
    j = per.join(first, per["q"].eqNullSafe(first["q"]))
    same = F.col("oracle_answer").eqNullSafe(F.col("kept"))
    return j.agg(F.count_if(same).alias("kept"), F.coalesce(F.sum(F.when(same, F.col("k") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(~same, F.col("k"))), F.lit(0)).alias("conflicting"))


_ARR = f"with {RO}, l as (select grp, min(task_id) as arrived, coalesce(stddev_pop(reward) filter (where not void) >= 1e-4, false) as live from ro group by 1), o as (select *, row_number() over (order by md5(arrived), arrived) as place from l)"


@query("d11_rounds", f"{_ARR}, r as (select *, case when place <= 300 then 1 else least(4, 2 + (place - 301) // 200) end as round from o where place <= 900) select round::bigint as round, drawn, live, sum(live) over (order by round)::bigint as so_far from (select round, count(*) as drawn, count(*) filter (where live) as live from r group by round)")
def d11r(spark, d):
    """Rounds of a refill for a target of 100: the first draws three times as many groups, three more twice as many each. The draw is the feature."""
    live = F.coalesce(F.stddev_pop(F.when(~F.col("void"), F.col("reward"))) >= 1e-4, F.lit(False))
    g = rollouts(spark, d).groupBy("grp").agg(F.min("task_id").alias("arrived"), live.alias("live")).orderBy(F.md5("arrived"), "arrived").limit(900)
    g = g.withColumn("place", F.row_number().over(Window.orderBy(F.md5("arrived"), "arrived")))  # at most 900 rows
    g = g.withColumn("round", F.when(F.col("place") <= 300, 1).otherwise(F.least(F.lit(4), 2 + F.floor((F.col("place") - 301) / 200))).cast("long"))
    r = g.groupBy("round").agg(F.count("*").alias("drawn"), F.count_if("live").alias("live"))
    return r.withColumn("so_far", F.sum("live").over(Window.orderBy("round")))


@query("d13_every_nth", f"with {TK}, c as (select count(*) as n from tk), x as (select task_id, row_number() over (order by task_id) as place from tk) select task_id from x, c where (place - 1) % greatest(1, n // 40) = 0")
def d13n(spark, d):
    """Every n-th task in the order of ids, for about forty; places come from ranges of ids, not from one sorted task."""
    from millrace.plans.reports import d14

    n = tasks(spark, d, "seed").count()
    return d14(spark, d).filter((F.col("place") - 1) % max(1, n // 40) == 0).select("task_id")


@query("d17_hash_order", f"with {TK} select difficulty, list(task_id order by sha1(task_id), task_id)[1:5]::varchar as first_five from tk group by 1")
def d17(spark, d):
    """The first of each group in the order of a hash; every task keeps five of each group before anything is shuffled."""
    from millrace.operators.curate import first_k

    f = first_k(tasks(spark, d, "difficulty"), ["difficulty"], [F.sha1("task_id"), F.col("task_id")], 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "task_id"))), lambda x: x["task_id"])
    return f.groupBy("difficulty").agg(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("first_five"))


_KEY = {"person_city": "birthplace", "country_city": "capital", "city_country": "country", "person_employer": "employer", "org_city": "seat", "work_author": "author"}
_KW = "coalesce([" + ", ".join(f"'{v}'" for v in _KEY.values()) + "][list_position([" + ", ".join(f"'{k}'" for k in _KEY) + "], route[i])], route[i])"


@query("g01_oracle_plan", f"with {TK} select task_id, array_to_string([chain[i] || ' ' || {_KW} for i in generate_series(1, len(route))] || [coalesce(chain[len(route) + 1], '') || ' ' || split_part(oracle_plan[-1].arguments.query, ' ', -1)], ' | ') as plan, len(route) + 1 as steps from tk where len(route) > 0 and len(chain) > len(route) and len(oracle_plan) > 0")
def g01p(spark, d):
    """The searches of a route: one per relation from the name before it, and the terminal read."""
    t = tasks(spark, d, "route", "chain", "oracle_plan").filter((F.size("route") > 0) & (F.size("chain") > F.size("route")) & (F.size("oracle_plan") > 0))
    word = F.create_map(*[F.lit(x) for kv in _KEY.items() for x in kv])
    walk = F.transform("route", lambda r, i: F.concat(F.get("chain", i), F.lit(" "), F.coalesce(word[r], r)))
    last = F.concat(F.coalesce(F.get("chain", F.size("route")), F.lit("")), F.lit(" "), F.substring_index(F.element_at("oracle_plan", -1)["arguments"]["query"], " ", -1))
    return t.select("task_id", F.array_join(F.concat(walk, F.array(last)), " | ").alias("plan"), (F.size("route") + 1).alias("steps"))


_G08 = f"""{_STEPS}, cp as (select tk.task_id as world, {_FORMS} as forms, [{norm("coalesce(x.title, '') || ' ' || coalesce(x.text, '')")} for x in documents] as blobs, len([1 for s in oracle_plan if coalesce(s.arguments.query, '') = '']) = 0 as plan_executable, gold.kind = 'none' as skipped from tk where len(documents) > 0),
  s as (select world, any_value(task_type) as task_type, bool_or(hit) as in_plan, coalesce(bool_or(hit) filter (where pos = n - 1), false) as in_last_call, min(pos) filter (where hit) as first_hit_call, count(*) as num_calls from steps group by 1),
  ff as (select s.*, len([1 for b in blobs if len([1 for f in forms if contains(b, f)]) > 0]) > 0 as answer_in_corpus, plan_executable, skipped from s join cp using (world))"""


def sufficiency(spark, d):
    """g08 with the corpus: tasks with their own documents are retrievable if a document holds the answer."""
    t = tasks(spark, d, "gold", "oracle_plan", "documents").filter(F.size("documents") > 0)
    forms = F.filter(F.transform(gold_forms(F.col("gold.kind"), F.col("gold.value")), norm_text), lambda x: x != "")
    said = F.transform("documents", lambda x: norm_text(F.concat(F.coalesce(x["title"], F.lit("")), F.lit(" "), F.coalesce(x["text"], F.lit("")))))
    c = t.select(
        F.col("task_id").alias("world"), F.exists(said, lambda b: F.exists(forms, lambda f: F.contains(b, f))).alias("answer_in_corpus"),
        F.forall("oracle_plan", lambda s: F.coalesce(s["arguments"]["query"], F.lit("")) != "").alias("plan_executable"), (F.col("gold.kind") == "none").alias("skipped"),
    )
    s = plan_hits(spark, d).groupBy("world").agg(
        F.first("task_type").alias("task_type"), F.bool_or("hit").alias("in_plan"), F.coalesce(F.bool_or(F.when(F.col("pos") == F.col("n") - 1, F.col("hit"))), F.lit(False)).alias("in_last_call"), F.min(F.when(F.col("hit"), F.col("pos"))).alias("first_hit_call"), F.count("*").alias("num_calls"),
    )
    return s.join(c, "world")


@query("g08_sufficiency_full", f"with {_G08} select world, task_type, answer_in_corpus as retrievable, in_plan, in_last_call, first_hit_call, num_calls, plan_executable, skipped from ff")
def g08f(spark, d):
    return sufficiency(spark, d).select("world", "task_type", F.col("answer_in_corpus").alias("retrievable"), "in_plan", "in_last_call", "first_hit_call", "num_calls", "plan_executable", "skipped")


@query("g09_by_source", f"with {_G08}, a as (select task_type, 'real' as source, answer_in_corpus, in_last_call from ff where not coalesce(skipped, false)) select task_type, source, cast(grouping(task_type) as integer) as g_type, cast(grouping(source) as integer) as g_source, count(*) as n, round(avg(answer_in_corpus::int), 4) as retrievable_rate, round(avg(in_last_call::int), 4) as last_call_rate from a group by grouping sets ((), (task_type), (source))")
def g09s(spark, d):
    a = sufficiency(spark, d).filter(~F.coalesce("skipped", F.lit(False))).withColumn("source", F.lit("real"))
    return a.groupingSets([[], ["task_type"], ["source"]], "task_type", "source").agg(
        F.grouping("task_type").cast("int").alias("g_type"), F.grouping("source").cast("int").alias("g_source"), F.count("*").alias("n"), F.round(F.avg(F.col("answer_in_corpus").cast("int")), 4).alias("retrievable_rate"), F.round(F.avg(F.col("in_last_call").cast("int")), 4).alias("last_call_rate"),
    )


@query("g09_failures", f"with {_G08} select world, task_type from ff where not answer_in_corpus order by world limit 20")
def g09f(spark, d):
    """The first twenty failures; the limit is the report."""
    return sufficiency(spark, d).filter("not answer_in_corpus").orderBy("world").limit(20).select("world", "task_type")


@query("g16_capacity_vocab", f"with {TK}, r as (select len(route) as hops, array_to_string(route, '>') as route, chain[1] as head, split_part(oracle_plan[-1].arguments.query, ' ', -1) as attribute from tk where len(route) > 0 and len(oracle_plan) > 0), k as (select hops, route, count(distinct head) as heads, count(distinct attribute) as attributes from r group by 1, 2) select hops, sum(heads * attributes)::bigint as capacity, min(heads * attributes)::bigint as least from k group by 1")
def g16v(spark, d):
    """Questions that a length of route could ask: the names its heads may take times the attributes its last search may read."""
    t = tasks(spark, d, "route", "chain", "oracle_plan").filter((F.size("route") > 0) & (F.size("oracle_plan") > 0))
    k = t.groupBy(F.size("route").alias("hops"), F.array_join("route", ">").alias("r")).agg(F.countDistinct(F.get("chain", F.lit(0))).alias("heads"), F.countDistinct(F.substring_index(F.element_at("oracle_plan", -1)["arguments"]["query"], " ", -1)).alias("attributes"))
    return k.groupBy("hops").agg(F.sum(F.col("heads") * F.col("attributes")).alias("capacity"), F.min(F.col("heads") * F.col("attributes")).alias("least"))


@query("j02_walk_no_revisit", "select s_suppkey, a.n_name || '>' || r_name || '>' || b.n_name as walk from supplier join nation a on s_nationkey = a.n_nationkey join region on a.n_regionkey = r_regionkey join nation b on b.n_regionkey = r_regionkey where b.n_nationkey <> a.n_nationkey")
def j02w(spark, d):
    """From a supplier along nation and region to a nation again, kinds checked by the tables joined, no entity twice."""
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    at = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array("n_name").alias("walk"), "n_regionkey")
    at = at.join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.array_append("walk", F.col("r_name")).alias("walk"), "r_regionkey")
    at = at.join(n, F.col("r_regionkey") == F.col("n_regionkey")).filter(~F.array_contains("walk", F.col("n_name")))
    return at.select("s_suppkey", F.array_join(F.array_append("walk", F.col("n_name")), ">").alias("walk"))


# Derived columns
@query("pr03_task_columns", f"with {TK} select task_id, case when len(coalesce(documents, [])) > 0 then 'real' else 'synthetic' end as source, coalesce(task_type <> 'no_tool', true) as needs_tool from tk")
def pr03(spark, d):
    return tasks(spark, d, "documents", "task_type").select("task_id", F.when(F.coalesce(F.size("documents"), F.lit(0)) > 0, "real").otherwise("synthetic").alias("source"), F.coalesce(F.col("task_type") != "no_tool", F.lit(True)).alias("needs_tool"))


@query("pr08_trajectory_columns", f"with {TR} select task_id, coalesce(len(call_log), 0) as num_calls, array_to_string(list_sort(list_distinct([c.name for c in call_log])), ',') as tools, coalesce(stop_reason = 'empty_turn', false) as void, coalesce(len([1 for c in call_log if {_empty('c.result')}]), 0) as empty_results from tr where call_log is not null")
def pr08(spark, d):
    t = trajectories(spark, d, "call_log", "stop_reason").filter("call_log is not null")
    return t.select("task_id", F.size("call_log").alias("num_calls"), F.array_join(F.array_sort(F.array_distinct(F.transform("call_log", lambda c: c["name"]))), ",").alias("tools"), F.coalesce(F.col("stop_reason") == "empty_turn", F.lit(False)).alias("void"), F.size(F.filter("call_log", lambda c: empty_retrieval(c["result"]))).alias("empty_results"))


# Sources
@query("s01_jsonl_scan", "select task_type, count(*) as n, sum(len(route))::bigint as hops from task group by 1")
def s01(spark, d):
    """Tasks as JSON lines in two files with blank lines between, scanned as one typed table."""
    t, at = table(spark, d, "task").drop("loaded_at"), f"{shared_dir(spark)}/lines"
    line = t.select(F.to_json(F.struct(*t.columns)).alias("value"), (F.col("seed") % 2).alias("h"))
    for h in (0, 1):
        line.filter((F.pmod("h", F.lit(2)) == h) | (F.lit(h == 0) & F.col("h").isNull())).select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(f"{at}/{h}")
    return read_jsonl(spark, [f"{at}/0", f"{at}/1"], TASK).groupBy("task_type").agg(F.count("*").alias("n"), F.sum(F.size("route")).alias("hops"))


@query("s13_naturalised_cache", "select source as world, cast(doc_id as varchar) as doc_id, md5(text) as text_md5 from documents where source is not null and source <> '' and text <> ''")
def s13c(spark, d):
    """Texts from a cache of JSON maps, keyed ``world:doc_id`` and cut at the last colon; empty texts are no entry."""
    doc = table(spark, d, "documents", "doc_id", "source", "text").filter("source is not null and source <> ''")
    line = doc.select(F.to_json(F.create_map(F.concat_ws(":", "source", F.col("doc_id").cast("string")), F.coalesce("text", F.lit("")))).alias("value"))
    m = line.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "text")).filter("text <> ''")
    return m.select(F.regexp_extract("k", "(?s)^(.*):([^:]*)$", 1).alias("world"), F.regexp_extract("k", "(?s)^(.*):([^:]*)$", 2).alias("doc_id"), F.md5("text").alias("text_md5"))


@query("s17_append_log", "select id as key, answer as record from judge_row where answer is not null")
def s17l(spark, d):
    """An append-only log with a header, keys written twice and its last line cut short: the later record of a key stands."""
    j, at = table(spark, d, "judge_row", "id", "answer").filter("answer is not null"), f"{shared_dir(spark)}/log"
    body = j.select(F.explode(F.array(F.struct(F.lit(1).alias("o"), F.to_json(F.struct(F.col("id").alias("key"), F.lit("old").alias("answer"))).alias("value")), F.struct(F.lit(2).alias("o"), F.to_json(F.struct(F.col("id").alias("key"), "answer")).alias("value")))).alias("x")).select("x.*")
    ends = spark.createDataFrame([(0, '{"header": 1}'), (3, '{"key": "cut", "ans')], "o int, value string")
    body.unionAll(ends).coalesce(1).sortWithinPartitions("o").select("value").write.text(at)
    return read_cache(spark, at, "key").select("key", F.get_json_object("record", "$.answer").alias("record"))


@query("s20_rollout_dump", f"with {TR}, s as (select task_id, stop_reason, loaded_at::date as day, [case when length(s.assistant_text) > 400 then s.assistant_text[1:380] || '... [+' || (length(s.assistant_text) - 380) || ' chars]' else s.assistant_text end for s in steps] as turns from tr), r as (select *, row_number() over (partition by day order by task_id) as rank from s) select cast(day as varchar) as step, task_id, stop_reason, md5(array_to_string(turns, '|')) as turns_md5 from r where rank <= 3")
def s20d(spark, d):
    """The first records of each step (a day of loading), their turns clipped to 400 characters; how many is the feature."""
    from millrace.operators.curate import first_k

    t = trajectories(spark, d, "stop_reason", "steps").withColumn("step", F.to_date("loaded_at").cast("string"))
    t = first_k(t, ["step"], [F.col("task_id")], 3)
    return t.select("step", "task_id", "stop_reason", F.md5(F.array_join(F.transform("steps", lambda s: clip(s["assistant_text"], 400)), "|")).alias("turns_md5"))


@query("s22_kinds", "select kind, n * 200 as entities from (values " + ", ".join(f"('{k}', {n})" for k, n in KINDS) + ") t(kind, n)")
def s22k(spark, d):
    """Entities of 200 worlds by kind: each world has as many of a kind as the others."""
    return entities(spark, spark.range(200).withColumnRenamed("id", "seed")).groupBy("kind").agg(F.count("*").alias("entities"))


@query("st3_resumed_mint", "select id from judge_row where answer is null or hops = 2")
def st3(spark, d):
    """Jobs that a resumable log still lacks; a key whose record gave up (null) is not asked again."""
    j, at = table(spark, d, "judge_row", "id", "answer", "hops"), f"{shared_dir(spark)}/mint"
    done = j.filter("hops <> 2 and answer is not null").select(F.to_json(F.struct(F.col("id").alias("key"), "answer"), {"ignoreNullFields": "false"}).alias("value"))
    done.coalesce(1).write.text(at)
    return todo(j.select("id"), read_cache(spark, at, "key"), "id")


# Texts
@query("t05_gold_forms", f"with {TK} select task_id, array_to_string([f for f in {_SURFACE} if f is not null], '|') as forms from tk")
def t05(spark, d):
    return tasks(spark, d, "gold").select("task_id", F.array_join(gold_forms(F.col("gold.kind"), F.col("gold.value")), "|").alias("forms"))


@query("t10_teacher_caps", f"with {TR} select task_id, array_to_string([w for w in regexp_extract_all(coalesce(final_answer, ''), '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({STOPS_SQL}, {_OPEN}) and not contains(lower(coalesce(prompt, '')), lower(w))], ' ') as names from tr")
def t10(spark, d):
    return trajectories(spark, d, "final_answer", "prompt").select("task_id", F.array_join(invented_names(F.col("final_answer"), F.col("prompt"), tuple(OPENERS)), " ").alias("names"))


_OPENS = "case when contains(t, '<tool_call>') then '</tool_call>' when contains(t, '<final_answer>') then '</final_answer>' end"


@query("t23_reattach", f"with {_ST}, o as (select *, {_OPENS} as stop from st where t is not null) select task_id, step, md5(case when stop is not null and not contains(t, stop) then t || stop else t end) as turn_md5 from o")
def t23r(spark, d):
    """A turn whose generation ended before the stop string that its tag calls for gets it back."""
    stop = F.when(F.contains("t", F.lit("<tool_call>")), "</tool_call>").when(F.contains("t", F.lit("<final_answer>")), "</final_answer>")
    o = turns(spark, d).filter("t is not null").withColumn("stop", stop)
    return o.select("task_id", "step", F.md5(F.when(F.col("stop").isNotNull() & ~F.contains("t", F.col("stop")), F.concat("t", "stop")).otherwise(F.col("t"))).alias("turn_md5"))


@query("t26_chatml_merged", f"with {MS}, tl as (select record_id, tools from re), l as (select *, case when role = 'tool' and lag(role) over (partition by record_id order by pos) = 'tool' then 0 else 1 end as new from ms), i as (select *, sum(new) over (partition by record_id order by pos) as island from l), b as (select record_id, island, case when any_value(role) = 'tool' then 'user' else any_value(role) end as role, string_agg(case when role = 'tool' then '<tool_response>' || content || '</tool_response>' else content end, chr(10) order by pos) as body, min(pos) as pos from i group by 1, 2), s as (select b.record_id, b.pos, '<|im_start|>' || role || chr(10) || body || case when role = 'system' and len(tools) > 0 then chr(10) || '<tools>' || array_to_string(tools, chr(10)) || '</tools>' else '' end || '<|im_end|>' as part from b join tl on tl.record_id = b.record_id) select record_id, md5(string_agg(part, chr(10) order by pos)) as rendered_md5 from s group by 1")
def t26m(spark, d):
    """The rendering with the tools in the system turn and consecutive results merged into one user turn, folded over the messages in order."""
    from millrace.plans.base import records

    r = records(spark, d, "messages", "tools").filter(F.size("messages") > 0)
    acc = lambda out, last: F.struct(out.alias("out"), last.alias("last"))

    def step(a, m):
        role, text = m["role"], F.coalesce(m["content"], F.lit(""))
        shown = F.when(role == "tool", F.concat(F.lit("<tool_response>"), text, F.lit("</tool_response>"))).otherwise(text)
        tools = F.when((role == "system") & (F.size("tools") > 0), F.concat(F.lit("\n<tools>"), F.array_join("tools", "\n"), F.lit("</tools>"))).otherwise("")
        more = (role == "tool") & (a["last"] == "tool")
        head = F.concat(F.when(a["out"] == "", "").otherwise("<|im_end|>\n"), F.lit("<|im_start|>"), F.when(role == "tool", "user").otherwise(role), F.lit("\n"))
        return acc(F.concat(a["out"], F.when(more, F.lit("\n")).otherwise(head), shown, tools), role)

    out = F.aggregate("messages", acc(F.lit(""), F.lit("")), step, lambda a: F.concat(a["out"], F.lit("<|im_end|>")))
    return r.select("record_id", F.md5(out).alias("rendered_md5"))


def token_spans(m, tokens):
    """m (record_id, pos, role, content) with start and stop of every message in tokens; ``tokens`` maps a text column to their number."""
    n = m.withColumn("k", tokens(F.col("content")))
    n = n.withColumn("stop", F.sum("k").over(_rw()))
    return n.select("record_id", "pos", "role", (F.col("stop") - F.col("k")).alias("start"), "stop")


@query("t27_token_spans", f"with {MS}, k as (select *, len(regexp_extract_all(content, '[^ \\t\\n\\r\\f]+')) as k from ms), s as (select *, (sum(k) over (partition by record_id order by pos))::bigint as stop from k) select record_id, pos, (stop - k)::bigint as start, stop from s where role = 'assistant'")
def t27t(spark, d):
    return token_spans(messages(spark, d), lambda c: F.size(F.regexp_extract_all(c, F.lit(r"([^ \t\n\r\f]+)"), F.lit(1))).cast("long")).filter("role = 'assistant'").drop("role")


_SEEN = f"{TR}, st as (select task_id, prompt, generate_subscripts(steps, 1) - 1 as step, unnest(steps) as s from tr), r as (select task_id, step, coalesce(regexp_extract(s.assistant_text, '<think>(.*?)</think>', 1, 's'), '') as b, {norm('prompt')} as asked, {norm("array_to_string(s.tool_results, ' ')")} as shown from st), w as (select *, asked || ' ' || coalesce(string_agg(shown, ' ' order by step) over (partition by task_id order by step rows between unbounded preceding and 1 preceding), '') as seen from r)"


@query("t41_seen", f"with {_SEEN} select task_id, step, case when trim(b, ' ') = '' then 'empty' when len([w for w in regexp_extract_all(b, '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({STOPS_SQL}, {_OPEN}) and not contains(seen, lower(w))]) > 0 then 'psychic_name' when len([n for n in regexp_extract_all(b, '\\d[\\d,]*') if {norm('n')} <> '' and not contains(seen, {norm('n')})]) > 0 then 'psychic_number' end as violation from w")
def t41s(spark, d):
    """Names and numbers of a block against the question and all that was shown before it."""
    s = trajectories(spark, d, "prompt", "steps").select("task_id", "prompt", F.posexplode("steps").alias("step", "s"))
    before = Window.partitionBy("task_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("b", F.coalesce(F.regexp_extract("s.assistant_text", r"(?s)<think>(.*?)</think>", 1), F.lit(""))).withColumn("shown", norm_text(F.array_join("s.tool_results", " ")))
    s = s.withColumn("seen", F.concat(norm_text(F.col("prompt")), F.lit(" "), F.array_join(F.collect_list("shown").over(before), " ")))
    bad = F.size(invented_names(F.col("b"), F.col("seen"), tuple(OPENERS))) > 0
    return s.select("task_id", "step", F.when(F.trim("b") == "", "empty").when(bad, "psychic_name").when(F.size(unseen_numbers(F.col("b"), F.col("seen"))) > 0, "psychic_number").alias("violation"))


@query("t50_line_hash", "select sha1(string_agg(id || chr(9) || answer, chr(10) order by id))[1:16] as fingerprint from judge_row where answer is not null")
def t50(spark, d):
    """The short hash of a small file's lines in order."""
    j = table(spark, d, "judge_row", "id", "answer").filter("answer is not null").select(F.struct("id", F.concat("id", F.lit("\t"), "answer").alias("l")).alias("x"))
    return j.agg(F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")), 1, 16).alias("fingerprint"))


@query("t53_percent_report", f"with {CA}, c as (select coalesce(task_type, '-') as k, avg(success::int) as r, count(*) as n from ca group by 1) select rpad(k, 24, ' ') || lpad(cast(cast(round(100 * coalesce(r, 0), 1) as decimal(5, 1)) as varchar), 6, ' ') || '%' || lpad(cast(n as varchar), 8, ' ') as line from c")
def t53p(spark, d):
    c = cards(spark, d, "task_type", "success").groupBy(F.coalesce("task_type", F.lit("-")).alias("k")).agg(F.avg(F.col("success").cast("int")).alias("r"), F.count("*").alias("n"))
    share = F.round(100 * F.coalesce("r", F.lit(0.0)), 1).cast("decimal(5,1)").cast("string")
    return c.select(F.concat(F.rpad("k", 24, " "), F.lpad(share, 6, " "), F.lit("%"), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))


# Windows of a run
_PX = f"with {_LOG}, {RO.split(', ro as', 1)[0]}, ro as{RO.split(', ro as', 1)[1]}, px as (select task_id, split_part(task_id, '#', 1) as grp, idx, md5(string_agg(name || ':' || coalesce(args, ''), '|' order by idx) over (partition by task_id order by idx rows unbounded preceding)) as prefix from lg), j as (select px.*, reward from px join ro using (task_id)), k as (select *, count(*) over (partition by grp, prefix) as members, avg(reward) over (partition by grp, prefix) as mean, stddev_pop(reward) over (partition by grp, prefix) as sd from j)"


@query("w05_turn_adv", f"{_PX} select task_id, idx, round(case when members >= 2 and sd >= 1e-4 then 0.5 * (reward - mean) / (sd + 1e-4) else 0 end, 4) + 0.0 as micro from k")
def w05t(spark, d):
    """The step advantage: omega times the scaled advantage among the rollouts that have made the same calls so far; counts, means and spreads by prefix first."""
    w = Window.partitionBy("task_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sig = F.concat("name", F.lit(":"), F.coalesce("args", F.lit("")))
    p = calls(spark, d).withColumn("prefix", F.md5(F.array_join(F.collect_list(sig).over(w), "|"))).select("task_id", "idx", "prefix").join(rollouts(spark, d).select("task_id", "grp", "reward"), "task_id")
    g = p.groupBy("grp", "prefix").agg(F.count("*").alias("members"), F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("sd"))
    p = p.join(g, ["grp", "prefix"])
    return p.select("task_id", "idx", (F.round(F.when((F.col("members") >= 2) & (F.col("sd") >= 1e-4), 0.5 * (F.col("reward") - F.col("mean")) / (F.col("sd") + 1e-4)).otherwise(0.0), 4) + F.lit(0.0)).alias("micro"))


@query("w06_liveness", f"with {RO}, s as (select ro.*, coalesce(num_steps, 0) as turns from ro join ca using (task_id)), g as (select grp, count(*) filter (where not void) as live, stddev_pop(reward) filter (where not void) as sd, coalesce(sum(turns) filter (where not void), 0) as turns from s group by 1) select grp, case when live = 0 then 'all_void' when live = 1 then 'void_singleton' when sd < 1e-4 then 'zero_variance' when turns = 0 then 'no_turn_advantage' end as dead_reason from g")
def w06l(spark, d):
    """Why a group carries no gradient; one whose rewards differ but that has no turn to credit has no turn advantage."""
    r = rollouts(spark, d).join(cards(spark, d, "num_steps").select("task_id", F.coalesce("num_steps", F.lit(0)).alias("turns")), "task_id")
    on = lambda c: F.when(~F.col("void"), c)
    g = r.groupBy("grp").agg(F.count(on(F.lit(1))).alias("live"), F.stddev_pop(on(F.col("reward"))).alias("sd"), F.coalesce(F.sum(on(F.col("turns"))), F.lit(0)).alias("turns"))
    return g.select("grp", F.when(F.col("live") == 0, "all_void").when(F.col("live") == 1, "void_singleton").when(F.col("sd") < 1e-4, "zero_variance").when(F.col("turns") == 0, "no_turn_advantage").alias("dead_reason"))


@query("w10_pullback", f"with {CA}, {_DAYS}, o as (select day, row_number() over (order by day) as step, count(*) over () as steps, avg(dead) over (order by day rows between 5 preceding and 1 preceding) as mean from days) select cast(day as varchar) as day, round(step / steps * (1 - case when coalesce(mean, 0) <= 0.5 then 0 else least(1, (mean - 0.5) / 0.5) end), 6)::double as fraction from o")
def w10p(spark, d):
    """How far along the curriculum a step is: pulled back by what the share of dead groups of the five steps before has over its threshold."""
    w = Window.orderBy("day")  # one row a day
    o = _days(spark, d).select("day", F.row_number().over(w).alias("step"), F.avg("dead").over(w.rowsBetween(-5, -1)).alias("mean"))
    n = o.agg(F.count("*")).scalar()
    back = F.when(F.coalesce("mean", F.lit(0.0)) <= 0.5, 0.0).otherwise(F.least(F.lit(1.0), (F.col("mean") - 0.5) / 0.5))
    return o.select(F.col("day").cast("string").alias("day"), F.round(F.col("step") / n * (1 - back), 6).alias("fraction"))


# Streaming state
@query("st2_guard_streamed", "select user_id, event_type, count(*) as calls, count(*) > 3 as guarded from events group by 1, 2")
def st2s(spark, d):
    """The repeat guard as streaming state: one counter a key, kept by the engine; the batch form is st2_guard_counter."""
    g = run_to_end(spark, f"{d}/events.parquet", lambda e: e.groupBy("user_id", "event_type").agg(F.count("*").alias("calls")), "complete")
    return g.withColumn("guarded", F.col("calls") > 3)


@query("st4_rolling_streamed", "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 4) as rolling from events")
def st4s(spark, d):
    """The mean of each user's last five events, the five kept as streaming state; the batch form is st4_rolling_state."""
    f = lambda e: e.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(last_five, "event_id bigint, rolling double", "last array<double>", "append", "NoTimeout")
    return run_to_end(spark, f"{d}/events.parquet", f, "append")
