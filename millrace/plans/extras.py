"""Block gates, quotas and caches over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import clip, invented_names, norm_text, unseen_numbers
from millrace.operators.curate import first_by_hash, hashed
from millrace.plans.audits import _ST, turns
from millrace.plans.base import RE, TK, TR, norm, records, tasks, trajectories
from millrace.plans.curation import _H
from millrace.plans.text import _STOPS as STOPS
from millrace.registry import query
from millrace.sources.tables import table

#: Further openers that a written block may use.
OPENERS = "now my step one so given since because both neither next first second third fourth looking here there also finally still only note if once each every no yes".split()
_OPEN = ", ".join(f"'{w}'" for w in OPENERS)
_B = f"{_ST}, bl as (select st.task_id, step, coalesce(regexp_extract(t, '<think>(.*?)</think>', 1, 's'), '') as b, prompt from st join tr using (task_id)), wd as (select *, [w for w in regexp_split_to_array(b, '[ \\t\\n\\r\\f]+') if w <> ''] as ws from bl)"


@query("t41_violations", f"""with {_B} select task_id, step, case when len(ws) = 0 then 'empty' when len(ws) > 80 then 'too_long' when regexp_matches(b, '[<>]') then 'markup'
    when len([w for w in regexp_extract_all(b, '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({STOPS}, {_OPEN}) and not contains(lower(coalesce(prompt, '')), lower(w))]) > 0 then 'psychic_name'
    when len([n for n in regexp_extract_all(b, '\\d[\\d,]*') if {norm('n')} <> '' and not contains({norm('prompt')}, {norm('n')})]) > 0 then 'psychic_number' end as violation from wd""")
def t41(spark, d):
    p = trajectories(spark, d, "prompt").select("task_id", "prompt")
    b = turns(spark, d).join(p, "task_id").withColumn("b", F.coalesce(F.regexp_extract("t", r"(?s)<think>(.*?)</think>", 1), F.lit("")))
    n = F.size(F.filter(F.split("b", r"[ \t\n\r\f]+"), lambda w: w != ""))
    label = (
        F.when(n == 0, "empty").when(n > 80, "too_long").when(F.col("b").rlike("[<>]"), "markup")
        .when(F.size(invented_names(F.col("b"), F.col("prompt"), tuple(OPENERS))) > 0, "psychic_name").when(F.size(unseen_numbers(F.col("b"), norm_text(F.col("prompt")))) > 0, "psychic_number")
    )
    return b.select("task_id", "step", label.alias("violation"))


_HITS = "from_json(json_extract(m.content, '$.results'), '[{\"doc_id\":\"VARCHAR\"}]')"


@query("pr13_distractors", f"with {RE}, m as (select record_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages) as m from re), h as (select record_id, pos, [coalesce(nullif(regexp_extract(trim(x.doc_id), '^(city|c|f|o|p|w)', 1), ''), '?') for x in {_HITS}] as kinds from m where m.role = 'tool' and m.content like '{{%') select record_id, pos, coalesce(len([k for k in kinds[2:] if k = kinds[1]]), 0) as distractors from h")
def p13(spark, d):
    m = records(spark, d, "messages").select("record_id", F.posexplode("messages").alias("pos", "m")).filter("m.role = 'tool' and m.content like '{%'")
    hits = F.from_json("m.content", "results array<struct<doc_id:string>>")["results"]
    kind = lambda x: F.coalesce(F.nullif(F.regexp_extract(F.trim(x["doc_id"]), "^(city|c|f|o|p|w)", 1), F.lit("")), F.lit("?"))
    m = m.select("record_id", "pos", F.transform(hits, kind).alias("kinds"))
    same = F.size(F.filter("kinds", lambda k: k == F.get("kinds", F.lit(0)))) - 1
    return m.select("record_id", "pos", F.greatest(F.lit(0), F.coalesce(same, F.lit(0))).alias("distractors"))


@query("s20_dump_preview", f"with {TR} select task_id, stop_reason, md5(case when length(final_answer) > 40 then final_answer[1:20] || '... [+' || (length(final_answer) - 20) || ' chars]' else final_answer end) as preview_md5, len(steps) as turns from tr")
def s20(spark, d):
    return trajectories(spark, d, "stop_reason", "final_answer", "steps").select("task_id", "stop_reason", F.md5(clip(F.col("final_answer"), 40)).alias("preview_md5"), F.size("steps").alias("turns"))


@query("s35_raw_passthrough", f"with {TK} select task_id, case when prompt like ' %' then trim(prompt, ' ') else prompt end as line, prompt like ' %' as changed from tk")
def s35(spark, d):
    changed = F.col("prompt").startswith(" ")
    return tasks(spark, d, "prompt").select("task_id", F.when(changed, F.trim("prompt")).otherwise(F.col("prompt")).alias("line"), changed.alias("changed"))


@query("d09_remix", f"with {TK}, s as (select difficulty, count(*) as n from tk where difficulty between 1 and 3 group by 1), w as (select difficulty, floor(0.3 * case difficulty when 1 then 0.5 when 2 then 0.3 else 0.2 end * (select sum(n) from s))::bigint + case when difficulty = 3 then (floor(0.3 * (select sum(n) from s)) - (select sum(floor(0.3 * case difficulty when 1 then 0.5 when 2 then 0.3 else 0.2 end * (select sum(n) from s))) from s))::bigint else 0 end as want from s), r as (select task_id, difficulty, row_number() over (partition by difficulty order by sha1(task_id), task_id) as rank from tk where difficulty between 1 and 3) select task_id, difficulty from r join w using (difficulty) where rank <= want")
def d09(spark, d):
    t = tasks(spark, d, "difficulty").filter("difficulty between 1 and 3")
    total = t.agg(F.count("*")).scalar()
    size = F.floor(total * 0.3)
    share = F.when(F.col("difficulty") == 1, 0.5).when(F.col("difficulty") == 2, 0.3).otherwise(0.2)
    # The largest key takes what rounding leaves.
    rest = size - F.floor(0.3 * 0.5 * total) - F.floor(0.3 * 0.3 * total) - F.floor(0.3 * 0.2 * total)
    want = F.floor(0.3 * share * total) + F.when(F.col("difficulty") == 3, rest).otherwise(0)
    return first_by_hash(t.withColumn("want", want), ["difficulty"], F.sha1("task_id"), "task_id", "want").select("task_id", "difficulty")


@query("g15_quota_per_hop", f"with {TK}, e as (select task_id, difficulty, row_number() over (partition by difficulty order by sha1(task_id), task_id) as rank, count(*) over (partition by difficulty) as n from tk where len(oracle_plan) > 1) select task_id, difficulty from e where rank <= round_even(0.25 * n, 0)")
def g15(spark, d):
    t = tasks(spark, d, "difficulty", "oracle_plan").filter(F.size("oracle_plan") > 1)
    n = t.groupBy(F.col("difficulty").alias("d2")).agg(F.count("*").alias("n"))
    t = t.join(n, F.col("difficulty").eqNullSafe(F.col("d2"))).withColumn("want", F.bround(F.col("n") * 0.25))
    return first_by_hash(t, ["difficulty"], F.sha1("task_id"), "task_id", "want").select("task_id", "difficulty")


@query("g16_capacity", f"with {TK}, r as (select array_to_string(route, '>') as route, count(distinct chain[1]) as heads, count(distinct oracle_answer) as answers, len(any_value(route)) as hops from tk where len(route) > 0 group by 1) select hops, sum(heads * answers)::bigint as capacity, count(*) as routes from r group by 1")
def g16(spark, d):
    t = tasks(spark, d, "route", "chain", "oracle_answer").filter(F.size("route") > 0)
    r = t.groupBy(F.array_join("route", ">").alias("r"), F.size("route").alias("hops")).agg(F.countDistinct(F.get("chain", F.lit(0))).alias("heads"), F.countDistinct("oracle_answer").alias("answers"))
    return r.groupBy("hops").agg(F.sum(F.col("heads") * F.col("answers")).alias("capacity"), F.count("*").alias("routes"))


@query("t34_hop_parse", "select id, coalesce(try_cast(nullif(regexp_extract(id, '^(\\d+)hop', 1), '') as integer), 1) as hops from judge_row")
def t34(spark, d):
    return table(spark, d, "judge_row", "id").select("id", F.coalesce(F.nullif(F.regexp_extract("id", r"^(\d+)hop", 1), F.lit("")).cast("int"), F.lit(1)).alias("hops"))


@query("t38_leaf_keyword", f"with {TK}, q as (select task_id, oracle_plan[-1].arguments.query as q, chain[len(oracle_plan)] as leaf from tk where len(oracle_plan) > 0) select task_id, case when starts_with(lower(q), lower(leaf)) then trim(q[length(leaf) + 1:], ' ') else q end as keyword from q")
def t38(spark, d):
    t = tasks(spark, d, "oracle_plan", "chain").filter(F.size("oracle_plan") > 0)
    t = t.select("task_id", F.element_at("oracle_plan", -1)["arguments"]["query"].alias("q"), F.get("chain", F.size("oracle_plan") - 1).alias("leaf"))
    return t.select("task_id", F.when(F.startswith(F.lower("q"), F.lower("leaf")), F.trim(F.substring(F.col("q"), F.length("leaf") + 1, F.length("q")))).otherwise(F.col("q")).alias("keyword"))


@query("t47_gold_answer", f"with {TK} select task_id, case gold.kind when 'any_of' then from_json(gold.value, '[\"varchar\"]')[1] when 'all_of' then array_to_string(from_json(gold.value, '[\"varchar\"]'), ', ') when 'none' then null else case when gold.value like '\"%\"' then gold.value[2:-2] else gold.value end end as answer from tk")
def t47(spark, d):
    many, kind = F.from_json("gold.value", "array<string>"), F.col("gold.kind")
    one = F.coalesce(F.nullif(F.regexp_extract("gold.value", r'^"(.*)"$', 1), F.lit("")), F.col("gold.value"))
    return tasks(spark, d, "gold").select("task_id", F.when(kind == "any_of", F.get(many, F.lit(0))).when(kind == "all_of", F.array_join(many, ", ")).when(kind == "none", None).otherwise(one).alias("answer"))


@query("t49_cache_keys", f"with {TR}, s as (select task_id, unnest(generate_series(0, len(steps) - 1)) as step from tr where len(steps) > 0) select task_id || '|' || step as key, 'b' || sha1(task_id || '|' || step)[1:30] as custom_id from s")
def t49(spark, d):
    k = trajectories(spark, d, "steps").filter(F.size("steps") > 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("steps") - 1), lambda i: F.concat("task_id", F.lit("|"), i.cast("string")))).alias("key"))
    return k.select("key", F.concat(F.lit("b"), F.substring(F.sha1("key"), 1, 30)).alias("custom_id"))


@query("t53_report_lines", f"with {TK}, c as (select coalesce(task_type, '-') as k, count(*) as n from tk group by 1) select rpad(k, 24, ' ') || lpad(cast(n as varchar), 8, ' ') as line from c")
def t53(spark, d):
    c = tasks(spark, d, "task_type").groupBy(F.coalesce("task_type", F.lit("-")).alias("k")).agg(F.count("*").alias("n"))
    return c.select(F.concat(F.rpad("k", 24, " "), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))


@query("pr17_checkpoint_accept", "with o as (select o_custkey, o_orderkey, o_totalprice, max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as best from orders) select o_custkey, count(*) filter (where best is null or o_totalprice > best) as accepted from o group by 1")
def p17(spark, d):
    best = F.max("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("best", best)
    return o.groupBy("o_custkey").agg(F.count(F.when(F.col("best").isNull() | (F.col("o_totalprice") > F.col("best")), 1)).alias("accepted"))


@query("d10_step_mix", f"with {TK}, c as (select count(*) as n from tk), k as (select least(64, n)::bigint as size, round_even(least(64, n) * 0.25, 0)::bigint as r from c), x as (select task_id, len(documents) > 0 as is_real, row_number() over (partition by len(documents) > 0 order by {_H('step', 'task_id')}, task_id) as rank from tk) select task_id, is_real from x, k where rank <= case when is_real then r else size - r end")
def d10(spark, d):
    t = tasks(spark, d, "documents").select("task_id", (F.size("documents") > 0).alias("is_real"))
    size = F.least(F.lit(64), t.agg(F.count("*")).scalar())
    real = F.bround(size * 0.25)
    return first_by_hash(t.withColumn("want", F.when(F.col("is_real"), real).otherwise(size - real)), ["is_real"], hashed("step", F.col("task_id")), "task_id", "want").select("task_id", "is_real")
