"""Sources, caches, lookups and gates over sets of tasks and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.labels import mended_family
from millrace.functions.text import norm_text
from millrace.operators.curate import first_k
from millrace.operators.retrieval import search
from millrace.plans.base import CA, RE, TK, TR, cards, norm, records, tasks, trajectories
from millrace.plans.episodes import MS, messages
from millrace.plans.retrieval import _STEPS, _SUFF, _TP, _bm25_sql, plan_hits, task_world
from millrace.plans.rl import RO, _DEAD, rollouts, w06
from millrace.registry import query
from millrace.session import shared_dir
from millrace.sources import sinks
from millrace.sources.tables import table
from millrace.sources.worlds import _HEADS, _TAILS, entities

FAMILIES = ["musique_2hop", "musique_3hop", "musique_4hop", "unanswerable", "no_tool"]


# Sources and sinks
@query("s02_raw_roundtrip", f"with {TR} select task_id, stop_reason, len(steps) as steps, final_answer from tr")
def s02(spark, d):
    """Raw records written as JSON lines and scanned again with their schema."""
    t, at = trajectories(spark, d, "stop_reason", "final_answer", "steps"), f"{shared_dir(spark)}/raw"
    sinks.dump(t, at)
    return spark.read.schema(t.schema).json(at).select("task_id", "stop_reason", F.size("steps").alias("steps"), "final_answer")


@query("s04_task_sink", f"with {TK} select task_type, count(*) as n from tk group by 1")
def s04(spark, d):
    """Tasks written as JSON lines, once each, and the histogram of what the file holds."""
    t, at = tasks(spark, d, "task_type", "prompt", "gold", "route"), f"{shared_dir(spark)}/tasks"
    sinks.dump(t, at)
    return spark.read.schema(t.schema).json(at).groupBy("task_type").agg(F.count("*").alias("n"))


@query("s05_export", f"with {TR}, k as (select task_id, len([1 for s in steps if len(s.tool_calls) = 0]) as answers, len([1 for s in steps if len(s.tool_calls) > 0]) as calls, steps[-1] as last, final_answer from tr) select (calls + answers)::integer as turns, count(*) as n from k where calls + answers > 0 and len(last.tool_calls) = 0 and (answers = 0 or final_answer is not null) group by 1")
def s05(spark, d):
    """Trajectories as training records: a turn a step, those that end on a tool result or answer nothing left out; histogram of turns."""
    t = trajectories(spark, d, "steps", "final_answer").filter(F.size("steps") > 0)
    calls = lambda s: F.coalesce(F.size(s["tool_calls"]), F.lit(0)) > 0
    ok = ~calls(F.element_at("steps", -1)) & F.col("final_answer").isNotNull()
    return t.filter(ok).groupBy(F.size("steps").alias("turns")).agg(F.count("*").alias("n"))


@query("s06_run_files", f"with {CA}, {TR} select 'report.json' as file, count(*) as n from (select distinct task_type from ca) union all select 'report.txt', count(*) from (select distinct task_type from ca) union all select 'scores.jsonl', count(*) from ca union all select 'trajectories.jsonl', count(*) from tr")
def s06(spark, d):
    c = cards(spark, d, "task_type", "success", "final_f1")
    at = sinks.save_run(c.groupBy("task_type").agg(F.count("*").alias("n")), c, trajectories(spark, d, "stop_reason", "final_answer"), shared_dir(spark))
    counts = [spark.read.text(p).agg(F.lit(k).alias("file"), F.count("*").alias("n")) for k, p in sorted(at.items())]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query("s12_real_pool", f"with {TK} select task_id, len(documents) as passages from tk where len(documents) > 0")
def s12(spark, d):
    """The pool of tasks with their own documents; an empty pool is an error."""
    pool = tasks(spark, d, "documents").filter(F.size("documents") > 0).select("task_id", F.size("documents").alias("passages"))
    if not pool.limit(1).count():
        raise ValueError("no task has documents")
    return pool


@query("s14_cache_todo", f"with {TK} select task_id, len(documents) as passages from tk where len(documents) > 0 and coalesce(notes, '') = ''")
def s14(spark, d):
    """What an incremental cache still lacks: the cache is written as one JSON object, read back, and the tasks it has are left out."""
    t, at = tasks(spark, d, "notes", "documents"), f"{shared_dir(spark)}/cache"
    real = t.filter(F.size("documents") > 0)
    sinks.put_object(spark, real.filter("notes <> ''").select(F.col("task_id").alias("key"), F.col("notes").alias("value")), at)
    return real.join(sinks.read_object(spark, at).select(F.col("key").alias("task_id")), "task_id", "left_anti").select("task_id", F.size("documents").alias("passages"))


@query("s16_object_cache", "select id as key, answer as value from judge_row where answer is not null")
def s16(spark, d):
    at = f"{shared_dir(spark)}/object"
    sinks.put_object(spark, table(spark, d, "judge_row", F.col("id").alias("key"), F.col("answer").alias("value")).filter("value is not null"), at)
    return sinks.read_object(spark, at)


@query("s18_any_cache", "select id as key, answer as value, form from judge_row, (values ('object'), ('lines')) f(form) where answer is not null")
def s18(spark, d):
    """The same cache in both forms, read by one reader."""
    j, at = table(spark, d, "judge_row", F.col("id").alias("key"), F.col("answer").alias("value")).filter("value is not null"), shared_dir(spark)
    sinks.put_object(spark, j, f"{at}/object")
    j.write.json(f"{at}/lines")
    one = lambda form: sinks.read_any_cache(spark, f"{at}/{form}", "key", "value").withColumn("form", F.lit(form))
    return one("object").unionByName(one("lines"))


_DAY = "select cast(date_trunc('day', loaded_at)::date as varchar) as day, datediff('day', date '2025-01-01', loaded_at::date) as step, count(*) as n from ca group by 1, 2"


@query("s19_resumed_history", f"with {CA}, h as ({_DAY}), c as (select quantile_disc(step, 0.5) as cut from h) select day, n, step <= cut as kept from h, c")
def s19(spark, d):
    """A history of days cut back to a checkpoint in its middle, then continued."""
    h = cards(spark, d, "task_type").groupBy(F.to_date("loaded_at").alias("d")).agg(F.count("*").alias("n"))
    h = h.select(F.col("d").cast("string").alias("day"), F.datediff("d", F.lit("2025-01-01").cast("date")).alias("step"), "n")
    cut = h.agg(F.expr("percentile_disc(0.5) within group (order by step)").cast("int")).first()[0]
    return sinks.resumed(h.withColumn("kept", F.lit(True)), "step", cut, h.withColumn("kept", F.lit(False))).select("day", "n", "kept")


_CFG = {"d": {"split": "dev", "n": "50", "seed": "7", "top_k": "3"}, "g": {"n": "200", "seed": None, "env": "builtin"}, "f": {"n": None, "top_k": "5"}}


@query("s21_frozen_config", "select * from (values ('env', 'builtin'), ('n', '200'), ('seed', '7'), ('split', 'dev'), ('top_k', '5')) t(key, value)")
def s21(spark, d):
    return sinks.overlaid(*[spark.createDataFrame(list(x.items()), "key string, value string") for x in _CFG.values()])


_TPL = ["{name} keeps an account of {value} marks.", "An account of {value} marks belongs to {name}.", "The books show {value} marks for {name}."]


@query("s24_passages", "select c_custkey, replace(replace([" + ", ".join(f"'{t}'" for t in _TPL) + "][('0x' || md5(cast(c_custkey as varchar))[1:2])::bigint % 3 + 1], '{name}', c_name), '{value}', format('{:,}', cast(floor(abs(c_acctbal)) as bigint))) as passage from customer")
def s24(spark, d):
    """A passage for each entity, its template chosen by the hash of its id; names verbatim, numbers with separators."""
    pick = (F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 2), 16, 10).cast("int") % 3 + 1).cast("int")
    text = F.element_at(F.array(*[F.lit(t) for t in _TPL]), pick)
    value = F.format_number(F.floor(F.abs("c_acctbal")), 0)
    return table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").select("c_custkey", F.replace(F.replace(text, F.lit("{name}"), F.col("c_name")), F.lit("{value}"), value).alias("passage"))


@query("s25_world_selection", f"with {TK} select task_id, len(documents) > 0 as own, case when len(documents) > 0 then len(documents) else 38 end as passages from tk")
def s25(spark, d):
    """The passages that a task may search: its own documents, else those of the world of its seed."""
    t = tasks(spark, d, "seed", "documents").withColumn("own", F.coalesce(F.size("documents") > 0, F.lit(False)))
    made = t.filter("not own").select("task_id", "own", "seed")
    world = entities(spark, made.select("seed")).groupBy("seed").agg(F.count("*").alias("passages"))
    return t.filter("own").select("task_id", "own", F.size("documents").cast("long").alias("passages")).unionAll(made.join(world, "seed").select("task_id", "own", "passages"))


@query("s26_legacy_names", "select unnest([" + ", ".join(f"'{x}'" for x in _HEADS[:8]) + "]) as name, unnest(generate_series(1, 8))::integer as place")
def s26(spark, d):
    """The names that an earlier vocabulary had: the first of each pool, in order."""
    pool = spark.createDataFrame(list(enumerate(_HEADS, 1)), "place int, name string")
    return pool.filter("place <= 8").select("name", "place")


@query("s23_unique_names")
def s23(spark, d):
    """Names of the worlds of 200 seeds: 38 a seed, no two alike within it."""
    e = entities(spark, spark.range(200).withColumnRenamed("id", "seed"))
    return e.groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("s29_bank", "select 'sum' as kind, i || ' + ' || j as question, cast(i + j as varchar) as answer from generate_series(2, 11) a(i), generate_series(3, 8) b(j) union all select 'binary', cast(i as varchar) || ' in binary', bin(i) from generate_series(2, 41) a(i) union all select 'letters', 'letters of ' || n, cast(length(n) as varchar) from (select unnest([" + ", ".join(f"'{h}{t}'" for h, t in zip(_HEADS, _TAILS)) + "]) as n)")
def s29(spark, d):
    """Questions that need no tool, with their answers."""
    i, j = spark.range(2, 12).withColumnRenamed("id", "i"), F.explode(F.sequence(F.lit(3), F.lit(8)))
    sums = i.select("i", j.alias("j")).select(F.lit("sum").alias("kind"), F.concat(F.col("i").cast("string"), F.lit(" + "), F.col("j").cast("string")).alias("question"), (F.col("i") + F.col("j")).cast("string").alias("answer"))
    binary = spark.range(2, 42).select(F.lit("binary"), F.concat(F.col("id").cast("string"), F.lit(" in binary")), F.bin("id"))
    names = spark.createDataFrame([(h + t,) for h, t in zip(_HEADS, _TAILS)], "n string")
    return sums.unionAll(binary).unionAll(names.select(F.lit("letters"), F.concat(F.lit("letters of "), "n"), F.length("n").cast("string")))


@query("s30_unanswerable")
def s30(spark, d):
    """Questions on names that no world has."""
    ask = F.explode(F.array(F.lit("Which dish did {0} like best?"), F.lit("What was the shoe size of {0}?")))
    n = spark.range(100).select("id", ask.alias("t"), F.concat(F.lit("Zz"), F.substring(F.sha1(F.col("id").cast("string")), 1, 6)).alias("name"))
    return n.select(F.concat(F.lit("unanswerable-"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("task_id"), F.replace("t", F.lit("{0}"), F.col("name")).alias("prompt"))


@query("s31_task_ids", f"with {TK} select task_id, coalesce(task_type, '-') || '-' || lpad(cast(seed % 10000000 as varchar), 7, '0') as made from tk")
def s31(spark, d):
    return tasks(spark, d, "task_type", "seed").select("task_id", F.concat(F.coalesce("task_type", F.lit("-")), F.lit("-"), F.lpad((F.col("seed") % 10_000_000).cast("string"), 7, "0")).alias("made"))


@query("s33_group_suffix", f"with {TK} select task_id || '#g' || g as rollout_id, seed from tk, (select unnest(generate_series(0, 3)) as g)")
def s33(spark, d):
    g = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return tasks(spark, d, "seed").select("task_id", "seed", g.alias("g")).select(F.concat("task_id", F.lit("#g"), F.col("g").cast("string")).alias("rollout_id"), "seed")


@query("s34_hop_means", f"with {CA}, x as (select coalesce(nullif(regexp_extract(task_id, '([2-4])hop', 1), ''), '0') as hop, final_f1, num_calls from ca) select hop, count(*) as n, round(avg(final_f1) filter (where final_f1 between 0 and 1), 4) as f1, round(avg(num_calls), 4) as calls from x group by 1")
def s34(spark, d):
    hop = F.coalesce(F.nullif(F.regexp_extract("task_id", "([2-4])hop", 1), F.lit("")), F.lit("0"))
    return cards(spark, d, "final_f1", "num_calls").groupBy(hop.alias("hop")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("final_f1").between(0, 1), F.col("final_f1"))), 4).alias("f1"), F.round(F.avg("num_calls"), 4).alias("calls"))


@query("s36_promote", f"with {TK} select count(*) as n, true as promoted, false as bad_promoted from tk")
def s36(spark, d):
    """A candidate moved into place when its gate finds nothing, and one that is left when it does."""
    at, t = shared_dir(spark), tasks(spark, d, "task_type")
    for name in ("good", "bad"):
        t.write.parquet(f"{at}/{name}-candidate")
    good = sinks.promote(spark, f"{at}/good-candidate", f"{at}/good", t.filter("task_id is null"))
    bad = sinks.promote(spark, f"{at}/bad-candidate", f"{at}/bad", t.filter("task_id is not null"))
    return spark.read.parquet(f"{at}/good").agg(F.count("*").alias("n"), F.lit(good).alias("promoted"), F.lit(bad).alias("bad_promoted"))


@query("s28_dev_set", f"with {TK}, x as (select task_id, replace(lower(trim(task_type, e' \\t\\r\\n')), '-', '_') as family, seed from tk), r as (select *, row_number() over (partition by family order by seed, task_id) as rank from x where family in ({', '.join(repr(f) for f in FAMILIES)})) select family, task_id from r where rank <= 20")
def s28(spark, d):
    """A balanced set: the first of each family by seed; spellings of a family are put together, others count for none."""
    t = tasks(spark, d, "task_type", "seed").withColumn("family", mended_family(F.col("task_type"))).filter(F.col("family").isin(FAMILIES))
    return first_k(t, ["family"], [F.col("seed"), F.col("task_id")], 20).select("family", "task_id")


@query("pr06_active_families", "select task_type as family, round(sum(target_share), 6) as weight from mix_targets where mix_name = 'family' and task_type is not null group by 1 having sum(target_share) > 0")
def pr06(spark, d):
    m = table(spark, d, "mix_targets", "mix_name", "task_type", "target_share").filter("mix_name = 'family' and task_type is not null")
    return m.groupBy(F.col("task_type").alias("family")).agg(F.round(F.sum("target_share"), 6).alias("weight")).filter("weight > 0")


# Joins
@query("j01_name_lookup", f"with {TK}, p as ({_TP}), c as (select task_id as world, generate_subscripts(chain, 1) - 1 as pos, unnest(chain) as name from tk where len(documents) > 0) select c.world, pos, count(p.doc_id) as found from c left join p on p.world = c.world and lower(trim(p.title, ' ')) = lower(trim(c.name, ' ')) group by 1, 2")
def j01(spark, d):
    """Names of a chain looked up among the titles of its own world."""
    p, _, t = task_world(spark, d)
    c = t.select(F.col("task_id").alias("world"), F.posexplode("chain").alias("pos", "name")).withColumn("k", F.lower(F.trim("name")))
    return c.join(p.select("world", F.lower(F.trim("title")).alias("k"), "doc_id"), ["world", "k"], "left").groupBy("world", "pos").agg(F.count("doc_id").alias("found"))


@query("j12_rebuild", f"with {MS}, {TK}, u as (select record_id, max(content) filter (where role = 'user') as prompt from ms group by 1) select re.record_id, tk.task_id is not null as known, coalesce(trim(u.prompt, ' ') = trim(tk.prompt, ' '), false) as same_prompt, case when tk.difficulty between 1 and 4 then 5 - tk.difficulty end as retries from re join u using (record_id) left join tk on tk.task_id = re.meta.task_id and tk.difficulty is not distinct from re.meta.difficulty")
def j12(spark, d):
    """Records joined with the task they came from, on id and difficulty; whether the prompt is still the task's, and hops left to try."""
    u = messages(spark, d).groupBy("record_id").agg(F.max(F.when(F.col("role") == "user", F.col("content"))).alias("said"))
    r = records(spark, d, "meta").select("record_id", F.col("meta.task_id").alias("_id"), F.col("meta.difficulty").alias("_d")).join(u, "record_id")
    t = tasks(spark, d, "prompt", "difficulty")
    j = r.join(t, (r["_id"] == t["task_id"]) & r["_d"].eqNullSafe(t["difficulty"]), "left")
    return j.select("record_id", F.col("task_id").isNotNull().alias("known"), F.coalesce(F.trim("said") == F.trim("prompt"), F.lit(False)).alias("same_prompt"), F.when(F.col("difficulty").between(1, 4), 5 - F.col("difficulty")).alias("retries"))


@query("j13_pairs", f"with {TK}, {TR} select tk.task_id, count(tr.task_id) as samples, count(*) filter (where tr.stop_reason = 'answered') as answered from tk left join tr on split_part(tr.task_id, '#', 1) = tk.task_id group by 1")
def j13(spark, d):
    """Tasks with their trajectories, by id and never by position; samples are counted before they are joined."""
    s = trajectories(spark, d, "stop_reason").groupBy(F.substring_index("task_id", "#", 1).alias("task_id")).agg(F.count("*").alias("samples"), F.count_if(F.col("stop_reason") == "answered").alias("answered"))
    return tasks(spark, d, "seed").select("task_id").join(s, "task_id", "left").fillna(0, ["samples", "answered"])


@query("j14_text_loader", f"with {TK}, p as ({_TP}), l as (select title, min_by(text, doc_id) as text from documents where title is not null and text is not null group by 1) select p.world, p.doc_id, md5(coalesce(nullif(l.text, ''), p.text)) as text_md5, coalesce(l.text, '') <> '' as naturalised from p left join l using (title)")
def j14(spark, d):
    """Passages with the text that a loader has for their title, else their own."""
    p, _, _ = task_world(spark, d)
    load = table(spark, d, "documents", "doc_id", "title", "text").filter("title is not null and text is not null").groupBy("title").agg(F.min_by("text", "doc_id").alias("new"))
    j = p.join(load, "title", "left")
    return j.select("world", "doc_id", F.md5(F.coalesce(F.nullif("new", F.lit("")), "text")).alias("text_md5"), (F.coalesce("new", F.lit("")) != "").alias("naturalised"))


@query("j15_alignment", f"with {MS}, n as (select *, row_number() over (partition by record_id, role order by pos) as nth from ms where role in ('assistant', 'tool')) select a.record_id, a.nth as turn, a.pos as turn_pos, t.pos as result_pos from n a join n t on t.record_id = a.record_id and t.nth = a.nth and t.role = 'tool' where a.role = 'assistant'")
def j15(spark, d):
    """The i-th result of a record with its i-th turn."""
    w = Window.partitionBy("record_id", "role").orderBy("pos")
    n = messages(spark, d).filter("role in ('assistant', 'tool')").withColumn("nth", F.row_number().over(w))
    g = n.groupBy("record_id", "nth").agg(F.max(F.when(F.col("role") == "assistant", F.col("pos"))).alias("turn_pos"), F.max(F.when(F.col("role") == "tool", F.col("pos"))).alias("result_pos"))
    return g.filter("turn_pos is not null and result_pos is not null").select("record_id", F.col("nth").alias("turn"), "turn_pos", "result_pos")


# Gates and reports
@query("a10_exact", f"with {TK}, {TR} select tk.task_type, count(*) as n, count(*) filter (where {norm('final_answer')} = {norm('oracle_answer')}) as exact from tr join tk on tk.task_id = split_part(tr.task_id, '#', 1) group by 1")
def a10(spark, d):
    t = tasks(spark, d, "task_type", "oracle_answer").withColumnRenamed("task_id", "base")
    j = trajectories(spark, d, "final_answer").withColumn("base", F.substring_index("task_id", "#", 1)).join(t, "base")
    return j.groupBy("task_type").agg(F.count("*").alias("n"), F.count_if(norm_text(F.col("final_answer")) == norm_text(F.col("oracle_answer"))).alias("exact"))


@query("a14_step_row", f"with x as ({_DEAD}), {RO}, j as (select split_part(ro.grp, '-', 1) as family, ro.grp, reward, success, dead_reason is null as live from ro join x using (grp)) select family, count(distinct grp) as groups, count(distinct grp) filter (where live) as live_groups, count(distinct grp) filter (where live) = 0 as pool_empty, round(1 - count(distinct grp) filter (where live) / count(distinct grp), 4)::double as dead_fraction, round(coalesce(avg(reward) filter (where live), 0), 4) as mean_reward, round(coalesce(avg(success::int) filter (where live), 0), 4) as success from j group by 1".replace("with x as (with", "with x as (with"))
def a14(spark, d):
    """A row a family: means over the live pool (0 where it is empty), and the true share of dead groups."""
    live = w06(spark, d).select("grp", F.col("dead_reason").isNull().alias("live"))
    j = rollouts(spark, d).groupBy("grp").agg(F.count("*").alias("k"), F.sum("reward").alias("r"), F.sum(F.col("success").cast("int")).alias("s")).join(live, "grp")
    on = lambda c: F.sum(F.when(F.col("live"), F.col(c)))
    g = j.groupBy(F.substring_index("grp", "-", 1).alias("family")).agg(F.count("*").alias("groups"), F.count_if("live").alias("live_groups"), on("r").alias("r"), on("s").alias("s"), on("k").alias("k"))
    mean = lambda c: F.round(F.coalesce(F.col(c) / F.col("k"), F.lit(0.0)), 4)
    return g.select("family", "groups", "live_groups", (F.col("live_groups") == 0).alias("pool_empty"), F.round(1 - F.col("live_groups") / F.col("groups"), 4).alias("dead_fraction"), mean("r").alias("mean_reward"), mean("s").alias("success"))


@query("st6_time_left", f"with {CA}, h as (select loaded_at::date as day, count(*) as n from ca group by 1), w as (select day, n, max(n) over (order by day rows between 3 preceding and 1 preceding) as worst, sum(n) over (order by day) as used from h) select cast(day as varchar) as day, n, worst, used::bigint as used, coalesce(used + worst > 2000, false) as stop from w")
def st6(spark, d):
    """Whether a run would pass its limit with one more step as costly as the worst of the last three."""
    w = Window.orderBy("d")  # one row a day
    h = cards(spark, d, "task_type").groupBy(F.to_date("loaded_at").alias("d")).agg(F.count("*").alias("n"))
    h = h.withColumn("worst", F.max("n").over(w.rowsBetween(-3, -1))).withColumn("used", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return h.select(F.col("d").cast("string").alias("day"), "n", "worst", "used", F.coalesce(F.col("used") + F.col("worst") > 2000, F.lit(False)).alias("stop"))


_SHORTCUT = f"""sq as (with {TK}, {_bm25_sql(_TP, "select task_id as world, 'q' as query_id, prompt as query from tk where len(documents) > 0")} select hits.world, list({norm("concat_ws(' ', title, text)")}) as blobs from hits join p using (world, doc_id) group by 1)"""
_GATES = f"""{_STEPS}, {_SHORTCUT},
  ga as (select st.world, any_value(st.task_type) as task_type, any_value(forms) as forms from st group by 1),
  gr as (select ga.world, ga.task_type, coalesce(len([1 for b in sq.blobs if len([1 for f in forms if contains(b, f)]) > 0]) > 0, false) as shortcut from ga left join sq using (world)),
  gs as (select world, coalesce(bool_or(hit) filter (where pos < n - 1), false) as leaky, coalesce(bool_or(not names_next) filter (where pos < n - 1), false) as broken, coalesce(bool_or(hit) filter (where pos = n - 1), false) as last_hit from steps group by 1),
  gt as (select world, task_type, case when shortcut then 'shortcut' when leaky then 'prefix_leak' when broken then 'broken_chain' when not last_hit then 'unretrievable' end as reason from gr join gs using (world))"""


def gated(spark, d):
    """world, task_type and the first gate that a task with documents fails; null passes all."""
    p, _, t = task_world(spark, d)
    ask = t.join(tasks(spark, d, "prompt").select("task_id", "prompt"), "task_id").select(F.col("task_id").alias("world"), F.lit("q").alias("query_id"), F.col("prompt").alias("query"))
    from millrace.functions.text import gold_forms

    forms = t.select(F.col("task_id").alias("world"), F.filter(F.transform(gold_forms(F.col("gold.kind"), F.col("gold.value")), norm_text), lambda x: x != "").alias("forms"))
    hit = search(p, ask, 3).join(p, ["world", "doc_id"]).join(forms, "world").withColumn("blob", norm_text(F.concat_ws(" ", "title", "text")))
    short = hit.groupBy("world").agg(F.max(F.exists("forms", lambda f: F.contains("blob", f))).alias("shortcut"))
    inner = F.col("pos") < F.col("n") - 1
    s = plan_hits(spark, d).groupBy("world").agg(
        F.first("task_type").alias("task_type"), F.coalesce(F.bool_or(F.when(inner, F.col("hit"))), F.lit(False)).alias("leaky"), F.coalesce(F.bool_or(F.when(inner, ~F.col("names_next"))), F.lit(False)).alias("broken"), F.coalesce(F.bool_or(F.when(~inner, F.col("hit"))), F.lit(False)).alias("last"),
    )
    reason = F.when(F.coalesce("shortcut", F.lit(False)), "shortcut").when(F.col("leaky"), "prefix_leak").when(F.col("broken"), "broken_chain").when(~F.col("last"), "unretrievable")
    return s.join(short, "world", "left").select("world", "task_type", reason.alias("reason"))


@query("g06_first_survivor", f"with {_GATES} select task_type, count(*) as candidates, count(*) filter (where reason is null) as survivors, min_by(world, md5(world)) filter (where reason is null) as first_survivor from gt group by 1")
def g06(spark, d):
    """All candidates through the gates in one batch; of each family the first survivor in hash order."""
    ok = F.col("reason").isNull()
    return gated(spark, d).groupBy("task_type").agg(F.count("*").alias("candidates"), F.count_if(ok).alias("survivors"), F.min_by(F.when(ok, F.col("world")), F.when(ok, F.md5("world"))).alias("first_survivor"))


@query("g06_reject_counts", f"with {_GATES} select coalesce(reason, 'kept') as reason, count(*) as n from gt group by 1")
def g06b(spark, d):
    return gated(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("g07_degrade", f"with {_GATES}, l as (select tk.chain[1] as head, gt.world, len(tk.oracle_plan) as hops, reason from gt join tk on tk.task_id = gt.world) select head, coalesce(cast(max(hops) filter (where reason is null) as varchar) || 'hop', 'no_tool') as family from l group by 1")
def g07(spark, d):
    """For each head the longest chain that survives the gates, else a question without tools."""
    t = tasks(spark, d, "chain", "oracle_plan").select(F.col("task_id").alias("world"), F.get("chain", F.lit(0)).alias("head"), F.size("oracle_plan").alias("hops"))
    g = gated(spark, d).join(t, "world").groupBy("head").agg(F.max(F.when(F.col("reason").isNull(), F.col("hops"))).alias("hops"))
    return g.select("head", F.coalesce(F.concat(F.col("hops").cast("string"), F.lit("hop")), F.lit("no_tool")).alias("family"))


@query("g10_rate_gate", f"with {_STEPS}, s as ({_SUFF}) select round(avg(retrievable::int), 4) as rate, avg(retrievable::int) >= 0.5 as passed from s")
def g10(spark, d):
    from millrace.plans.retrieval import g08

    rate = F.avg(F.col("retrievable").cast("int"))
    return g08(spark, d).agg(F.round(rate, 4).alias("rate"), (rate >= 0.5).alias("passed"))


@query("d15_worst_routes", f"with {_STEPS}, s as ({_SUFF}), r as (select array_to_string(route, '>') as route, count(*) as failures from s join tk on tk.task_id = s.world where not retrievable group by 1) select route, failures from r order by failures desc, route limit 10")
def d15(spark, d):
    """The ten routes that fail most; the limit is the report."""
    from millrace.plans.retrieval import g08

    t = tasks(spark, d, "route").select(F.col("task_id").alias("world"), F.array_join("route", ">").alias("route"))
    r = g08(spark, d).filter("not retrievable").join(t, "world").groupBy("route").agg(F.count("*").alias("failures"))
    return r.orderBy(F.desc("failures"), "route").limit(10)


_CAND = f"""cd as (select st0.world, st0.hop, fl.flavour, case fl.flavour when 0 then st0.name || ' history' when 1 then split_part(st0.q, ' ', -1) else 'the old ' || st0.name end as query from
  (select task_id as world, generate_subscripts(oracle_plan, 1) - 1 as hop, unnest(oracle_plan).arguments.query as q, chain[generate_subscripts(oracle_plan, 1)] as name from tk where len(documents) > 0) st0, (values (0), (1), (2)) fl(flavour) where st0.hop >= 1 and st0.q is not null)"""
_RECOVER = f"{_bm25_sql(_TP, 'select world, hop || chr(124) || flavour as query_id, query from cd')}"


@query("g14_recovery", f"""with {TK}, {_CAND}, {_RECOVER}, bl as (select hits.world, query_id, list({norm("concat_ws(' ', title, text)")}) as blobs, count(*) as num_results from hits join p using (world, doc_id) group by 1, 2),
  ms0 as (select cd.*, coalesce(num_results, 0) as num_results, len([1 for b in coalesce(blobs, []) if contains(b, {norm('tk.oracle_answer')}) or (tk.chain[hop + 2] is not null and contains(b, {norm('tk.chain[hop + 2]')}))]) = 0 as misses from cd join tk on tk.task_id = cd.world left join bl on bl.world = cd.world and bl.query_id = cd.hop || '|' || cd.flavour where {norm('tk.oracle_answer')} <> '')
  select world, hop, flavour, query, num_results from (select *, row_number() over (partition by world order by sha1(world || '|' || hop), flavour) as rn from ms0 where misses) where rn = 1""")
def g14(spark, d):
    """The search that a recovery is spliced in with: by hop in hash order, then by flavour, the first that shows neither the answer nor the next name."""
    p, q, t = task_world(spark, d)
    names = t.select(F.col("task_id").alias("world"), "chain", F.col("gold"))
    s = q.join(names, "world").filter("pos >= 1 and query is not null").withColumn("name", F.get("chain", F.col("pos")))
    made = F.array(F.concat("name", F.lit(" history")), F.substring_index("query", " ", -1), F.concat(F.lit("the old "), "name"))
    c = s.select("world", F.col("pos").alias("hop"), "chain", F.posexplode(made).alias("flavour", "query")).withColumn("query_id", F.concat_ws("|", F.col("hop").cast("string"), F.col("flavour").cast("string")))
    hit = search(p, c.select("world", "query_id", "query"), 3).join(p, ["world", "doc_id"]).withColumn("blob", norm_text(F.concat_ws(" ", "title", "text")))
    hit = hit.groupBy("world", "query_id").agg(F.collect_list("blob").alias("blobs"), F.count("*").alias("num_results"))
    want = tasks(spark, d, "oracle_answer").select(F.col("task_id").alias("world"), norm_text(F.col("oracle_answer")).alias("want")).filter("want <> ''")
    c = c.join(want, "world").join(hit, ["world", "query_id"], "left")
    nxt = F.get("chain", F.col("hop") + 1)
    shows = F.coalesce(F.exists("blobs", lambda b: F.contains(b, F.col("want")) | F.coalesce(F.contains(b, norm_text(nxt)) & nxt.isNotNull(), F.lit(False))), F.lit(False))
    c = first_k(c.filter(~shows), ["world"], [F.sha1(F.concat_ws("|", "world", F.col("hop").cast("string"))), F.col("flavour")], 1)
    return c.select("world", "hop", "flavour", "query", F.coalesce("num_results", F.lit(0)).alias("num_results"))


@query("q08_coverage", f"with {TK}, {RE} select count(*) as tasks, count(*) filter (where task_id in (select meta.task_id from re)) as covered, count(*) filter (where task_id in (select meta.task_id from re)) >= 0.9 * count(*) as passed from tk")
def q08(spark, d):
    done = records(spark, d, "meta").select(F.col("meta.task_id").alias("task_id"), F.lit(True).alias("done")).distinct()
    t = tasks(spark, d, "seed").join(done, "task_id", "left")
    return t.agg(F.count("*").alias("tasks"), F.count("done").alias("covered"), (F.count("done") >= 0.9 * F.count("*")).alias("passed"))


@query("q09_mix_checks", f"select mix_name, count(*) filter (where task_type is not null and task_type not in ({', '.join(repr(f) for f in FAMILIES)})) as unknown, count(*) filter (where target_share <= 0) as zero, abs(sum(target_share) - 1) < 1e-6 as sums_to_one from mix_targets group by 1")
def q09(spark, d):
    m = table(spark, d, "mix_targets", "mix_name", "task_type", "target_share")
    odd = F.col("task_type").isNotNull() & ~F.col("task_type").isin(FAMILIES)
    return m.groupBy("mix_name").agg(F.count_if(odd).alias("unknown"), F.count_if(F.col("target_share") <= 0).alias("zero"), (F.abs(F.sum("target_share") - 1) < 1e-6).alias("sums_to_one"))


@query("q11_dataset_checks", f"with {TK} select count(*) filter (where gold.kind is null) as without_gold, count(*) filter (where gold.kind = 'none' and len(required_tools) = 0 and task_type = 'unanswerable') as odd_unanswerable, count(*) filter (where len(oracle_plan) > 0 and len(chain) < len(oracle_plan)) as short_chains, count(distinct task_type) as families from tk")
def q11(spark, d):
    t = tasks(spark, d, "gold", "required_tools", "task_type", "oracle_plan", "chain")
    return t.agg(
        F.count_if(F.col("gold.kind").isNull()).alias("without_gold"), F.count_if((F.col("gold.kind") == "none") & (F.size("required_tools") == 0) & (F.col("task_type") == "unanswerable")).alias("odd_unanswerable"),
        F.count_if((F.size("oracle_plan") > 0) & (F.size("chain") < F.size("oracle_plan"))).alias("short_chains"), F.countDistinct("task_type").alias("families"),
    )


@query("q12_artefacts", "select 'task' as artefact, count(*) as n, count(*) > 0 as passed from task union all select 'trajectory', count(*), count(*) > 0 from trajectory union all select 'scorecard', count(*), count(*) > 0 from scorecard union all select 'sft_record', count(*), count(*) > 0 from sft_record")
def q12(spark, d):
    one = lambda n: table(spark, d, n, F.lit(n).alias("artefact")).groupBy("artefact").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("passed"))
    return one("task").unionAll(one("trajectory")).unionAll(one("scorecard")).unionAll(one("sft_record"))
