"""Curation of trajectories into a training set."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.curate import first_by_hash, first_k, hashed, quality_reason, rebalance, repeated_call
from millrace.plans.base import CA, TK, TR, cards, tasks, trajectories
from millrace.registry import query

TARGET = {"musique_2hop": 0.4, "musique_3hop": 0.3, "musique_4hop": 0.2, "no_tool": 0.1}


def scored(spark, d):
    t = trajectories(spark, d, "final_answer", "call_log").select("task_id", F.coalesce("final_answer", F.lit("")).alias("answer"), repeated_call(F.col("call_log")).alias("repeated"))
    c = cards(spark, d, "success", "format_loose", "num_calls", "oracle_calls", "recovery_ok", "task_type")
    return t.join(c, "task_id").select("task_id", "task_type", "answer", "repeated", "success", "format_loose", "num_calls", "oracle_calls", F.coalesce("recovery_ok", F.lit(False)).alias("recovered"), F.substring_index("task_id", "#", 1).alias("base"))


_SIG = "[c.name || ':' || coalesce(c.args, '') for c in call_log]"
_SC = f"""{TR}, {CA}, sc as (select tr.task_id, split_part(tr.task_id, '#', 1) as base, ca.task_type, coalesce(final_answer, '') as answer, coalesce(len(list_distinct({_SIG})) < len({_SIG}), false) as repeated,
    success, format_loose, num_calls, oracle_calls, coalesce(recovery_ok, false) as recovered from tr join ca using (task_id)),
  qr as (select *, case when not coalesce(success, false) then 'not_success' when not coalesce(format_loose, false) then 'loose_format' when repeated then 'repeated_call' when length(answer) > 600 then 'verbose_answer'
    when num_calls > greatest(1, coalesce(oracle_calls, 0)) * 2.0 + 1 and not recovered then 'call_bloat' end as reason from sc)"""


@query("pr01_quality_reason", f"with {_SC} select task_id, reason from qr")
def p01(spark, d):
    return scored(spark, d).select("task_id", quality_reason().alias("reason"))


@query("pr02_repeat", f"with {_SC} select task_id, repeated from sc")
def p02(spark, d):
    return scored(spark, d).select("task_id", "repeated")


@query("a06_filter_summary", f"with {_SC} select coalesce(reason, 'kept') as reason, count(*) as n, round(avg(num_calls), 2) as avg_calls from qr group by 1")
def a06(spark, d):
    return scored(spark, d).groupBy(F.coalesce(quality_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("num_calls"), 2).alias("avg_calls"))


def best(spark, d):
    ok = scored(spark, d).filter(quality_reason().isNull())
    return first_k(ok, ["base"], [F.asc("num_calls"), F.desc("recovered"), F.length("answer"), F.asc("task_id")], 1).drop("rank")


_BEST = f"{_SC}, best as (select * from (select *, row_number() over (partition by base order by num_calls, recovered desc, length(answer), task_id) as rank from qr where reason is null) where rank = 1)"


@query("d01_best_of_n", f"with {_BEST} select base, task_id from best")
def d01(spark, d):
    return best(spark, d).select("base", "task_id")


_H = lambda seed, key: f"md5('{seed}:' || {key})"
_WSQ = "lower(regexp_replace(regexp_replace(prompt, '[ \\t\\r\\n\\f]+', ' ', 'g'), '^ | $', '', 'g'))"


def one_label(spark, d):
    q = tasks(spark, d, "prompt", "oracle_answer", "route").withColumnRenamed("task_id", "base").withColumn("q", F.lower(F.trim(F.regexp_replace("prompt", r"[ \t\r\n\f]+", " "))))
    return first_k(best(spark, d).join(q, "base"), ["q"], [hashed("dedup", F.col("task_id")), F.col("task_id")], 1).drop("rank")


_ONE = f"{TK}, {_BEST}, one as (select * from (select best.* exclude (rank), oracle_answer, route, {_WSQ} as q, row_number() over (partition by {_WSQ} order by {_H('dedup', 'best.task_id')}, best.task_id) as rank from best join tk on tk.task_id = best.base) where rank = 1)"


@query("d02_question_dedup", f"with {_ONE} select task_id from one")
def d02(spark, d):
    return one_label(spark, d).select("task_id")


def shaped(spark, d, cap=20):
    shape = F.substring(F.md5(F.concat_ws("|", F.coalesce("task_type", F.lit("")), F.array_join("route", ","))), 1, 12)
    return first_k(one_label(spark, d).withColumn("shape", shape), ["shape"], [hashed("shape", F.col("task_id")), F.col("task_id")], cap).drop("rank")


_SHAPED = f"{_ONE}, shaped as (select * from (select * exclude (rank), row_number() over (partition by shape order by {_H('shape', 'task_id')}, task_id) as rank from (select *, md5(coalesce(task_type, '') || '|' || array_to_string(route, ','))[1:12] as shape from one)) where rank <= 20)"


@query("d03_shape_cap", f"with {_SHAPED} select shape, task_id from shaped")
def d03(spark, d):
    return shaped(spark, d).select("shape", "task_id")


def _mix(src: str) -> str:
    target = "(values " + ", ".join(f"('{k}', {v}::double)" for k, v in TARGET.items()) + ") as t(task_type, share)"
    return f"""cnt as (select task_type, count(*) as n from {src} group by 1), want as (select task_type, floor((select min(n / share) from cnt join {target} using (task_type)) * share + 1e-9) as want from cnt join {target} using (task_type)),
      mixed as (select * from (select {src}.task_id, {src}.task_type, want, row_number() over (partition by {src}.task_type order by {_H('mix', src + '.task_id')}, {src}.task_id) as rank from {src} join want using (task_type)) where rank <= want)"""


@query("d04_rebalance", f"with {TK}, {_mix('tk')} select task_id, task_type from mixed")
def d04(spark, d):
    return rebalance(tasks(spark, d, "task_type"), "task_type", "task_id", TARGET).select("task_id", "task_type")


@query("d05_pipeline", f"with {_SHAPED}, {_mix('shaped')} select task_id, task_type from mixed")
def d05(spark, d):
    return rebalance(shaped(spark, d), "task_type", "task_id", TARGET).select("task_id", "task_type")


@query("d06_combine_ratio", f"with {TK}, c as (select count(*) filter (where len(documents) > 0) as r, count(*) filter (where len(documents) = 0) as s from tk), w as (select least(r, floor(s * 0.25 / 0.75)) as wr, least(s, floor(r * 0.75 / 0.25)) as ws from c), x as (select task_id, len(documents) > 0 as is_real, row_number() over (partition by len(documents) > 0 order by {_H('comb', 'task_id')}, task_id) as rank from tk) select task_id, is_real from x, w where rank <= case when is_real then wr else ws end")
def d06(spark, d):
    t = tasks(spark, d, "documents").select("task_id", (F.size("documents") > 0).alias("is_real"))
    real, made = t.agg(F.count(F.when(F.col("is_real"), 1))).scalar(), t.agg(F.count(F.when(~F.col("is_real"), 1))).scalar()
    want = F.when(F.col("is_real"), F.least(real, F.floor(made * 0.25 / 0.75))).otherwise(F.least(made, F.floor(real * 0.75 / 0.25)))
    return first_by_hash(t.withColumn("want", want), ["is_real"], hashed("comb", F.col("task_id")), "task_id", "want").select("task_id", "is_real")


@query("d07_weighted_pick", f"with {TK}, u as (select task_id, ('0x' || sha1(task_id)[1:8])::bigint / 4294967296.0::double as u from tk) select task_id, case when u < 0.4 then 'musique_2hop' when u < 0.7 then 'musique_3hop' when u < 0.9 then 'musique_4hop' else 'no_tool' end as family from u")
def d07(spark, d):
    u = F.conv(F.substring(F.sha1("task_id"), 1, 8), 16, 10).cast("double") / 4294967296.0
    return tasks(spark, d, "seed").select("task_id", F.when(u < 0.4, "musique_2hop").when(u < 0.7, "musique_3hop").when(u < 0.9, "musique_4hop").otherwise("no_tool").alias("family"))


@query("d08_stratified", f"with {TK}, x as (select task_id, difficulty, row_number() over (partition by difficulty order by {_H('strat', 'task_id')}, task_id) as rank, count(*) over (partition by difficulty) as n from tk) select task_id, difficulty from x where rank <= round_even(n * 0.3, 0)")
def d08(spark, d):
    t = tasks(spark, d, "difficulty")
    n = t.groupBy(F.col("difficulty").alias("d2")).agg(F.count("*").alias("n"))
    t = t.join(n, F.col("difficulty").eqNullSafe(F.col("d2"))).withColumn("want", F.bround(F.col("n") * 0.3))
    return first_by_hash(t, ["difficulty"], hashed("strat", F.col("task_id")), "task_id", "want").select("task_id", "difficulty")


@query("d12_split", f"with {TK}, x as (select task_id, row_number() over (order by {_H('split', 'task_id')}, task_id) as rank, count(*) over () as n from tk) select task_id from x where rank <= greatest(1, floor(n * 0.05))")
def d12(spark, d):
    t = tasks(spark, d, "seed").select("task_id")
    n = t.agg(F.greatest(F.lit(1), F.floor(F.count("*") * 0.05))).scalar()
    # Rows below the hash that the split can reach at most, so that no task ranks the whole table.
    bucket = F.substring(hashed("split", F.col("task_id")), 1, 3)
    per = t.groupBy(bucket.alias("b")).agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 4096 rows
    ranked = t.withColumn("b", bucket).join(F.broadcast(per.select("b", before.alias("before"))), "b").filter(F.col("before") < n)
    inside = F.row_number().over(Window.partitionBy("b").orderBy(hashed("split", F.col("task_id")), "task_id"))
    return ranked.withColumn("rank", F.col("before") + inside).filter(F.col("rank") <= n).select("task_id")


@query("d13_probe", "select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) as rn from lineitem) where rn % 100 = 1")
def d13(spark, d):
    from pyspark.sql import Window

    from millrace.sources.tables import table

    # A flag holds a third of all rows: places come from counts by ranges of order keys, and from the places within a range.
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn("b", F.floor(F.col("l_orderkey") / 4096))
    per = li.groupBy("l_returnflag", "b").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("l_returnflag").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("l_returnflag", "b").orderBy("l_orderkey", "l_linenumber"))
    x = li.join(per.select("l_returnflag", "b", before.alias("before")), ["l_returnflag", "b"]).withColumn("rn", F.col("before") + inside)
    return x.filter(F.col("rn") % 100 == 1).select("l_orderkey", "l_linenumber")
