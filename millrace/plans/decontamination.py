"""Anti joins against the held-out rows, incremental set operations, and the key walk over linked entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import evidence_ids, norm_question
from millrace.plans.base import RE, TK, records, tasks
from millrace.registry import query
from millrace.sources.tables import table

_NQ = lambda c: f"regexp_replace(regexp_replace(regexp_replace(lower(trim({c}, ' ')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'), '^ | $', '', 'g')"


def _nq(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s]", ""), r"[ \t\r\n\f]+", " "))


@query("j08_question_antijoin", f"with {TK} select task_id from tk where not exists (select 1 from judge_row j where {_NQ('j.question')} = {_NQ('tk.prompt')})")
def j08(spark, d):
    held = table(spark, d, "judge_row", "question").select(norm_question(F.col("question")).alias("q"))
    return tasks(spark, d, "prompt").withColumn("q", _nq(F.col("prompt"))).join(held, "q", "left_anti").select("task_id")


@query("j09_evidence_antijoin", f"with {TK}, e as (select distinct unnest([x for x in regexp_split_to_array(id, '[_-]+') if regexp_full_match(x, '\\d+')])::bigint as e from judge_row), s as (select distinct task_id from (select task_id, unnest([x for x in regexp_split_to_array(task_id, '[_-]+') if regexp_full_match(x, '\\d+')])::bigint as e from tk) join e using (e)) select task_id from tk where task_id not in (select task_id from s)")
def j09(spark, d):
    held = table(spark, d, "judge_row", "id").select(F.explode(evidence_ids(F.col("id"))).alias("e")).distinct()
    t = tasks(spark, d, "seed").select("task_id")
    bad = t.select("task_id", F.explode(evidence_ids(F.col("task_id"))).alias("e")).join(held, "e", "left_semi").select("task_id").distinct()
    return t.join(bad, "task_id", "left_anti")


@query("j10_leftovers", f"with {TK}, kept as (select task_id from tk where not exists (select 1 from judge_row j where {_NQ('j.question')} = {_NQ('tk.prompt')})), again as (select {_NQ('tk.prompt')} as q from kept join tk using (task_id)) select count(*) as leftovers from again where q in (select {_NQ('question')} from judge_row)")
def j10(spark, d):
    held = table(spark, d, "judge_row", "question").select(norm_question(F.col("question")).alias("q"))
    kept = j08(spark, d).join(tasks(spark, d, "prompt"), "task_id").select(_nq(F.col("prompt")).alias("q"))
    return kept.join(held, "q", "left_semi").agg(F.count("*").alias("leftovers"))


@query("j11_cross_set_fresh", f"with {TK}, b as (select distinct lower(prompt) as q from tk where difficulty = 1) select task_id from tk where difficulty = 2 and lower(prompt) not in (select q from b where q is not null)")
def j11(spark, d):
    t = tasks(spark, d, "prompt", "difficulty").withColumn("q", F.lower("prompt"))
    return t.filter("difficulty = 2").join(t.filter("difficulty = 1").select("q"), "q", "left_anti").select("task_id")


@query("j06_todo", f"with {TK}, {RE} select task_id from tk where not exists (select 1 from re where re.meta.task_id = tk.task_id)")
def j06(spark, d):
    done = records(spark, d, "meta").select(F.col("meta.task_id").alias("task_id"))
    return tasks(spark, d, "seed").select("task_id").join(done, "task_id", "left_anti")


@query("j07_coalesce", f"with {TK}, c as (select task_id, notes from tk where notes is not null) select tk.task_id, coalesce(c.notes, tk.oracle_answer) as text, c.task_id is not null as from_cache from tk left join c using (task_id)")
def j07(spark, d):
    t = tasks(spark, d, "notes", "oracle_answer")
    cache = t.filter("notes is not null").select("task_id", F.col("notes").alias("cached"))
    return t.join(cache, "task_id", "left").select("task_id", F.coalesce("cached", "oracle_answer").alias("text"), F.col("cached").isNotNull().alias("from_cache"))


@query("j02_chain_walk", "select r_name, n_name, count(*) as n, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def j02(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum("l_quantity").alias("q"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("r_name", "n_name").agg(F.sum("k").alias("n"), F.sum("q").alias("quantity"))


@query("x01_union", f"with {TK}, {RE} select 'task' as origin, count(*) as n from tk union all select 'record', count(*) from re")
def x01(spark, d):
    a = tasks(spark, d, "seed").select(F.lit("task").alias("origin"))
    return a.unionByName(records(spark, d, "lang").select(F.lit("record").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))


@query("x02_except", "select task_id from scorecard except select task_id from trajectory")
def x02(spark, d):
    return table(spark, d, "scorecard", "task_id").distinct().subtract(table(spark, d, "trajectory", "task_id").distinct())


@query("x04_intersect_all", "select o_custkey as key from orders where o_orderstatus = 'F' intersect all select o_custkey from orders where o_orderstatus = 'O'")
def x04(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "key")
    return o.filter("o_orderstatus = 'F'").select("key").intersectAll(o.filter("o_orderstatus = 'O'").select("key"))


@query("x06_disjoint", f"with {TK} select count(*) as shared from (select task_id from tk intersect select id from judge_row)")
def x06(spark, d):
    return tasks(spark, d, "seed").select("task_id").intersect(table(spark, d, "judge_row", F.col("id").alias("task_id"))).agg(F.count("*").alias("shared"))


@query("s17_last_wins", "select task_id, max_by(coalesce(success, false), loaded_at) as success from scorecard group by 1")
def s17(spark, d):
    return table(spark, d, "scorecard", "task_id", "success", "loaded_at").groupBy("task_id").agg(F.max_by(F.coalesce("success", F.lit(False)), "loaded_at").alias("success"))


@query("s13_cache_explode", "select regexp_extract(k, '^(.*):([^:]*)$', 1) as world, regexp_extract(k, '^(.*):([^:]*)$', 2) as doc_id from (select source || ':' || doc_id as k from documents where source is not null)")
def s13(spark, d):
    k = table(spark, d, "documents", "doc_id", "source").filter("source is not null").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("k"))
    return k.select(F.regexp_extract("k", "^(.*):([^:]*)$", 1).alias("world"), F.regexp_extract("k", "^(.*):([^:]*)$", 2).alias("doc_id"))


@query("s15_seed_ranges", "select start + i as seed from (values (0, 5), (100, 3), (500, 1)) t(start, n), generate_series(0, 4) g(i) where i < n")
def s15(spark, d):
    part = F.explode(F.split(F.lit("0:5,100:3,500"), ","))
    r = spark.range(1).select(part.alias("x")).select(F.split("x", ":").alias("p")).select(F.col("p")[0].cast("long").alias("start"), F.coalesce(F.get("p", F.lit(1)).cast("long"), F.lit(1)).alias("n"))
    return r.select(F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("seed"))
