"""BM25 retrieval and the gates over it. Worlds: the candidate sets of the held-out rows, and of tasks with documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import gold_forms, norm_text
from millrace.operators.retrieval import index, search
from millrace.plans.base import TK, norm, tasks, toks
from millrace.registry import query
from millrace.sources.tables import table


def judge_world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = table(spark, d, "judge_row", "id", "question", "context")
    p = j.select(F.col("id").alias("world"), F.posexplode("context").alias("pos", "c")).select("world", F.col("pos").cast("string").alias("doc_id"), F.col("c.title").alias("title"), F.col("c.paragraph_text").alias("text"))
    return p, j.select(F.col("id").alias("world"), F.lit("q").alias("query_id"), F.col("question").alias("query"))


def task_world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = tasks(spark, d, "task_type", "gold", "oracle_plan", "documents", "chain").filter(F.size("documents") > 0)
    p = t.select(F.col("task_id").alias("world"), F.explode("documents").alias("x")).select("world", "x.doc_id", "x.title", "x.text")
    q = t.select(F.col("task_id").alias("world"), F.posexplode("oracle_plan").alias("pos", "s")).select("world", F.lpad(F.col("pos").cast("string"), 3, "0").alias("query_id"), "pos", F.col("s.arguments.query").alias("query"), F.col("s.arguments.top_k").alias("top_k"))
    return p, q, t


def _bm25_sql(passages: str, queries: str, k: str = "3") -> str:
    """Common table expressions ending in hits(world, query_id, rank, doc_id, score). The fold is written in closed form."""
    return f"""
    p as ({passages}), q0 as ({queries}),
    pt as (select world, doc_id, {toks("coalesce(title, '') || ' ' || coalesce(text, '')")} as tk, {toks("coalesce(title, '')")} as tt from p),
    pl as (select *, len(tk) as length from pt),
    per as (select world, count(*) as n, avg(length) as av from pl group by 1),
    q as (select world, query_id, k, unnest(generate_series(1, len(tk))) as pos, tk from (select world, query_id, {k} as k, {toks("query")} as tk from q0)),
    qt as (select world, query_id, k, pos, tk[pos] as term from q),
    post as (select world, doc_id, term, count(*) as tf, any_value(list_contains(tt, term)) as in_title from (select world, doc_id, tt, unnest(tk) as term from pl) group by 1, 2, 3),
    dfs as (select world, term, count(*) as df from post group by 1, 2),
    h as (select qt.world, query_id, qt.k, pos, post.doc_id, case when in_title then 1.6::double else 1.0::double end as b,
        ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (1 - 0.75::double + 0.75::double * length / (case when av > 0 then av else 1 end))) as w
      from qt join post using (world, term) join dfs using (world, term) join pl using (world, doc_id) join per using (world)),
    f as (select *, exp(sum(ln(b)) over (partition by world, query_id, doc_id order by pos rows between current row and unbounded following)) as m from h),
    sc as (select world, query_id, doc_id, any_value(k) as k, sum(w * m) as score from f group by 1, 2, 3),
    hits as (select world, query_id, rank, doc_id, round(score, 4) as score from (select world, query_id, row_number() over (partition by world, query_id order by round(score, 10) desc, doc_id) as rank, doc_id, score, k from sc where score > 0) where rank <= least(greatest(coalesce(k, 3), 1), 10))"""


_JP = "select id as world, cast(generate_subscripts(context, 1) - 1 as varchar) as doc_id, unnest(context).title as title, unnest(context).paragraph_text as text from judge_row"
_JQ = "select id as world, 'q' as query_id, question as query from judge_row"
_TP = "select task_id as world, unnest(documents).doc_id as doc_id, unnest(documents).title as title, unnest(documents).text as text from tk where len(documents) > 0"
_TQ = "select task_id as world, lpad(cast(generate_subscripts(oracle_plan, 1) - 1 as varchar), 3, '0') as query_id, unnest(oracle_plan).arguments.query as query, unnest(oracle_plan).arguments.top_k as top_k from tk where len(documents) > 0"
_JUDGE, _PLAN = _bm25_sql(_JP, _JQ), f"{TK}, " + _bm25_sql(_TP, _TQ, "top_k")


@query("r01_index_stats", f"with {_JUDGE} select world, count(*) as n_docs, round(avg(length), 4) as avg_length, (select count(*) from dfs where dfs.world = pl.world) as n_terms from pl group by world")
def r01(spark, d):
    p, _ = judge_world(spark, d)
    docs, post = index(p)
    return docs.groupBy("world").agg(F.count("*").alias("n_docs"), F.round(F.avg("length"), 4).alias("avg_length")).join(post.groupBy("world").agg(F.countDistinct("term").alias("n_terms")), "world")


@query("r02_bm25_top3", f"with {_JUDGE} select world, query_id, cast(rank as integer) as rank, doc_id, score from hits")
def r02(spark, d):
    p, q = judge_world(spark, d)
    return search(p, q, 3)


@query("r03_bm25_topk_clamped", f"with {_bm25_sql(_JP, _JQ, '25')} select world, query_id, cast(rank as integer) as rank, doc_id, score from hits")
def r03(spark, d):
    p, q = judge_world(spark, d)
    return search(p, q, 25)


_SHORT = "select id as world, 'q' as query_id, split_part(question, ' ', 1) as query from judge_row"


@query("r04_zero_hit_queries", f"with {_bm25_sql(_JP, _SHORT)} select q0.world, count(hits.doc_id) as num_results, case when len({toks('any_value(q0.query)')}) = 0 then 'empty_query' end as error from q0 left join hits using (world, query_id) group by q0.world")
def r04(spark, d):
    p, q = judge_world(spark, d)
    q = q.withColumn("query", F.substring_index("query", " ", 1))
    hits = search(p, q).groupBy("world").agg(F.count("*").alias("num_results"))
    return q.join(hits, "world", "left").select("world", F.coalesce("num_results", F.lit(0)).alias("num_results"), F.when(~F.lower("query").rlike("[a-z0-9]"), "empty_query").alias("error"))


@query("r06_plan_replay", f"with {_PLAN} select world, query_id, cast(rank as integer) as rank, doc_id, score from hits")
def r06(spark, d):
    p, q, _ = task_world(spark, d)
    return search(p, q, F.col("top_k"))


@query("r08_retrieved_by_family", f"with {_PLAN} select task_type, count(distinct world) as tasks, count(distinct world || '/' || doc_id) as retrieved from hits join tk on tk.task_id = hits.world group by 1")
def r08(spark, d):
    p, q, t = task_world(spark, d)
    hits = search(p, q, F.col("top_k")).select("world", "doc_id").distinct().join(t.select(F.col("task_id").alias("world"), "task_type"), "world")
    return hits.groupBy("task_type").agg(F.countDistinct("world").alias("tasks"), F.count("*").alias("retrieved"))


def plan_hits(spark: SparkSession, d: str) -> DataFrame:
    """One row per task and plan step: does a hit's title and text hold the gold answer, does one name the next link of the chain."""
    p, q, t = task_world(spark, d)
    hits = search(p, q, F.col("top_k")).join(p, ["world", "doc_id"]).withColumn("blob", norm_text(F.concat_ws(" ", "title", "text")))
    hits = hits.groupBy("world", "query_id").agg(F.collect_list("blob").alias("blobs"))
    t = t.select(F.col("task_id").alias("world"), "task_type", "chain", F.filter(F.transform(gold_forms(F.col("gold.kind"), F.col("gold.value")), norm_text), lambda x: x != "").alias("forms"), F.size("oracle_plan").alias("n"))
    j = q.select("world", "query_id", "pos").join(hits, ["world", "query_id"], "left").join(t, "world")
    blobs = F.coalesce("blobs", F.array().cast("array<string>"))
    return j.select("world", "task_type", "pos", "n", F.exists(blobs, lambda b: F.exists("forms", lambda f: F.contains(b, f))).alias("hit"), F.coalesce(F.exists(blobs, lambda b: F.contains(b, norm_text(F.get("chain", F.col("pos") + 1)))), F.lit(False)).alias("names_next"))


_FORMS = f"""list_filter([{norm('v')} for v in case gold.kind when 'any_of' then from_json(gold.value, '["varchar"]') when 'all_of' then [array_to_string(from_json(gold.value, '["varchar"]'), ' ')] when 'none' then [] else [case when gold.value like '"%"' then gold.value[2:-2] else gold.value end] end], lambda v: v <> '')"""
_STEPS = f"""{_PLAN},
    bl as (select hits.world, query_id, list({norm("concat_ws(' ', title, text)")}) as blobs from hits join p using (world, doc_id) group by 1, 2),
    st as (select q0.world, task_type, cast(query_id as integer) as pos, len(oracle_plan) as n, chain, coalesce(blobs, []) as blobs, {_FORMS} as forms
      from q0 join tk on tk.task_id = q0.world left join bl using (world, query_id)),
    steps as (select world, task_type, pos, n, len([1 for b in blobs if len([1 for f in forms if contains(b, f)]) > 0]) > 0 as hit,
      coalesce(chain[pos + 2] is not null and len([1 for b in blobs if contains(b, {norm('chain[pos + 2]')})]) > 0, false) as names_next from st)"""


@query("g02_shortcut", f"with {_JUDGE}, bl as (select hits.world, bool_or(contains({norm("concat_ws(' ', title, text)")}, {norm('answer')})) as hit from hits join p using (world, doc_id) join judge_row on judge_row.id = hits.world group by 1) select id as world, coalesce(hit, false) as shortcut from judge_row left join bl on bl.world = judge_row.id")
def g02(spark, d):
    p, q = judge_world(spark, d)
    gold = table(spark, d, "judge_row", F.col("id").alias("world"), "answer")
    hits = search(p, q, 3).join(p, ["world", "doc_id"]).join(gold, "world")
    hit = hits.groupBy("world").agg(F.bool_or(F.contains(norm_text(F.concat_ws(" ", "title", "text")), norm_text(F.col("answer")))).alias("hit"))
    return gold.join(hit, "world", "left").select("world", F.coalesce("hit", F.lit(False)).alias("shortcut"))


@query("g03_prefix_leak", f"with {_STEPS} select world, coalesce(bool_or(hit) filter (where pos < n - 1), false) as leaky from steps group by 1")
def g03(spark, d):
    return plan_hits(spark, d).groupBy("world").agg(F.coalesce(F.bool_or(F.when(F.col("pos") < F.col("n") - 1, F.col("hit"))), F.lit(False)).alias("leaky"))


@query("g04_broken_chain", f"with {_STEPS} select world, coalesce(bool_or(not names_next) filter (where pos < n - 1), false) as broken from steps group by 1")
def g04(spark, d):
    return plan_hits(spark, d).groupBy("world").agg(F.coalesce(F.bool_or(F.when(F.col("pos") < F.col("n") - 1, ~F.col("names_next"))), F.lit(False)).alias("broken"))


@query("g05_unretrievable", f"with {_STEPS} select world, not bool_or(hit) as unretrievable from steps where pos = n - 1 group by 1")
def g05(spark, d):
    return plan_hits(spark, d).filter(F.col("pos") == F.col("n") - 1).groupBy("world").agg((~F.bool_or("hit")).alias("unretrievable"))


_SUFF = "select world, any_value(task_type) as task_type, bool_or(hit) as retrievable, coalesce(bool_or(hit) filter (where pos = n - 1), false) as in_last_call, min(pos) filter (where hit) as first_hit_call, count(*) as num_calls from steps group by 1"


@query("g08_sufficiency", f"with {_STEPS} {_SUFF}")
def g08(spark, d):
    s = plan_hits(spark, d)
    return s.groupBy("world").agg(
        F.first("task_type").alias("task_type"), F.bool_or("hit").alias("retrievable"), F.coalesce(F.bool_or(F.when(F.col("pos") == F.col("n") - 1, F.col("hit"))), F.lit(False)).alias("in_last_call"),
        F.min(F.when(F.col("hit"), F.col("pos"))).alias("first_hit_call"), F.count("*").alias("num_calls"),
    )


@query("g09_sufficiency_sets", f"with {_STEPS}, s as ({_SUFF}) select task_type, cast(grouping(task_type) as integer) as overall, count(*) as n, round(avg(retrievable::int), 4) as retrievable_rate, round(avg(in_last_call::int), 4) as last_call_rate from s group by grouping sets ((), (task_type))")
def g09(spark, d):
    s = g08(spark, d)
    return s.cube("task_type").agg(F.grouping("task_type").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg(F.col("retrievable").cast("int")), 4).alias("retrievable_rate"), F.round(F.avg(F.col("in_last_call").cast("int")), 4).alias("last_call_rate"))
