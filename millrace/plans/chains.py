"""Resolution of chains with placeholders, and the report on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.chains import MOST_COMBINATIONS, resolve
from millrace.plans.base import TK, tasks
from millrace.plans.reasoning import SPAN_WORDS, _SPANS, spans
from millrace.functions.text import words_bm25
from millrace.registry import query


def is_name(s):
    return F.exists(words_bm25(s), lambda t: ~t.isin(SPAN_WORDS) & (F.length(t) > 2))


def masked_plans(spark, d):
    """Tasks with their own documents, each later query with the name that the hop before reveals taken out for ``#k``."""
    t = tasks(spark, d, "prompt", "documents", "oracle_plan", "route", "chain", "oracle_answer").filter(F.size("documents") > 0)
    plan = F.transform("oracle_plan", lambda s, k: F.when((k > 0) & F.get("chain", k).isNotNull() & (F.get("chain", k) != ""), F.replace(s["arguments"]["query"], F.get("chain", k), F.concat(F.lit("#"), k.cast("string")))).otherwise(s["arguments"]["query"]))
    rows = t.select(F.col("task_id").alias("world"), "prompt", plan.alias("plan"), F.col("route").alias("support"), F.col("oracle_answer").alias("gold"))
    p = t.select(F.col("task_id").alias("world"), F.explode("documents").alias("x")).select("world", "x.doc_id", "x.title", "x.text")
    return rows, p


def resolved(spark, d):
    return resolve(*masked_plans(spark, d), spans, is_name)


@query("g11_resolve")
def g11(spark, d):
    return resolved(spark, d).select("world", "hops", "ok", "reason", F.array_join("queries", " | ").alias("queries"), F.array_join("chain", " > ").alias("chain"), "first_gold_hop")


@query("g12_reject_counts")
def g12(spark, d):
    """Tasks kept and rejected, the hop's number left out of the reason."""
    return resolved(spark, d).groupBy(F.when(F.col("ok"), "kept").otherwise(F.regexp_replace("reason", r"\d+$", "N")).alias("reason")).agg(F.count("*").alias("n"))


@query("g13_chain_report")
def g13(spark, d):
    """Yield by plan length, and substitutions made."""
    made = F.size(F.filter("chain", lambda c: c != ""))
    r = resolved(spark, d).groupBy("hops").agg(F.count("*").alias("seen"), F.count_if("ok").alias("kept"), F.sum(F.when(F.col("ok"), made)).alias("substitutions"))
    return r.withColumn("yield", F.round(F.col("kept") / F.col("seen"), 4))


_SP = _SPANS.replace("text", "x.text")


@query("x07_capped_product", f"with {TK}, dc as (select task_id, unnest(documents) as x from tk), s as (select task_id, x.doc_id as doc_id, len(list_distinct([lower(n) for n in {_SP}][1:24])) as n from dc where x.doc_id in ('0', '1')) select task_id, least(max(n) filter (where doc_id = '0') * max(n) filter (where doc_id = '1'), {MOST_COMBINATIONS})::bigint as combinations from s group by 1 having count(*) = 2")
def x07(spark, d):
    """Pairs of names from the first two passages of a task, as the resolution would try them: capped by its parameter."""
    t = tasks(spark, d, "documents").select("task_id", F.explode("documents").alias("x")).filter("x.doc_id in ('0', '1')")
    n = t.groupBy("task_id").agg(*[F.max(F.when(F.col("x.doc_id") == i, spans(F.col("x.text"), 24))).alias(f"n{i}") for i in "01"], F.count("*").alias("k")).filter("k = 2")
    pairs = F.slice(F.flatten(F.transform("n0", lambda a: F.transform("n1", lambda b: F.struct(a.alias("a"), b.alias("b"))))), 1, MOST_COMBINATIONS)
    return n.select("task_id", F.size(pairs).cast("long").alias("combinations"))
