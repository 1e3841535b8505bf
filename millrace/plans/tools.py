"""Tools: argument validation, dispatch, rank equivalence, a registry with table function, replays with corruption, episodes in rounds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.retrieval import B, K1, TITLE_BOOST, search
from millrace.plans.base import TK, TR, tasks, trajectories
from millrace.plans.episodes import _LOG, calls
from millrace.plans.retrieval import _JP, _JQ, _JUDGE, _bm25_sql, judge_world
from millrace.registry import query

#: The one tool of the builtin environment: its arguments, their types, and which must be given.
SEARCH = {"name": "search", "arguments": {"query": "string", "top_k": "integer"}, "required": ["query"]}
ENVIRONMENTS: dict[str, Callable[[], list[dict]]] = {"builtin": lambda: [SEARCH]}


def registry_of(name: str) -> list[dict]:
    """The tools of an environment by name."""
    if name not in ENVIRONMENTS:
        raise ValueError(f"no environment {name!r}; there are {sorted(ENVIRONMENTS)}")
    return ENVIRONMENTS[name]()


def argument_error(args: Column) -> tuple[Column, Column]:
    """The first thing wrong with the arguments of ``search`` (JSON text), and whether they were coerced; null is an empty object.

    In order: not an object, an unknown name, a required one missing or null, a wrong type. "20" and 20.0 pass as integers
    and count as coerced; a boolean never does.
    """
    v = F.try_parse_json(F.coalesce(args, F.lit("{}")))
    names = F.json_object_keys(args)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    text = lambda k: F.get_json_object(args, f"$.{k}")
    k = kind("top_k")
    number = text("top_k").try_cast("double")
    whole = k.startswith("DECIMAL") | (k == "DOUBLE")
    fits = k.isNull() | (k == "BIGINT") | (whole & (number == F.floor(number))) | ((k == "STRING") & text("top_k").rlike(r"^\s*[+-]?\d+\s*$"))
    error = (
        F.when(v.isNull() | ~F.coalesce(args, F.lit("{}")).rlike(r"^\s*\{"), "not_object").when(F.exists(names, lambda n: ~n.isin(list(SEARCH["arguments"]))), "unknown_argument")
        .when(text("query").isNull(), "missing_argument").when((kind("query") != "STRING") | ~fits, "wrong_type")
    )
    return error, error.isNull() & F.coalesce((k == "STRING") | whole, F.lit(False))


_TT = "json_type(args, '$.top_k')"
_TV = "json_extract_string(args, '$.top_k')"
_ARGS = f"""case when try_cast(args as json) is null or not regexp_matches(coalesce(args, '{{}}'), '^\\s*\\{{') then 'not_object' when len([k for k in json_keys(args) if k not in ('query', 'top_k')]) > 0 then 'unknown_argument'
  when coalesce(json_type(args, '$.query'), 'NULL') = 'NULL' then 'missing_argument'
  when json_type(args, '$.query') <> 'VARCHAR' or not ({_TT} is null or {_TT} in ('NULL', 'UBIGINT', 'BIGINT') or ({_TT} = 'DOUBLE' and try_cast({_TV} as double) = floor(try_cast({_TV} as double))) or ({_TT} = 'VARCHAR' and regexp_matches({_TV}, '^\\s*[+-]?\\d+\\s*$'))) then 'wrong_type' end"""


@query("t15_validate_args", f"with {_LOG}, e as (select task_id, idx, {_ARGS} as error, {_TT} as tt from lg) select task_id, idx, error, error is null and coalesce(tt in ('VARCHAR', 'DOUBLE'), false) as coerced from e")
def t15(spark, d):
    error, coerced = argument_error(F.col("args"))
    return calls(spark, d).select("task_id", "idx", error.alias("error"), coerced.alias("coerced"))


#: Fixed rows: forms of arguments that the tables may lack.
ARGUMENTS = ['{"query": "a"}', '{"query": "a", "top_k": 3}', '{"query": "a", "top_k": "20"}', '{"query": "a", "top_k": 3.0}', '{"query": "a", "top_k": 3.5}', '{"query": "a", "top_k": true}', '{"query": 5}', '{"query": null}', "{}", '{"q": "a"}', "[1]", "nonsense", '{"query": "a", "top_k": "x"}']


@query("pr16_argument_forms", f"with f as (select unnest([{', '.join(repr(a) for a in ARGUMENTS)}]) as args), e as (select args, {_ARGS} as error, {_TT} as tt from f where try_cast(args as json) is not null) select args, error, error is null and coalesce(tt in ('VARCHAR', 'DOUBLE'), false) as coerced from e union all select args, 'not_object', false from f where try_cast(args as json) is null")
def pr16(spark, d):
    error, coerced = argument_error(F.col("args"))
    return spark.createDataFrame([(a,) for a in ARGUMENTS], "args string").select("args", error.alias("error"), coerced.alias("coerced"))


@query("r05_dispatch", f"with {_LOG}, e as (select case when name <> 'search' then 'unknown_tool' when {_ARGS} is not null then 'invalid_arguments' when not regexp_matches(lower(json_extract_string(args, '$.query')), '[a-z0-9]') then 'empty_query' else 'ok' end as outcome, case when name <> 'search' then 'available tools: search' end as hint from lg) select outcome, hint, count(*) as n from e group by 1, 2")
def r05(spark, d):
    """What the registry answers to each recorded call: an unknown tool (with the names that begin alike, else all), bad arguments, an empty query, or hits."""
    names = [t["name"] for t in registry_of("builtin")]
    close = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.startswith(n, F.substring("name", 1, 4)))
    hint = F.concat(F.lit("available tools: "), F.array_join(F.when(F.size(close) > 0, close).otherwise(F.array(*[F.lit(n) for n in names])), ", "))
    error, _ = argument_error(F.col("args"))
    known = F.col("name").isin(names)
    empty = ~F.lower(F.get_json_object("args", "$.query")).rlike("[a-z0-9]")
    outcome = F.when(~known, "unknown_tool").when(error.isNotNull(), "invalid_arguments").when(empty, "empty_query").otherwise("ok")
    return calls(spark, d).select(outcome.alias("outcome"), F.when(~known, hint).alias("hint")).groupBy("outcome", "hint").agg(F.count("*").alias("n"))


def fold_rank(docs: list[tuple[str, str, str]], text: str, k: int) -> list[str]:
    """BM25 by its definition over one candidate set (doc_id, title, text): ids of the best, for checks and the table function."""
    cut = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    words = [Counter(cut(f"{t or ''} {x or ''}")) for _, t, x in docs]
    size = [sum(w.values()) for w in words]
    mean = sum(size) / max(1, len(size)) or 1.0
    scored = []
    for (i, title, _), tf, n in zip(docs, words, size):
        score, heads = 0.0, set(cut(title))
        for w in cut(text):
            if tf[w]:
                df = sum(w in x for x in words)
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * n / mean))
                score *= TITLE_BOOST if w in heads else 1.0
        if score > 0:
            scored.append((-round(score, 10), i))
    return [i for _, i in sorted(scored)[: max(1, min(k, 10))]]


@query("r07_rank_equivalence", f"with {_JUDGE} select world, string_agg(doc_id, ',' order by rank) as ranking from hits group by 1")
def r07(spark, d):
    """The ranking by the plain fold in Arrow batches, one candidate set a row; the SQL ranks by joins, as ``search`` does."""
    p, q = judge_world(spark, d)
    sets = p.groupBy("world").agg(F.collect_list(F.struct("doc_id", "title", "text")).alias("docs"))  # a candidate set is some twenty passages

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [",".join(fold_rank([(x["doc_id"], x["title"], x["text"]) for x in docs], text, 3)) for docs, text in zip(b["docs"], b["query"])]
            yield pd.DataFrame({"world": b["world"], "ranking": got})

    return sets.join(q, "world").select("world", "docs", "query").mapInPandas(rank, "world string, ranking string").filter("ranking <> ''")


def register_search(spark: SparkSession, name: str = "mr_search") -> None:
    """The table function ``name(docs, query, k)`` over one candidate set: rank and doc_id of each hit."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="rank int, doc_id string")
    class Search:
        def eval(self, docs, text, k):
            yield from enumerate(fold_rank([(x["doc_id"], x["title"], x["text"]) for x in docs or []], text or "", 3 if k is None else k), 1)

    spark.udtf.register(name, Search)


@query("u01_search_function", f"with {_bm25_sql(_JP, _JQ, '5')} select world, cast(rank as integer) as rank, doc_id from hits")
def u01(spark, d):
    register_search(spark)
    p, q = judge_world(spark, d)
    sets = p.groupBy("world").agg(F.collect_list(F.struct("doc_id", "title", "text")).alias("docs")).join(q, "world")
    sets.createOrReplaceTempView("mr_candidate_sets")
    return spark.sql("select world, h.rank, h.doc_id from mr_candidate_sets, lateral mr_search(docs, query, 5) h")


@query("t54_error_payloads", f"with {_LOG}, e as (select name, case when name <> 'search' then 'unknown_tool' else {_ARGS} end as kind from lg) select kind, '{{\"error\":\"' || kind || '\",\"message\":\"' || replace(kind, '_', ' ') || '\"' || case when name <> 'search' then ',\"hint\":\"available tools: search\"' else '' end || '}}' as payload, count(*) as n from e where kind is not null group by 1, 2")
def t54(spark, d):
    kind = F.when(F.col("name") != "search", "unknown_tool").otherwise(argument_error(F.col("args"))[0])
    hint = F.when(F.col("name") != "search", "available tools: search")
    e = calls(spark, d).select(kind.alias("kind"), hint.alias("hint")).filter("kind is not null")
    return e.select("kind", F.to_json(F.struct(F.col("kind").alias("error"), F.replace("kind", F.lit("_"), F.lit(" ")).alias("message"), "hint")).alias("payload")).groupBy("kind", "payload").agg(F.count("*").alias("n"))


@query("u02_tool_schemas", "select 'search' as name, 'query,top_k' as arguments, 'query' as required")
def u02(spark, d):
    tools = [(t["name"], ",".join(sorted(t["arguments"])), ",".join(t["required"])) for t in registry_of("builtin")]
    return spark.createDataFrame(tools, "name string, arguments string, required string")


ARMS = {"none": 0.0, "some": 0.1, "many": 0.3}


def corrupted(plan: DataFrame, rate: Column, key: Column) -> DataFrame:
    """plan (task_id, step) with ``fault`` (bad_args, early_stop, wrong_tool or null) drawn from the hash of ``key``, and ``degraded`` from the first fault on."""
    h = F.sha1(key)
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0
    kind = F.element_at(F.array(*[F.lit(x) for x in ("bad_args", "early_stop", "wrong_tool")]), (F.conv(F.substring(h, 9, 4), 16, 10).cast("int") % 3 + 1).cast("int"))
    e = plan.withColumn("fault", F.when(u < rate, kind))
    w = Window.partitionBy("arm", "task_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("degraded", F.max(F.col("fault").isNotNull()).over(w))


_ARMS = "(values " + ", ".join(f"('{k}', {v}::double)" for k, v in ARMS.items()) + ") a(arm, rate)"
_HEX = lambda a, n: f"('0x' || sha1(arm || '|' || task_id || '|' || step)[{a}:{a + n - 1}])::bigint"
_MOCK = f"""{TK}, st as (select task_id, generate_subscripts(oracle_plan, 1) - 1 as step, len(oracle_plan) as n from tk where len(oracle_plan) > 0),
  f as (select arm, task_id, step, n, case when {_HEX(1, 8)} / 4294967296.0::double < rate then ['bad_args', 'early_stop', 'wrong_tool'][{_HEX(9, 4)} % 3 + 1] end as fault from st, {_ARMS})"""


def _mock(spark, d):
    arms = F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.lit(v).alias("rate")) for k, v in ARMS.items()]))
    plan = tasks(spark, d, "oracle_plan").select("task_id", F.size("oracle_plan").alias("n"), F.posexplode("oracle_plan").alias("step", "s")).select("task_id", "n", "step", arms.alias("a")).select("task_id", "n", "step", "a.*")
    return corrupted(plan, F.col("rate"), F.concat_ws("|", "arm", "task_id", F.col("step").cast("string")))


@query("g17_mock_replay", f"with {_MOCK} select arm, task_id, step, fault, bool_or(fault is not null) over (partition by arm, task_id order by step) as degraded from f")
def g17(spark, d):
    return _mock(spark, d).select("arm", "task_id", "step", "fault", "degraded")


@query("g17_ablation", f"with {_MOCK}, t as (select arm, task_id, bool_or(fault is not null) as wrong, min(step) filter (where fault = 'early_stop') as stopped, any_value(n) as n from f group by 1, 2) select arm, count(*) as tasks, round(avg((not wrong)::int), 4) as correct, round(avg(coalesce(stopped, n)), 4) as calls from t group by 1")
def g17b(spark, d):
    t = _mock(spark, d).groupBy("arm", "task_id").agg(F.max("degraded").alias("wrong"), F.min(F.when(F.col("fault") == "early_stop", F.col("step"))).alias("stopped"), F.first("n").alias("n"))
    return t.groupBy("arm").agg(F.count("*").alias("tasks"), F.round(F.avg((~F.col("wrong")).cast("int")), 4).alias("correct"), F.round(F.avg(F.coalesce("stopped", "n")), 4).alias("calls"))


_ROUNDS = f"{TR}, e as (select task_id, coalesce(len(steps), 0) as n, stop_reason from tr), r as (select task_id, n, stop_reason, unnest(generate_series(1, least(greatest(n, 1), 10))) as round from e)"


@query("st1_rounds", f"with {_ROUNDS} select round::integer as round, count(*) as live, count(*) filter (where round = n and n <= 10) as finished, count(*) filter (where round = n and n <= 10 and stop_reason = 'answered') as answered, count(*) filter (where round = 10 and n > 10) as cut from r group by 1")
def st1(spark, d):
    """Episodes advanced in lock-step: how many are live in each round, and how they leave it. A round is one step of every live episode."""
    e = trajectories(spark, d, "steps", "stop_reason").select("task_id", F.coalesce(F.size("steps"), F.lit(0)).alias("n"), "stop_reason").withColumn("n", F.greatest("n", F.lit(0)))
    r = e.withColumn("round", F.explode(F.sequence(F.lit(1), F.least(F.greatest("n", F.lit(1)), F.lit(10)))))
    ends = (F.col("round") == F.col("n")) & (F.col("n") <= 10)
    return r.groupBy("round").agg(F.count("*").alias("live"), F.count_if(ends).alias("finished"), F.count_if(ends & (F.col("stop_reason") == "answered")).alias("answered"), F.count_if((F.col("round") == 10) & (F.col("n") > 10)).alias("cut"))


@query("st10_call_log", f"with {_LOG} select task_id, count(*) as n, string_agg(idx || ':' || name || ':' || case when ok then 'ok' else 'error' end, ' ' order by idx) as log from lg group by 1")
def st10(spark, d):
    """The log that a session's calls append to, as one line an episode."""
    line = F.concat(F.col("idx").cast("string"), F.lit(":"), "name", F.lit(":"), F.when(F.col("ok"), "ok").otherwise("error"))
    return calls(spark, d).groupBy("task_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), " ").alias("log"))
