"""Placeholders in chains of searches, resolved hop by hop over all candidate sets at once.

A plan's query may hold ``#n``, what hop n has found. Every hop makes the possible substitutions of all tasks, asks them in
one batch of BM25 and keeps the best of each task, so that a hop is a few joins whatever the number of tasks; a plan has a
handful of hops, and the state between two is written to the shared folder.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import invented_names, norm_text, tidy, words_bm25
from millrace.operators.retrieval import search
from millrace.session import written

#: Most names tried for a placeholder, and most substitutions of a query; parameters of the search that bound one task's work.
MOST_NAMES, MOST_COMBINATIONS = 40, 400
_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) == 2 and unicodedata.combining(unicodedata.normalize("NFKD", chr(c))[1])]


def plain_latin(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, "".join(_ACCENTED), "".join(unicodedata.normalize("NFKD", x)[0] for x in _ACCENTED))


def _once(names: Column) -> Column:
    low = F.transform(names, F.lower)
    return F.filter(names, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def _names(found: Column, asked: Column, is_name) -> Column:
    """Names that a hop's hits offer for its placeholder: each once, not only restating the words of the hop's own query."""
    own = words_bm25(plain_latin(asked))
    fresh = lambda s: F.size(F.array_except(words_bm25(plain_latin(s)), own)) > 0
    return F.slice(F.filter(_once(found), lambda s: is_name(s) & fresh(s)), 1, MOST_NAMES)


def resolve(tasks: DataFrame, passages: DataFrame, spans, is_name, hops: int = 4, top_k: int = 3, leak_free: bool = True, full_coverage: bool = False) -> DataFrame:
    """world, hops, ok, reason, queries, chain, first_gold_hop of every task.

    tasks: world, prompt, plan (array of queries), support (array of doc_id), gold (text). passages: world, doc_id, title,
    text. ``spans`` gives the names in a text, ``is_name`` whether a text has a word that tells something.

    Of a query's substitutions the one is kept whose names occur in the first supporting passage not seen yet that it finds,
    then by that passage's rank, then by how many such it finds, then the first. A task fails with the first reason met:
    empty_plan, unresolvable_placeholder_hopN, substitution_not_in_evidence_hopN, unresolved_hopN, no_new_evidence_hopN,
    psychic_query_hopN, then over all hops support_not_covered, gold_never_retrieved, gold_leaks_at_hopN,
    psychic_first_query. Plans longer than ``hops`` fail as too_long. Null plans and prompts are empty.
    """
    strings = "array<string>"
    none = F.array().cast(strings)
    p = written(passages.select("world", "doc_id", "title", "text", norm_text(F.concat_ws(" ", "title", "text")).alias("blob"), spans(F.coalesce("text", F.lit(""))).alias("names")), "passages")
    plan = F.coalesce("plan", none)
    state = tasks.select(
        "world", F.coalesce("prompt", F.lit("")).alias("prompt"), plan.alias("plan"), norm_text(F.col("gold")).alias("gold"), F.array_distinct(F.coalesce("support", none)).alias("unused"),
        F.create_map().cast("map<int,string>").alias("env"), F.coalesce("prompt", F.lit("")).alias("seen"), none.alias("queries"), none.alias("chain"), F.array().cast(f"array<{strings}>").alias("offers"), F.lit(None).cast("int").alias("first_gold_hop"),
        F.when(F.size(plan) == 0, "empty_plan").when(F.size(plan) > hops, "too_long").alias("reason"),
    )
    for k in range(hops):
        open_ = F.col("reason").isNull() & (F.size("plan") > k)
        raw = F.col("plan")[k]
        refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(r"#(\d+)"), F.lit(1)), lambda n: n.cast("int"))))
        go = state.filter(open_).withColumn("refs", refs).withColumn("needed", F.array_except("refs", F.map_keys("env")))
        offer = lambda n: F.coalesce(_names(F.get("offers", n - 1), F.get("plan", n - 1), is_name), none)
        go = go.withColumn("names", F.map_from_arrays("needed", F.transform("needed", offer)))
        every = F.aggregate("needed", F.array(F.create_map().cast("map<int,string>")), lambda acc, n: F.slice(F.flatten(F.transform(acc, lambda c: F.transform(F.col("names")[n], lambda v: F.map_concat(c, F.create_map(n, v))))), 1, MOST_COMBINATIONS))
        go = written(go.withColumn("combos", every), f"hop{k}")
        fill = lambda env: F.aggregate(F.sort_array("refs", asc=False), F.col("plan")[k], lambda q, n: F.coalesce(F.replace(q, F.concat(F.lit("#"), n.cast("string")), env[n]), q))
        tried = go.select("world", "unused", "plan", "refs", "env", F.posexplode("combos").alias("i", "combo"))
        tried = tried.withColumn("query", fill(F.map_concat("env", "combo"))).withColumn("query_id", F.col("i").cast("string"))
        hit = search(p.select("world", "doc_id", "title", "text"), tried.select("world", "query_id", "query"), top_k).join(p.select("world", "doc_id", "title", "blob", "names"), ["world", "doc_id"])
        hit = hit.groupBy("world", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "blob", "names"))).alias("hits"))
        tried = tried.join(hit, ["world", "query_id"], "left").withColumn("hits", F.coalesce("hits", F.array().cast(hit.schema["hits"].dataType)))
        tried = tried.withColumn("new", F.filter("hits", lambda h: F.array_contains("unused", h["doc_id"])))
        occurs = (F.size("new") > 0) & F.forall(F.map_values("combo"), lambda v: (norm_text(v) != "") & F.contains(F.get("new", F.lit(0))["blob"], norm_text(v)))
        rank = F.coalesce(F.get("new", F.lit(0))["rank"] - 1, F.lit(99))
        miss = F.when(occurs, 0).otherwise(1)
        order = F.struct(miss.alias("miss"), rank.alias("rank"), F.when((miss == 0) & (rank == 0), 0).otherwise(-F.size("new")).alias("fewer"), "i")
        best = tried.groupBy("world").agg(F.min_by(F.struct("query", "combo", "hits", "new", miss.alias("miss")), order).alias("b"))
        go = go.join(best, "world", "left")
        b, hop = F.col("b"), str(k + 1)
        query = tidy(b["query"])
        psychic = F.size(invented_names(query, F.col("seen"))) > 0 if k else F.lit(False)
        reason = (
            F.when(F.size("combos") == 0, f"unresolvable_placeholder_hop{hop}").when((F.size(b["combo"]) > 0) & (b["miss"] != 0), f"substitution_not_in_evidence_hop{hop}").when(F.contains(b["query"], F.lit("#")), f"unresolved_hop{hop}")
            .when(F.size(b["new"]) == 0, f"no_new_evidence_hop{hop}").when(psychic, f"psychic_query_hop{hop}")
        )
        env = F.map_concat("env", F.coalesce(b["combo"], F.create_map().cast("map<int,string>")))
        blobs = F.transform(b["hits"], lambda h: h["blob"])
        offers = F.concat(F.transform(b["hits"], lambda h: h["title"]), F.flatten(F.transform(b["hits"], lambda h: h["names"])))
        named = F.when(F.array_contains("refs", k), F.coalesce(env[k], F.lit(""))).otherwise("") if k else F.lit("")
        gold_here = (F.col("gold") != "") & F.exists(blobs, lambda x: F.contains(x, F.col("gold")))
        done = go.select(
            "world", "prompt", "plan", "gold", F.array_except("unused", F.transform(b["new"], lambda h: h["doc_id"])).alias("unused"), env.alias("env"), F.concat_ws(" ", "seen", F.array_join(blobs, " ")).alias("seen"),
            F.concat("queries", F.array(query)).alias("queries"), F.concat("chain", F.array(named)).alias("chain"), F.concat("offers", F.array(offers)).alias("offers"),
            F.coalesce("first_gold_hop", F.when(gold_here, F.lit(k + 1))).alias("first_gold_hop"), reason.alias("reason"),
        )
        state = written(state.filter(~open_ | open_.isNull()).select(*done.columns).unionAll(done), f"state{k}")
    first = F.col("first_gold_hop")
    last = (
        F.when(F.lit(full_coverage) & (F.size("unused") > 0), "support_not_covered").when(first.isNull(), "gold_never_retrieved").when(F.lit(leak_free) & (first != F.size("plan")), F.concat(F.lit("gold_leaks_at_hop"), first.cast("string")))
        .when(F.size(invented_names(F.col("queries")[0], F.col("prompt"))) > 0, "psychic_first_query")
    )
    reason = F.coalesce("reason", last)
    return state.select("world", F.size("plan").alias("hops"), reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"), "queries", "chain", "first_gold_hop")
