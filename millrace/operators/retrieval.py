"""BM25 retrieval over many small candidate sets (worlds) at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import words_bm25

K1, B, TITLE_BOOST = 1.5, 0.75, 1.6


def index(passages: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of passages (world, doc_id, title, text).

    documents: world, doc_id, length, and per world n and avg. postings: world, doc_id, term, tf, df, in_title; only the
    terms of ``wanted`` (world, term) if given, so that nothing is counted that no query asks for.
    """
    p = passages.withColumn("_toks", words_bm25(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))))
    p = p.select("world", "doc_id", "_toks", words_bm25(F.coalesce("title", F.lit(""))).alias("_title"), F.size("_toks").alias("length"))
    per = p.groupBy("world").agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
    docs = p.select("world", "doc_id", "length").join(per, "world")
    t = p.select("world", "doc_id", F.explode("_toks").alias("term"), "_title")
    if wanted is not None:
        t = t.join(wanted.select("world", "term").distinct(), ["world", "term"], "left_semi")
    post = t.groupBy("world", "doc_id", "term").agg(F.count("*").alias("tf"), F.first(F.array_contains("_title", F.col("term"))).alias("in_title"))
    return docs, post.withColumn("df", F.count("*").over(Window.partitionBy("world", "term")))


def score_terms(n: Column, avg: Column, df: Column, tf: Column, length: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.when(avg > 0, avg).otherwise(1.0)))


def search(passages: DataFrame, queries: DataFrame, top_k: int | Column = 3) -> DataFrame:
    """Hits (world, query_id, rank, doc_id, score) of queries (world, query_id, query) in their own world.

    A document's score is folded over the query's tokens in order, repeats included: a token that the document has adds
    its weight, and if the title has it too, the score so far is multiplied. Only scores above 0 count; ties go to the
    smaller doc_id as text. top_k is clamped to 1..10, null is 3. Ranks are those of the unrounded scores, compared to ten places so that the order in
    which floats were added decides nothing; the score returned is rounded to four.
    """
    k = F.least(F.greatest(F.coalesce((top_k if isinstance(top_k, Column) else F.lit(top_k)).cast("int"), F.lit(3)), F.lit(1)), F.lit(10))
    q = queries.select("world", "query_id", k.alias("_k"), F.posexplode(words_bm25(F.col("query"))).alias("pos", "term"))
    docs, post = index(passages, q)
    hit = q.join(post, ["world", "term"]).join(docs, ["world", "doc_id"])
    w = score_terms(F.col("n"), F.col("avg"), F.col("df"), F.col("tf"), F.col("length"))
    hit = hit.groupBy("world", "query_id", "doc_id", "_k").agg(F.sort_array(F.collect_list(F.struct("pos", w.alias("w"), F.when(F.col("in_title"), F.lit(TITLE_BOOST)).otherwise(F.lit(1.0)).alias("b")))).alias("_s"))
    hit = hit.withColumn("score", F.aggregate("_s", F.lit(0.0), lambda a, x: (a + x["w"]) * x["b"])).filter("score > 0")
    order = Window.partitionBy("world", "query_id").orderBy(F.desc(F.round("score", 10)), F.col("doc_id").cast("string"))
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("_k")).select("world", "query_id", "rank", "doc_id", F.round("score", 4).alias("score"))
