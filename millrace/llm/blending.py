"""Problem 7: sources mixed to target weights by systematic sampling.

Every document of a source gets the same expected number of copies, target size / size of the source, at most
``max_repeats``. The expected copies are prefix-summed within the source in hashed order, one random offset is added, and
a document is emitted once for each integer that the running sum crosses: each document comes floor(e) or ceil(e) times.
As all documents of a source have the same e, the running sum at its i-th document is i times e, and what is summed up are
counts, exact at any size. They are summed in three levels: rows are dealt into hashed blocks of bounded size, blocks into
groups, and each level is summed only within the one above it, so that one source may hold any part of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Rows that a block holds about, and blocks of a group.
BLOCK_ROWS, GROUP_BLOCKS = 20_000, 4096
#: The table of sources is joined by broadcast; a larger one is refused.
MOST_SOURCES = 200_000


@dataclass
class Blend:
    rows: DataFrame  # id, source, copy (1, 2, ...)
    report: DataFrame  # one row per source of the weights


def blend(docs: DataFrame, weights: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = 0) -> Blend:
    """Mix ``docs`` (id, source, size) so that each source of ``weights`` (source, target_share, max_repeats) gets its share.

    The target size of a source is its share of the size of all documents, those without source and those of sources not
    listed included. A source is ``short`` if max_repeats times its size is less than its target size; it is then repeated
    max_repeats times. Shares reached are those of the emitted size.

    Null sizes count as 0, null sources belong to no target, null shares and repeats are 0; documents with a null id take
    part like others. Repeated ids are documents of their own. With no documents every source with a positive share is
    not short (its target is 0) and nothing is emitted; with no weights both results are empty. The result depends on
    (seed, id) only. Other columns are ignored.
    """
    if weights.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"))
    rows = written(rows, "sizes")  # sizes cost a tokenizer run; they are needed three times
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("_size").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    n_rows = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).scalar()
    plan = weights.select("source", F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"))
    plan = plan.join(sizes, "source", "left").fillna(0, ["n_docs", "size"]).withColumn("target_size", F.col("target_share") * total)
    expected = F.when(F.col("size") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_size") / F.col("size"))).otherwise(0.0)
    plan = plan.withColumn("expected_copies", expected).withColumn("short", F.col("max_repeats") * F.col("size") < F.col("target_size"))

    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 52)).cast("double") / float(1 << 52)
    r = rows.join(F.broadcast(plan.select("source", F.col("expected_copies").alias("_e"), offset.alias("_off")).filter("_e > 0")), "source")
    h = F.xxhash64(F.lit(seed), F.col("_id").cast("string"))
    r = r.withColumn("_h", h).withColumn("_block", F.pmod(h, F.floor(n_rows / BLOCK_ROWS).cast("long") + 1))
    block = r.groupBy("source", "_block").agg(F.count("*").alias("_k")).withColumn("_group", F.floor(F.col("_block") / GROUP_BLOCKS))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    group = block.groupBy("source", "_group").agg(F.sum("_k").alias("_k")).select("source", "_group", F.coalesce(F.sum("_k").over(before("source", "_group")), F.lit(0)).alias("_earlier"))
    block = block.withColumn("_within", F.coalesce(F.sum("_k").over(before("source", "_group", "_block")), F.lit(0)))
    block = block.join(group, ["source", "_group"]).select("source", "_block", (F.col("_earlier") + F.col("_within")).alias("_before"))
    inside = Window.partitionBy("source", "_block").orderBy("_h", "_id")
    r = r.withColumn("_i", F.row_number().over(inside)).join(block, ["source", "_block"]).withColumn("_i", F.col("_i") + F.col("_before"))
    upto = lambda i: F.floor(i * F.col("_e") + F.col("_off"))
    copies = (upto(F.col("_i")) - upto(F.col("_i") - 1)).cast("int")
    drawn = written(r.select("_id", "source", "_size", copies.alias("_copies")).filter("_copies > 0"), "blend")
    out = drawn.select(F.col("_id").alias(id_col), "source", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    got = drawn.groupBy("source").agg(F.sum("_copies").alias("emitted"), F.sum(F.col("_size") * F.col("_copies")).alias("emitted_size"))
    report = plan.join(got, "source", "left").fillna(0, ["emitted", "emitted_size"])
    whole = got.agg(F.coalesce(F.sum("emitted_size"), F.lit(0))).scalar()
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("emitted_size") / whole).otherwise(0.0))
    return Blend(out, report)

