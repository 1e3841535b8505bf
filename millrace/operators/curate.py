"""Curation of trajectories: quality reasons, best-of-N, de-duplication, caps, rebalancing, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS = 600


def hashed(seed: str, key: Column) -> Column:
    """A reproducible order that depends on the key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def quality_reason() -> Column:
    """First failing check of a scored trajectory; null passes. Columns: success, format_loose, repeated, answer, num_calls, oracle_calls, recovered."""
    bloat = F.col("num_calls") > F.greatest(F.lit(1), F.coalesce("oracle_calls", F.lit(0))) * 2.0 + 1
    return F.coalesce(
        F.when(~F.coalesce("success", F.lit(False)), "not_success"), F.when(~F.coalesce("format_loose", F.lit(False)), "loose_format"), F.when(F.col("repeated"), "repeated_call"),
        F.when(F.length("answer") > MOST_CHARS, "verbose_answer"), F.when(bloat & ~F.col("recovered"), "call_bloat"),
    )


def repeated_call(log: Column) -> Column:
    """Whether the same tool is called twice with the same arguments (as JSON text)."""
    sig = F.transform(log, lambda c: F.concat(c["name"], F.lit(":"), F.coalesce(c["args"], F.lit(""))))
    return F.coalesce(F.size(F.array_distinct(sig)) < F.size(sig), F.lit(False))


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group; ``rank`` is kept."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def first_by_hash(df: DataFrame, by: list[str], order: Column, tie: str, want: str) -> DataFrame:
    """The first ``want`` (a column) rows of each group in the order of a hex hash, ties by ``tie``; ``rank`` is kept.

    A group may hold any part of the rows: rows are counted by the first three digits of their hash, which tells what stands
    before each of the 4,096 parts of a group, and ranked within their part. Parts beyond the wanted rows are not sorted.
    """
    x = df.withColumns({"_h": order}).withColumn("_b", F.substring("_h", 1, 3))
    per = x.groupBy(*by, "_b").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_b").alias("_p"), before.alias("_before"))
    same = [x[c].eqNullSafe(per[f"_g{i}"]) for i, c in enumerate(by)]
    x = x.join(per, [x["_b"] == per["_p"], *same]).filter(F.col("_before") < F.col(want))
    x = x.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", tie)))
    return x.filter(F.col("rank") <= F.col(want)).drop("_h", "_b", "_p", "_before", *[f"_g{i}" for i in range(len(by))])


def rebalance(df: DataFrame, kind: str, id_col: str, target: dict[str, float], seed: str = "mix") -> DataFrame:
    """The largest subset whose kinds have the target shares: the kind that is shortest sets the size. Kinds without target get none."""
    share = F.create_map(*[x for k, v in sorted(target.items()) for x in (F.lit(k), F.lit(float(v)))])[F.col(kind)]
    counts = df.groupBy(kind).agg(F.count("*").alias("n")).withColumn("share", share).filter("share > 0")
    size = counts.agg(F.min(F.col("n") / F.col("share"))).scalar()
    want = counts.withColumn("want", F.floor(size * F.col("share") + 1e-9)).select(kind, "want")
    # One row a kind that has a target, so its size is that of the target.
    ranked = df.join(F.broadcast(want), kind)
    return first_by_hash(ranked, [kind], hashed(seed, F.col(id_col)), id_col, "want").drop("want")
