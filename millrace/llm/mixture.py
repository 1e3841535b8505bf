"""Problem 1: a sample whose categories have given target shares.

One pass folds every row into a mergeable reservoir of its category. A reservoir is a bottom-k sample by a
hashed key in [0, 1), held as counts per key slice instead of as rows: two reservoirs merge by adding their
counts, a hot category needs no more memory than a small one, and no row leaves its partition. When the final
counts are known, quotas are set and each reservoir is trimmed: whole slices below the threshold slice are taken,
and only the rows of that one slice are ranked. Every subset of a category of the quota's size is equally likely.
The reservoirs are written once; the report counts the rows that were drawn.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import written

#: Slices of a reservoir at least, and rows of the pool for each; keys have KEY_BITS bits, of which a slice is the first ones.
SLICES, SLICE_ROWS, KEY_BITS = 4096, 50_000, 62
#: Cells are a stated, bounded table; more than this is refused rather than broadcast.
MOST_CELLS = 100_000


@dataclass
class Sample:
    rows: DataFrame  # mix_name, cell_id, <id>
    report: DataFrame  # one row per cell


def _key(dims: list[Column], kept: int) -> Column:
    """The row's values under one pattern of wildcards, as text that keeps nulls and separators apart."""
    parts = [F.to_json(F.struct(d.cast("string").alias("v"))) if kept >> i & 1 else F.lit("*") for i, d in enumerate(dims)]
    return F.concat_ws("|", F.lit(str(kept)), *parts)


def _allot(cells: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one mix: target shares of the sample, floors, then what is missing spread over cells with spare rows."""
    c = cells.sort_values("cell_id").reset_index(drop=True)
    size = int(c["sample_rows"].iloc[0])
    want = (c["target_share"].fillna(0) * size).clip(lower=0)
    quota = want.astype("int64")
    rest = min(int(round(float(want.sum()))), size) - int(quota.sum())
    for i in (want - quota).sort_values(ascending=False, kind="stable").index[: max(0, rest)]:
        quota[i] += 1
    floor = c["min_rows"].fillna(0).astype("int64")
    quota = pd.concat([quota, floor], axis=1).max(axis=1)
    have = pd.concat([quota, c["assigned"]], axis=1).min(axis=1)
    # Floors may take more than the sample holds. First the cells above their floors give up rows, then the floors shrink.
    for least in (pd.concat([floor, have], axis=1).min(axis=1), have * 0):
        over, room = int(have.sum()) - size, have - least
        if over <= 0 or int(room.sum()) == 0:
            continue
        off = room * min(1.0, over / int(room.sum()))
        less = off.astype("int64")
        for i in (off - less).sort_values(ascending=False, kind="stable").index[: min(over, int(room.sum())) - int(less.sum())]:
            less[i] += 1
        have = have - less
    while (missing := size - int(have.sum())) > 0:
        spare = (c["assigned"] - have).where(c["target_share"].fillna(0) > 0, 0)
        if int(spare.sum()) == 0:
            break
        weight = c["target_share"].fillna(0).where(spare > 0, 0)
        more = pd.concat([(missing * weight / weight.sum()).astype("int64"), spare], axis=1).min(axis=1)
        if int(more.sum()) == 0:
            for i in spare[spare > 0].sort_values(ascending=False, kind="stable").index[:missing]:
                more[i] += 1
        have = have + more
    c["quota"], c["taken"] = quota, have.astype("int64")
    c["below"] = c["taken"] < pd.concat([floor.astype("float64"), want], axis=1).max(axis=1).round(9).apply(math.floor)
    return c


def proportional_sample(rows: DataFrame, cells: DataFrame, id_col: str, dims: list[str], seed: int = 0, slices: int | None = None) -> Sample:
    """Sample ``rows`` once per mix of ``cells``.

    rows: one row per ``id_col`` (the caller decides which delivery counts) with the columns ``dims``.
    cells: mix_name, cell_id, sample_share, ``dims`` (null: any value), target_share, min_rows.
    A row counts as available to every cell that it matches; in the sample it stands for the most specific one
    (ties: smallest cell_id). A cell is ``unmet`` if fewer rows match than max(min_rows, target_share * sample rows), and
    ``below`` if it takes fewer than that. No mix takes more than its sample rows: floors beyond them shrink in proportion.

    Nulls: a null dimension matches only cells that leave it open; rows with a null id are left out; a null share
    counts as 0. Empty rows: every cell with a positive demand is unmet and nothing is sampled. Empty cells: empty
    results. Repeated ids are sampled like different rows. Other columns of ``rows`` are ignored, so clashing names do
    no harm. The sample is a function of (seed, id) only, whatever the partitioning.
    """
    spark = rows.sparkSession
    n = len(dims)
    pool = rows.select(F.col(id_col).alias("_id"), *[F.col(d).cast("string").alias(f"_d{i}") for i, d in enumerate(dims)]).filter(F.col("_id").isNotNull())
    d = [F.col(f"_d{i}") for i in range(n)]
    n_rows = pool.count()
    # More rows, narrower slices: the order of the keys, and with it the sample, stays the same.
    bits = max(1, math.ceil(math.log2(slices or max(SLICES, n_rows / SLICE_ROWS))))
    pool = pool.withColumn("_u", F.xxhash64(F.lit(seed), F.col("_id").cast("string")).bitwiseAND((1 << KEY_BITS) - 1))
    pool = pool.withColumn("_slice", F.shiftright("_u", KEY_BITS - bits).cast("int"))
    slices = 1 << bits

    plan = cells.select(
        "mix_name", "cell_id", F.col("sample_share").cast("double"), F.col("target_share").cast("double"), F.col("min_rows").cast("long"),
        *[F.col(x).cast("string").alias(f"_d{i}") for i, x in enumerate(dims)],
    )
    if plan.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    kept = F.expr(" + ".join(f"if(_d{i} is null, 0, {1 << i})" for i in range(n)))
    pattern = F.coalesce(*[F.when(kept == k, _key(d, k)) for k in range(1 << n)])
    plan = plan.withColumn("_key", pattern).withColumn("_specific", F.bit_count(kept)).drop(*[f"_d{i}" for i in range(n)])

    # The reservoirs: map-side combined counts, at most categories x slices rows.
    reservoir = written(pool.groupBy(*[f"_d{i}" for i in range(n)], "_slice").agg(F.count("*").alias("_n")), "reservoirs")
    combos = reservoir.groupBy(*[f"_d{i}" for i in range(n)]).agg(F.sum("_n").alias("_n"))
    match = combos.withColumn("_key", F.explode(F.array(*[_key(d, k) for k in range(1 << n)]))).join(F.broadcast(plan), "_key")
    first = Window.partitionBy("mix_name", *[f"_d{i}" for i in range(n)]).orderBy(F.desc("_specific"), "cell_id")
    match = match.withColumn("_first", F.row_number().over(first) == 1)

    avail = match.groupBy("mix_name", "cell_id").agg(F.sum("_n").alias("available"), F.sum(F.when(F.col("_first"), F.col("_n")).otherwise(0)).alias("assigned"))
    base = (
        plan.drop("_key", "_specific").join(avail, ["mix_name", "cell_id"], "left").fillna(0, ["available", "assigned"])
        .withColumn("sample_rows", F.floor(F.coalesce("sample_share", F.lit(0.0)) * n_rows + 1e-9).cast("long"))
        .withColumn("target_rows", F.coalesce(F.col("target_share") * F.col("sample_rows"), F.lit(0.0)))
        .withColumn("unmet", F.col("available") < F.greatest(F.coalesce(F.col("min_rows").cast("double"), F.lit(0.0)), "target_rows") - 1e-9)
    )
    out = T.StructType([*base.schema.fields, T.StructField("quota", T.LongType()), T.StructField("taken", T.LongType()), T.StructField("below", T.BooleanType())])
    # One group a mix, of its cells; the plan's size is checked above.
    report = written(base.groupBy("mix_name").applyInPandas(lambda x: _allot(x)[[f.name for f in out]], out), "quotas")

    # Trimming: the threshold slice of every cell, from the counts alone.
    dim_names = [f"_d{i}" for i in range(n)]
    owner = written(match.filter("_first").select("mix_name", "cell_id", *dim_names), "owners")
    small = owner.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    sent = F.broadcast if small else lambda df: df  # more combinations of values than that are joined by a shuffle
    per_slice = reservoir.alias("r").join(sent(owner.alias("o")), [F.col(f"r.{x}").eqNullSafe(F.col(f"o.{x}")) for x in dim_names])
    per_slice = per_slice.groupBy("mix_name", "cell_id", "_slice").agg(F.sum("_n").alias("_n"))
    run = Window.partitionBy("mix_name", "cell_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        per_slice.withColumn("_run", F.sum("_n").over(run)).join(F.broadcast(report.select("mix_name", "cell_id", "taken")), ["mix_name", "cell_id"])
        .groupBy("mix_name", "cell_id")
        .agg(F.coalesce(F.min(F.when(F.col("_run") > F.col("taken"), F.col("_slice"))), F.lit(slices)).alias("_cut"), F.coalesce(F.max(F.when(F.col("_run") <= F.col("taken"), F.col("_run"))), F.lit(0)).alias("_whole"), F.first("taken").alias("taken"))
    )
    owner = owner.join(sent(cut), ["mix_name", "cell_id"])
    mine = pool.alias("p").join(sent(owner.alias("o")), [F.col(f"p.{x}").eqNullSafe(F.col(f"o.{x}")) for x in dim_names])
    mine = mine.select("mix_name", "cell_id", "_id", "_u", "_slice", "_cut", (F.col("taken") - F.col("_whole")).alias("_left"))
    whole = mine.filter(F.col("_slice") < F.col("_cut"))
    edge = mine.filter((F.col("_slice") == F.col("_cut")) & (F.col("_left") > 0))
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy("mix_name", "cell_id").orderBy("_u", "_id"))).filter(F.col("_rank") <= F.col("_left"))
    picked = whole.select("mix_name", "cell_id", F.col("_id").alias(id_col)).unionAll(edge.select("mix_name", "cell_id", F.col("_id").alias(id_col)))
    drawn = picked.groupBy("mix_name", "cell_id").agg(F.count("*").alias("drawn"))
    whole = Window.partitionBy("mix_name")  # the cells of a mix
    report = report.join(drawn, ["mix_name", "cell_id"], "left").fillna(0, ["drawn"])
    return Sample(picked, report.withColumn("reached_share", F.col("drawn") / F.greatest(F.lit(1), F.sum("drawn").over(whole))))
