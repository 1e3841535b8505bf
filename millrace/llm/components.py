"""Connected components of a link table, by rounds of star contraction with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

#: More rounds than any graph of this size class needs; each at least halves the longest path.
MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest node.

    Every round links each node's larger neighbours to its smallest one (large star), then its smaller ones (small star),
    until nothing changes. Stars are built by aggregates with map-side combine, so a hub is one group of a minimum, and
    no component is collected. Each round is written to the shared folder, which cuts lineage and survives lost executors.
    Loops and nulls are dropped; an empty table gives an empty result.
    """
    cur = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges")
    nodes = cur.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    for _ in range(MOST_ROUNDS):
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        nxt = written(small, "edges")
        same = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(cur.withColumnRenamed("u", "node").withColumnRenamed("v", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
