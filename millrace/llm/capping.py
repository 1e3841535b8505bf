"""Problem 3: at most so many records per contributor, the better ones first.

Quality-weighted sampling without replacement (Efraimidis and Spirakis): each record draws u in (0, 1) from its id and
gets the key u ** (1 / w); the ``cap`` largest keys of a contributor stay. With w = exp(score / temperature) the key's
order is that of score / temperature - log(-log u). At temperature 0, the limit, the noise vanishes and the key is the
score itself, so that the same reservoir keeps the best by score, ties by id.

The reservoirs are Spark's window group limit: every task first keeps the ``cap`` best of each contributor among its own
rows, so a contributor that holds a third of all rows sends no more than cap rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cap_per_contributor(rows: DataFrame, id_col: str, contributor: str, scores: list[str], cap: int = 8, max_share: float | None = None, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """(contributor, id, rank) of the records kept; ``rank`` runs from 1 to at most ``cap``.

    scores: numeric columns, the larger the better, compared in order; null and NaN come last. With a positive
    ``temperature`` only their sum counts (null and NaN as 0). max_share: a contributor may also hold no more than this
    share of all rows (rounded down, at least 1). ``id_col`` should be unique; repeated ids count as different records.
    Rows with a null id are dropped; a null contributor is a contributor of its own. An empty table gives an empty one.
    Other columns are ignored.
    """
    r = rows.select(F.col(id_col).alias("_id"), F.col(contributor).alias("_who"), *[F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(f"_s{i}") for i, s in enumerate(scores)])
    r = r.filter(F.col("_id").isNotNull())
    if temperature > 0:
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_id").cast("string")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        total = sum((F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(len(scores))), F.lit(0.0))
        r = r.withColumn("_key", total / F.lit(float(temperature)) - F.log(-F.log(u)))
        order = [F.desc("_key"), F.asc("_id")]
    else:
        order = [*[F.desc_nulls_last(f"_s{i}") for i in range(len(scores))], F.asc("_id")]
    kept = r.withColumn("rank", F.row_number().over(Window.partitionBy("_who").orderBy(*order))).filter(F.col("rank") <= cap)
    if max_share is not None:
        total = r.agg(F.count("*")).scalar()
        kept = kept.filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(total * F.lit(float(max_share)))))
    return kept.select(F.col("_who").alias(contributor), F.col("_id").alias(id_col), "rank")
