"""Small shared operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """Each key once, as its row with the largest ``order``; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(key, "_x.*")
