"""Inputs that several plans share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.common import latest
from millrace.sources.tables import table


def tasks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "task", "task_id", "loaded_at", *cols), "task_id")


def trajectories(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "trajectory", "task_id", "loaded_at", *cols), "task_id")


def cards(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "scorecard", "task_id", "loaded_at", *cols), "task_id")


def records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest(table(spark, d, "sft_record", "record_id", "loaded_at", *cols), "record_id")


def _latest(name: str, src: str, key: str) -> str:
    return f"{name} as (select * exclude (rn) from (select *, row_number() over (partition by {key} order by loaded_at desc) as rn from {src} where {key} is not null) where rn = 1)"


TK, TR, CA, RE = _latest("tk", "task", "task_id"), _latest("tr", "trajectory", "task_id"), _latest("ca", "scorecard", "task_id"), _latest("re", "sft_record", "record_id")
#: norm_text and the BM25 words of an SQL expression.
norm = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
toks = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
