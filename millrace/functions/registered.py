"""Operators as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFINED = {
    "norm_text(s string) returns string": "trim(regexp_replace(regexp_replace(lower(coalesce(s, '')), '[^a-z0-9 ]+', ' '), ' +', ' '))",
    "bm25_words(s string) returns array<string>": "regexp_extract_all(lower(s), '([a-z0-9]+)', 1)",
    "task_source(documents int) returns string": "if(coalesce(documents, 0) > 0, 'real', 'synthetic')",
    "sha_int(s string, digits int) returns bigint": "cast(conv(substring(sha1(s), 1, digits), 16, 10) as bigint)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for head, body in _DEFINED.items():
        spark.sql(f"create or replace temporary function mr_{head} return {body}")
    return [f"mr_{h.split('(')[0]}" for h in _DEFINED]
