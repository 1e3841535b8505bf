"""Sinks: run files, promotion behind a gate, histories that resume, caches in either form."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.jsonl import read_cache


def dump(records: DataFrame, path: str) -> None:
    """Records as JSON lines, one file a partition; null fields are kept, so that every line has all keys."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_run(report: DataFrame, scores: DataFrame, trajectories: DataFrame, path: str, text: Column | None = None) -> dict[str, str]:
    """The files of a run: report as JSON and as text, scores and trajectories as JSON lines. Returns what was written where."""
    at = {k: f"{path}/{k}" for k in ("report.json", "report.txt", "scores.jsonl", "trajectories.jsonl")}
    dump(report, at["report.json"])
    report.select((text if text is not None else F.to_json(F.struct(*report.columns))).alias("value")).write.mode("overwrite").text(at["report.txt"])
    dump(scores, at["scores.jsonl"])
    dump(trajectories, at["trajectories.jsonl"])
    return at


def promote(spark: SparkSession, candidate: str, target: str, problems: DataFrame) -> bool:
    """Move ``candidate`` to ``target`` if ``problems`` is empty; else both stay as they are and False comes back."""
    if problems.limit(1).count():
        return False
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(candidate), jvm.org.apache.hadoop.fs.Path(target)
    fs = src.getFileSystem(conf)
    if fs.exists(dst):
        fs.delete(dst, True)
    return bool(fs.rename(src, dst))


def resumed(history: DataFrame, step: str, checkpoint: int, new: DataFrame) -> DataFrame:
    """A history cut back to its checkpoint, with what the run has added since."""
    return history.filter(F.col(step) <= checkpoint).unionByName(new.filter(F.col(step) > checkpoint))


def put_object(spark: SparkSession, entries: DataFrame, path: str) -> None:
    """A bounded cache (key, value) as one JSON object with sorted keys."""
    rows = {r["key"]: r["value"] for r in entries.toLocalIterator()}
    spark.createDataFrame([(json.dumps(rows, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a cache that is one JSON object; a file that is none, or empty, gives no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.filter("m is not null").select(F.explode("m").alias("key", "value"))


def read_any_cache(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, value of a cache in either form: one JSON object, or lines of records, told by the first line's own key."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).select(F.get_json_object("value", f"$.{key}").isNotNull() | F.coalesce(F.get_json_object("value", "$.header").isNotNull(), F.lit(False))).first()
    if first is not None and first[0]:
        return read_cache(spark, path, key).select("key", F.get_json_object("record", f"$.{value}").alias("value"))
    return read_object(spark, path)


def overlaid(defaults: DataFrame, given: DataFrame, flags: DataFrame) -> DataFrame:
    """Settings (key, value): defaults, overlaid by a file's, overlaid by explicit flags; null sets nothing."""
    d, g, f = (x.select("key", F.col("value").alias(n)) for x, n in ((defaults, "d"), (given, "g"), (flags, "f")))
    return d.join(g, "key", "full_outer").join(f, "key", "full_outer").select("key", F.coalesce("f", "g", "d").alias("value"))
