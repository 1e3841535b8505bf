"""JSON-lines sources and sinks: typed scans, last-wins caches, deterministic files, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK = """task_id string, seed bigint, prompt string, task_type string, difficulty int, gold struct<kind:string,value:string,tol:double>, tier int, required_tools array<string>, required_any array<array<string>>, forbidden_tools array<string>,
oracle_plan array<struct<name:string,arguments:struct<query:string,top_k:int>,expect_error:string>>, oracle_answer string, route array<string>, chain array<string>, expect_side_effect struct<to:string,must_contain:array<string>>, notes string,
documents array<struct<doc_id:string,title:string,text:string,facts:map<string,string>,links:array<string>>>"""


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType = TASK) -> DataFrame:
    """Typed rows of one or several files; blank lines are skipped, nothing is inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def unknown_keys(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Top-level keys that the schema does not have, with the number of lines that do."""
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("key"))
    return keys.filter(~F.col("key").isin([f.name for f in schema])).groupBy("key").agg(F.count("*").alias("n"))


def read_cache(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key, record (JSON) of an append-only cache: lines without the key (headers) and a last line cut short are dropped,
    an earlier broken line is an error, and of several lines with one key the last stands."""
    lines = spark.read.text(path, wholetext=False).withColumn("line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    last = lines.agg(F.max("line")).scalar()
    bad = F.try_parse_json("value").isNull()
    checked = lines.withColumn("bad", F.when(bad & (F.col("line") < last), F.raise_error(F.concat(F.lit("broken line: "), F.substring("value", 1, 80))).cast("boolean")).otherwise(bad))
    rows = checked.filter(~F.col("bad")).select(F.get_json_object("value", f"$.{key}").alias("key"), "value", "line").filter("key is not null")
    return rows.groupBy("key").agg(F.max_by("value", "line").alias("record"))


def write_sorted(df: DataFrame, path: str, by: str) -> None:
    """One file, rows by ``by``, columns by name: equal tables give equal bytes."""
    df.select(*sorted(df.columns)).repartition(1).sortWithinPartitions(by).write.mode("overwrite").json(path)


def fingerprint(df: DataFrame, buckets: int = 256, nulls: bool = False) -> DataFrame:
    """One row, sha256 of the table whatever its order: rows are hashed, hashes sorted within buckets, buckets hashed."""
    h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": str(not nulls).lower()}), 256).alias("h")).withColumn("b", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % buckets)
    per = h.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("b").cast("string"), 3, "0"), "h"))), ","), 256).alias("fingerprint"))


def todo(jobs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return jobs.join(cache.select(F.col("key").alias(key)), key, "left_anti")


