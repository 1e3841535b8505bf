"""Event-time operators that work on batch and streaming DataFrames alike, and a runner that drains a source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from millrace.session import shared_dir


def _timed(e: DataFrame) -> DataFrame:
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def per_window(e: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    e = _timed(e)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    w = F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def per_session(e: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    e = _timed(e)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(e: DataFrame, key: str, late: str) -> DataFrame:
    return _timed(e).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(spark: SparkSession, path: str, f: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a streaming plan over what a source holds now, checkpointed in the shared folder, and read its result.

    ``complete`` results keep the last state only: each batch overwrites one table; ``append`` results go to files.
    """
    schema, at = spark.read.parquet(path).schema, shared_dir(spark)
    # A stream reads folders; a table that is one file is the only match in its own.
    folder, name = path.rstrip("/").rsplit("/", 1)
    probe = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    whole = bool(probe) and not probe[0]["path"].rstrip("/").endswith(f"/{name}")
    r = spark.readStream.schema(schema).format("parquet")
    src = r.load(path) if whole else r.option("pathGlobFilter", name).load(folder)
    out = f(src)
    w = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{at}/out").start()
    else:
        q = w.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def last_five(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The mean of a key's last five values after each event; what is kept between batches is the five."""
    last = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for i, v in zip(rows["event_id"], rows["value"]):
        last = [*last, float(v)][-5:]
        out.append((i, round(sum(last) / len(last), 4)))
    state.update((last,))
    yield pd.DataFrame(out, columns=["event_id", "rolling"])
