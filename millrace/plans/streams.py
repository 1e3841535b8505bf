"""Windows over the event stream, as batch plans and as the streaming jobs that give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.registry import query
from millrace.sources.tables import table
from millrace.streaming.events import deduplicated, per_session, per_window, run_to_end


@query("st_tumbling", "select event_type, cast(epoch_us(time_bucket(interval 1 hour, ts)) as bigint) as start_us, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_tumbling(spark, d):
    e = per_window(table(spark, d, "events", "ts", "event_type", "value"), "1 hour")
    return e.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query("st_tumbling_streamed", "select event_type, cast(epoch_us(time_bucket(interval 1 hour, ts)) as bigint) as start_us, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_tumbling_streamed(spark, d):
    return run_to_end(spark, f"{d}/events.parquet", lambda e: per_window(e, "1 hour"), "complete").select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query("st_session", """with l as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from l) select user_id, cast(epoch_us(min(ts)) as bigint) as start_us, count(*) as n from s group by user_id, s""")
def st_session(spark, d):
    e = per_session(table(spark, d, "events", "ts", "user_id"), "30 minutes")
    return e.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("st_dedup_watermark", "select count(distinct event_id) as n from events")
def st_dedup(spark, d):
    return run_to_end(spark, f"{d}/events.parquet", lambda e: deduplicated(e, "event_id", "60 days"), "append").agg(F.count("*").alias("n"))


@query("st2_guard_counter", "select event_id, count(*) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as nth from events")
def st2(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events", "event_id", "user_id", "event_type", "ts").select("event_id", F.count("*").over(w).alias("nth"))


@query("st4_rolling_state", "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 4) as rolling from events")
def st4(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", F.round(F.avg("value").over(w), 4).alias("rolling"))


@query("e_json_props", "select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1")
def e_json(spark, d):
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
