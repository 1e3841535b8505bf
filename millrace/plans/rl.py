"""Rewards and group windows. Group: the base task of a trajectory; members: its distinct samples with a card."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.rewards import by_efficiency, centred, centred_mad, reward_parts
from millrace.plans.base import CA, cards
from millrace.registry import query

_ALL = ["success", "final_f1", "selection_ok", "args_ok", "format_strict", "recovery_ok", "necessity_ok", "side_effect_ok", "num_calls", "oracle_calls", "detail", "stop_reason"]
_PARTS = """coalesce(success::int, 0) * 1.0::double + coalesce(case when not isnan(final_f1) then final_f1 end, 0) * 0.3::double + coalesce(selection_ok::int, 0) * 0.1::double + coalesce(args_ok::int, 0) * 0.1::double
  + coalesce(format_strict::int, 0) * 0.05::double + coalesce(recovery_ok::int, 0) * 0.1::double
  + case when not coalesce(success, false) and detail.anchor_ok is not null then detail.anchor_ok::int * 0.15::double + 0.2::double * coalesce(detail.progress_frac, 0)
      + case when coalesce(detail.progress_frac, 0) > 0 and coalesce(detail.reformulate_ok, false) then 0.1::double * coalesce(detail.reformulate_frac, 0) else 0 end else 0 end
  + case when side_effect_ok = false then -0.5::double else 0 end + case when not coalesce(necessity_ok, false) then -0.2::double else 0 end
  + case when not coalesce(success, false) then -least(0.24::double, greatest(0, num_calls - greatest(1, coalesce(oracle_calls, 0))) * 0.04::double) else 0 end
  + case when not coalesce(success, false) and oracle_calls > 0 then -least(0.24::double, greatest(0, greatest(1, coalesce(oracle_calls, 0)) - num_calls) * 0.06::double) else 0 end
  + case when detail.answer_reason = 'no_answer' then -0.2::double else 0 end + case when detail.truncated then -0.15::double else 0 end"""
RO = f"{CA}, ro as (select task_id, split_part(task_id, '#', 1) as grp, greatest(-1.0::double, least(1.8::double, {_PARTS})) as reward, coalesce(success, false) as success, num_calls, coalesce(stop_reason = 'empty_turn', false) as void from ca)"


def rollouts(spark, d):
    c = reward_parts(cards(spark, d, *_ALL))
    return c.select("task_id", F.substring_index("task_id", "#", 1).alias("grp"), "reward", F.coalesce("success", F.lit(False)).alias("success"), "num_calls", F.coalesce(F.col("stop_reason") == "empty_turn", F.lit(False)).alias("void"))


@query("rw_reward_parts", f"with {RO} select task_id, round(reward, 6) as reward from ro")
def rw(spark, d):
    return rollouts(spark, d).select("task_id", F.round("reward", 6).alias("reward"))


_W = "over (partition by grp)"
_AG = f"g as (select *, avg(reward) {_W} as mean, stddev_pop(reward) {_W} as sd, count(*) {_W} as k from ro), m as (select *, avg(abs(reward - mean)) {_W} as mad from g)"


@query("w01_group_adv", f"with {RO}, {_AG} select task_id, round(case when sd < 1e-4 then 0 else (reward - mean) / (sd + 1e-4) end, 4) as advantage from m")
def w01(spark, d):
    return rollouts(spark, d).select("task_id", F.round(centred(F.col("reward"), "grp"), 4).alias("advantage"))


@query("w02_planb_mad", f"with {RO}, {_AG} select task_id, round(case when mad < 1e-4 then 0 else (reward - mean) / (mad + 1e-4) end, 4) as advantage from m")
def w02_mad(spark, d):
    return centred_mad(rollouts(spark, d), "reward", "grp").select("task_id", F.round("advantage", 4).alias("advantage"))


@query("w02_planb_std", f"with {RO}, {_AG} select task_id, round(case when sd < 1e-4 then 0 else (reward - mean) / (sd + 1e-4) end, 4) as advantage from m")
def w02_std(spark, d):
    return rollouts(spark, d).select("task_id", F.round(centred(F.col("reward"), "grp", "std"), 4).alias("advantage"))


@query("w02_planb_none", f"with {RO}, {_AG} select task_id, round(reward - mean, 10) + 0.0 as advantage from m")
def w02_none(spark, d):
    return rollouts(spark, d).select("task_id", (F.round(centred(F.col("reward"), "grp", "none"), 10) + F.lit(0.0)).alias("advantage"))


@query("w02_planb_sign", f"with {RO}, s as (select *, sqrt(avg((reward - 0.5) * (reward - 0.5)) {_W}) as sd from ro) select task_id, round(case when sd < 1e-4 then 0 else (reward - 0.5) / (sd + 1e-4) end, 4) as advantage from s")
def w02_sign(spark, d):
    return rollouts(spark, d).select("task_id", F.round(centred(F.col("reward"), "grp", "std", "sign", 0.5), 4).alias("advantage"))


@query("w03_efficiency", f"with {RO}, b as (select *, min(num_calls) filter (where success) {_W} as best from ro) select task_id, round(case when success then reward * greatest(0.2::double, 1 - 0.5::double * (num_calls - best) / greatest(1, best)) else reward end, 6) as reward from b")
def w03(spark, d):
    return rollouts(spark, d).select("task_id", F.round(by_efficiency(F.col("reward"), F.col("num_calls"), F.col("success"), "grp", 0.5), 6).alias("reward"))


@query("w04_dqw", f"with {RO}, g as (select grp, avg(reward) as mean from ro group by 1), x as (select grp, exp(-mean / 0.5::double - (select max(-mean / 0.5::double) from g)) as e from g) select grp, round(count(*) over () * e / sum(e) over (), 4) as weight from x")
def w04(spark, d):
    g = rollouts(spark, d).groupBy("grp").agg(F.avg("reward").alias("mean"))
    top = g.agg(F.max(-F.col("mean") / 0.5)).scalar()
    e = g.select("grp", F.exp(-F.col("mean") / 0.5 - top).alias("e"))
    return e.select("grp", F.round(e.agg(F.count("*")).scalar() * F.col("e") / e.agg(F.sum("e")).scalar(), 4).alias("weight"))


_DEAD = f"""with {RO}, l as (select *, count(*) filter (where not void) {_W} as live from ro), v as (select grp, any_value(live) as live, stddev_pop(reward) filter (where not void) as sd from l group by 1)
    select grp, case when live = 0 then 'all_void' when live = 1 then 'void_singleton' when sd < 1e-4 then 'zero_variance' end as dead_reason from v"""


@query("w06_dead_reason", _DEAD)
def w06(spark, d):
    g = rollouts(spark, d).groupBy("grp").agg(F.count(F.when(~F.col("void"), 1)).alias("live"), F.stddev_pop(F.when(~F.col("void"), F.col("reward"))).alias("sd"))
    return g.select("grp", F.when(F.col("live") == 0, "all_void").when(F.col("live") == 1, "void_singleton").when(F.col("sd") < 1e-4, "zero_variance").alias("dead_reason"))


@query("a12_live_rate", f"with x as ({_DEAD}) select split_part(grp, '-', 1) as family, count(*) as groups, count(*) filter (where dead_reason is null) as live, round(avg((dead_reason is null)::int), 3) as live_rate from x group by 1")
def a12(spark, d):
    live = F.col("dead_reason").isNull()
    return w06(spark, d).groupBy(F.substring_index("grp", "-", 1).alias("family")).agg(F.count("*").alias("groups"), F.count(F.when(live, 1)).alias("live"), F.round(F.avg(live.cast("int")), 3).alias("live_rate"))


@query("a13_sampled_stats", f"with {RO} select count(*) as n, round(avg(reward), 4) as mean, round(stddev_pop(reward), 4) as sd, round(avg(success::int), 4) as success, round(avg(num_calls), 4) as calls, round(avg(void::int), 4) as void from ro")
def a13(spark, d):
    return rollouts(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("reward"), 4).alias("mean"), F.round(F.stddev_pop("reward"), 4).alias("sd"), F.round(F.avg(F.col("success").cast("int")), 4).alias("success"), F.round(F.avg("num_calls"), 4).alias("calls"), F.round(F.avg(F.col("void").cast("int")), 4).alias("void"))


@query("a15_discards", f"with x as ({_DEAD}) select coalesce(dead_reason, 'live') as reason, count(*) as groups from x group by 1")
def a15(spark, d):
    return w06(spark, d).groupBy(F.coalesce("dead_reason", F.lit("live")).alias("reason")).agg(F.count("*").alias("groups"))


# Steps of a run: the days on which cards were loaded.
_DAYS = "days as (select date_trunc('day', loaded_at)::date as day, avg((success is not true)::int) as dead, avg(case when final_f1 between 0 and 1 then final_f1 end) as f1 from ca group by 1)"


def _days(spark, d):
    c = cards(spark, d, "success", "final_f1")
    return c.groupBy(F.to_date("loaded_at").alias("day")).agg(F.avg((~F.coalesce("success", F.lit(False))).cast("int")).alias("dead"), F.avg(F.when(F.col("final_f1").between(0, 1), F.col("final_f1"))).alias("f1"))


@query("w10_rolling_dead", f"with {CA}, {_DAYS} select cast(day as varchar) as day, round(avg(dead) over (order by day rows between 4 preceding and current row), 4) as rolling from days")
def w10(spark, d):
    w = Window.orderBy("day").rowsBetween(-4, 0)  # one row a day
    return _days(spark, d).select(F.col("day").cast("string").alias("day"), F.round(F.avg("dead").over(w), 4).alias("rolling"))


@query("w12_running_best", f"with {CA}, {_DAYS} select cast(day as varchar) as day, coalesce(f1 > max(f1) over (order by day rows between unbounded preceding and 1 preceding), f1 is not null) as accepted from days")
def w12(spark, d):
    before = F.max("f1").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return _days(spark, d).select(F.col("day").cast("string").alias("day"), F.coalesce(F.col("f1") > before, F.col("f1").isNotNull()).alias("accepted"))
