"""Rewards, and the group-relative windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"success": 1.0, "final_correct": 0.30, "selection": 0.10, "args": 0.10, "format": 0.05, "recovery": 0.10}
LOW, HIGH = -1.0, 1.8


def reward_parts(cards: DataFrame) -> DataFrame:
    """cards plus one column per part of the reward and ``reward``, their clipped sum.

    Shaping and call penalties count for failed episodes only; nullable flags count as their absence.
    """
    yes = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    failed = ~F.coalesce(F.col("success"), F.lit(False))
    progress = F.coalesce(F.col("detail.progress_frac"), F.lit(0.0))
    anchored = failed & F.col("detail.anchor_ok").isNotNull()
    budget = F.greatest(F.lit(1), F.coalesce("oracle_calls", F.lit(0)))
    extra, short = F.greatest(F.lit(0), F.col("num_calls") - budget), F.greatest(F.lit(0), budget - F.col("num_calls"))
    part = {
        "success": yes("success"), "final_correct": F.coalesce(F.nanvl("final_f1", F.lit(0.0)), F.lit(0.0)), "selection": yes("selection_ok"), "args": yes("args_ok"), "format": yes("format_strict"), "recovery": yes("recovery_ok"),
    }
    part = {k: WEIGHTS[k] * v for k, v in part.items()} | {
        "anchor": F.when(anchored, 0.15 * F.col("detail.anchor_ok").cast("double")), "progress": F.when(anchored, 0.20 * progress),
        "reformulate": F.when(anchored & (progress > 0) & F.coalesce("detail.reformulate_ok", F.lit(False)), 0.10 * F.coalesce("detail.reformulate_frac", F.lit(0.0))),
        "side_effect": F.when(F.col("side_effect_ok") == F.lit(False), -0.5), "necessity": F.when(~F.coalesce("necessity_ok", F.lit(False)), -0.2),
        "extra_calls": F.when(failed & (extra > 0), -F.least(F.lit(0.24), extra * 0.04)), "missing_calls": F.when(failed & (short > 0) & (F.col("oracle_calls") > 0), -F.least(F.lit(0.24), short * 0.06)),
        "no_answer": F.when(F.col("detail.answer_reason") == "no_answer", -0.2), "overlong": F.when(F.col("detail.truncated"), -0.15),
    }
    total = sum((F.coalesce(v, F.lit(0.0)) for v in part.values()), F.lit(0.0))
    return cards.withColumns({f"part_{k}": v for k, v in part.items()}).withColumn("reward", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), total)))


def centred(reward: Column, group: str, scale: str = "std", baseline: str = "mean", sign_baseline: float = 0.0, eps: float = 1e-4) -> Column:
    """Advantage of a reward within its group: distance from the baseline over a spread about the same baseline.

    scale: std or none (mad: see centred_mad). baseline: the group's mean, or ``sign`` for a fixed one. 0 where the spread is below eps.
    """
    w = Window.partitionBy(group)
    ref = F.avg(reward).over(w) if baseline == "mean" else F.lit(sign_baseline)
    if scale == "none":
        return reward - ref
    mean = F.avg(reward).over(w)
    # the spread about ref, from windows that do not nest
    std = F.sqrt(F.greatest(F.lit(0.0), F.var_pop(reward).over(w) + (mean - ref) * (mean - ref)))
    if scale == "mad":
        raise ValueError("the mean distance needs the group's mean first: use centred_mad")
    spread = std
    return F.when(spread < eps, 0.0).otherwise((reward - ref) / (spread + eps))


def centred_mad(df: DataFrame, reward: str, group: str, baseline: str = "mean", sign_baseline: float = 0.0, eps: float = 1e-4) -> DataFrame:
    """df with ``advantage``, the distance from the baseline over the mean distance: means first, then distances, each a grouped aggregate."""
    ref = df.groupBy(group).agg((F.avg(reward) if baseline == "mean" else F.lit(sign_baseline)).alias("_ref"))
    away = df.join(ref, group).withColumn("_away", F.abs(F.col(reward) - F.col("_ref")))
    mad = away.groupBy(group).agg(F.avg("_away").alias("_mad"))
    out = away.join(mad, group).withColumn("advantage", F.when(F.col("_mad") < eps, 0.0).otherwise((F.col(reward) - F.col("_ref")) / (F.col("_mad") + eps)))
    return out.drop("_ref", "_away", "_mad")


def by_efficiency(reward: Column, calls: Column, success: Column, group: str, lam: float, floor: float = 0.2) -> Column:
    """Rewards of successes shrunk by the calls beyond the fewest of a success in the group; failures as they are."""
    best = F.min(F.when(success, calls)).over(Window.partitionBy(group))
    factor = F.greatest(F.lit(floor), 1.0 - lam * (calls - best) / F.greatest(F.lit(1), best))
    return F.when(success & F.lit(lam > 0), reward * factor).otherwise(reward)
