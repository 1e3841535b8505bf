"""Episode verification: one wide row per episode from its task and its trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import answer_f1, canonical_value, gold_forms, longest_name, match_answer, norm_text


def empty_retrieval(result: Column) -> Column:
    """Whether a tool reply (JSON) has no hit; an error reply has none either. Text that is no object is not empty."""
    n, hits = F.get_json_object(result, "$.num_results"), F.get_json_object(result, "$.results")
    return F.coalesce(result.rlike(r"^\s*\{"), F.lit(False)) & (F.coalesce(n == "0", F.lit(False)) | hits.isNull() | (hits == "[]"))


MULTI_HOP = ["musique_2hop", "musique_3hop", "musique_4hop"]


def strict_steps(plan: Column, log: Column) -> Column:
    """Share of the plan's steps that some call of the same tool meets in all arguments the step gives; null without a plan."""
    same = lambda want, got: want.isNull() | F.coalesce(canonical_value(got) == canonical_value(want.cast("string")), F.lit(False))
    meets = lambda s, c: (c["name"] == s["name"]) & same(s["arguments"]["query"], F.get_json_object(c["args"], "$.query")) & same(s["arguments"]["top_k"], F.get_json_object(c["args"], "$.top_k"))
    met = F.size(F.filter(plan, lambda s: F.coalesce(F.exists(log, lambda c: meets(s, c)), F.lit(False))))
    return F.when(F.size(plan) > 0, F.round(met / F.size(plan), 3))


def hop_diagnostics(plan: Column, log: Column) -> dict[str, Column]:
    """How the queries follow the names in the plan: anchor (first query), progress (in order), reformulation.

    Progress walks the names with the count covered so far and the first query still open. The query looked at first is the
    one as many places ahead as names are covered, then the first one ahead that has the name; without one the walk ends.
    """
    q = F.transform(F.filter(log, lambda c: (c["name"] == "search") & (F.coalesce(F.get_json_object(c["args"], "$.query"), F.lit("")) != "")), lambda c: norm_text(F.get_json_object(c["args"], "$.query")))
    q = F.coalesce(q, F.array().cast("array<string>"))
    names = F.filter(F.transform(F.filter(plan, lambda s: (s["name"] == "search") & (F.coalesce(s["arguments"]["query"], F.lit("")) != "")), lambda s: longest_name(s["arguments"]["query"])), lambda e: e != "")
    state = lambda c, s, d: F.struct(c.cast("int").alias("covered"), s.cast("int").alias("start"), d.alias("done"))

    def step(a: Column, e: Column) -> Column:
        straight = F.coalesce(F.contains(F.get(q, a["start"] + a["covered"]), e), F.lit(False))
        ahead = F.array_position(F.transform(F.slice(q, a["start"] + 1, F.greatest(F.lit(0), F.size(q) - a["start"])), lambda x: F.contains(x, e)), F.lit(True))
        on = F.when(straight, state(a["covered"] + 1, a["start"] + a["covered"] + 1, F.lit(False))).when(ahead > 0, state(a["covered"] + 1, a["start"] + ahead, F.lit(False)))
        return F.when(a["done"], a).otherwise(F.coalesce(on, state(a["covered"], a["start"], F.lit(True))))

    covered = F.aggregate(names, state(F.lit(0), F.lit(0), F.lit(False)), step, lambda a: a["covered"])
    head = F.get(names, F.lit(0))
    moved = F.exists(q, lambda x: F.contains(x, head))
    there = F.size(names) > 0
    return {
        "anchor_ok": F.when(there, F.coalesce(F.contains(F.get(q, F.lit(0)), head), F.lit(False))), "progress_frac": F.when(there, F.round(covered / F.size(names), 3)),
        "reformulate_frac": F.when(there, F.when(moved, 1.0).otherwise(0.0)), "reformulate_ok": F.when(there, moved),
    }


def verify(episodes: DataFrame, strict_necessity: bool = True, strict_match: bool = False, side_effect_tools: tuple[str, ...] = ()) -> DataFrame:
    """Scorecard columns of episodes.

    Input: task_id, task_type, gold, required_tools, required_any, forbidden_tools, oracle_plan, stop_reason, final_answer,
    steps, call_log, expect_side_effect, sent_messages. ``side_effect_tools`` names the tools that send something; they
    may be called only where they are required. Strict: an answer without its tag is wrong, as is one with many numbers.
    """
    arr = lambda c, t="array<string>": F.coalesce(c, F.array().cast(t))
    log, steps = F.col("call_log"), F.col("steps")
    e = episodes.withColumns({
        "called": F.array_distinct(arr(F.transform(log, lambda c: c["name"]))), "ok_calls": F.array_distinct(arr(F.transform(F.filter(log, lambda c: c["ok"]), lambda c: c["name"]))),
        "num_steps": F.coalesce(F.size(steps), F.lit(0)), "num_calls": F.coalesce(F.size(log), F.lit(0)), "num_tool_errors": F.coalesce(F.size(F.filter(log, lambda c: ~c["ok"])), F.lit(0)),
        "oracle_calls": F.coalesce(F.size("oracle_plan"), F.lit(0)), "_m": match_answer(F.col("gold.kind"), F.col("gold.value"), F.col("gold.tol"), F.col("final_answer"), strict_match),
        "truncated": F.coalesce(F.exists(F.flatten(F.transform(steps, lambda s: arr(s["parse_errors"]))), lambda x: F.contains(x, F.lit("unterminated_"))), F.lit(False)),
        "format_strict": (F.size(steps) > 0) & F.forall(steps, lambda s: s["strict_format"]),
        "format_loose": (F.size(steps) > 0) & F.forall(steps, lambda s: ~F.array_contains(arr(s["parse_errors"]), "malformed_tool_call") & ~F.array_contains(arr(s["parse_errors"]), "empty_turn")),
    })
    untagged = F.lit(strict_match) & F.coalesce(F.array_contains(F.try_element_at(steps, F.lit(-1))["parse_errors"], "untagged_final_answer"), F.lit(False))
    needs = F.coalesce(F.col("task_type") != "no_tool", F.lit(True))
    missing = F.array_except(arr(F.col("required_tools")), F.col("called"))
    group = F.filter(F.col("required_any"), lambda g: ~F.arrays_overlap(g, F.col("called")))
    missing = F.when(F.size(group) > 0, F.concat(missing, F.array(F.array_join(group[0], "|")))).otherwise(missing)
    forbidden = F.arrays_overlap(arr(F.col("forbidden_tools")), F.col("called"))
    later = lambda test: F.exists(F.sequence(F.lit(0), F.size(log) - 1), test)
    errors = F.col("num_tool_errors") > 0
    recovered = later(lambda i: ~log[i]["ok"] & F.exists(F.slice(log, i + 2, F.size(log)), lambda c: c["ok"] & (c["name"] == log[i]["name"])))
    blank = F.exists(log, lambda c: c["ok"] & empty_retrieval(c["result"]))
    refilled = later(lambda i: log[i]["ok"] & empty_retrieval(log[i]["result"]) & F.exists(F.slice(log, i + 2, F.size(log)), lambda c: ~empty_retrieval(c["result"])))
    e = e.withColumns({
        "necessity_ok": F.when(F.col("task_type") == "compute", F.lit(True)).otherwise((F.col("num_calls") > 0) == needs), "_missing": missing, "_forbidden": forbidden,
        "selection_ok": (F.size(missing) == 0) & ~forbidden,
        "args_ok": (F.size(F.array_except(arr(F.col("required_tools")), F.col("ok_calls"))) == 0) & F.coalesce(F.forall("required_any", lambda g: F.arrays_overlap(g, F.col("ok_calls"))), F.lit(True)),
        "recovery_ok": F.when(errors, recovered).when(F.coalesce(blank, F.lit(False)), refilled),
        "final_correct": F.when(untagged, F.lit(False)).otherwise(F.col("_m.ok")), "answer_reason": F.when(untagged, "untagged_answer_strict").otherwise(F.col("_m.reason")),
        "final_f1": F.when(F.col("gold.kind") == "none", (F.col("_m.ok") & ~untagged).cast("double")).otherwise(answer_f1(gold_forms(F.col("gold.kind"), F.col("gold.value")), F.col("final_answer"))),
    })
    # Side effects: the first message to the one expected with all that it must contain; none may be sent unasked.
    want = F.col("expect_side_effect")
    told = lambda m: F.lower(F.concat(F.coalesce(m["subject"], F.lit("")), F.lit(" "), F.coalesce(m["body"], F.lit(""))))
    fits = lambda m: ((F.coalesce(want["to"], F.lit("")) == "") | (F.lower(m["to"]) == F.lower(want["to"]))) & F.coalesce(F.forall(want["must_contain"], lambda s: F.contains(told(m), F.lower(s))), F.lit(True))
    unasked = F.filter(F.array(*[F.lit(t) for t in side_effect_tools]).cast("array<string>"), lambda t: F.array_contains("called", t) & ~F.array_contains(arr(F.col("required_tools")), t))
    e = e.withColumns({
        "side_effect_ok": F.when(want.isNotNull(), F.coalesce(F.exists("sent_messages", fits), F.lit(False))).when(F.size(unasked) > 0, F.lit(False)), "unrequested_side_effect": F.when(want.isNull(), unasked).otherwise(F.array().cast("array<string>")),
        "args_strict_frac": strict_steps(F.col("oracle_plan"), log), "arg_coercions": F.coalesce(F.size(F.filter(log, lambda c: F.coalesce(c["coerced"], F.lit(False)))), F.lit(0)),
        "error_kinds": F.array_sort(F.array_distinct(arr(F.transform(F.filter(log, lambda c: ~c["ok"]), lambda c: F.coalesce(F.get_json_object(c["result"], "$.error"), F.lit("?")))))),
        **{k: F.when(F.col("task_type").isin(MULTI_HOP), v) for k, v in hop_diagnostics(F.col("oracle_plan"), log).items()},
    })
    calm = F.coalesce(F.col("side_effect_ok"), F.lit(True))
    e = e.withColumn("success", F.coalesce(F.col("final_correct"), F.lit(False)) & ~F.col("_forbidden") & calm & (F.col("necessity_ok") | F.lit(not strict_necessity) | needs))
    mode = (
        F.when(F.col("success"), "").when(~F.col("format_loose") & F.col("final_answer").isNull(), "format").when(F.col("stop_reason") == "max_steps", "ran_out_of_steps").when(F.col("stop_reason") == "empty_turn", "empty_turn")
        .when(~F.col("necessity_ok") & ~needs, "unnecessary_tool_use").when(~F.col("necessity_ok") & needs, "answered_without_tools").when(F.col("_forbidden"), "forbidden_tool")
        .when(want.isNotNull() & ~calm, "missing_or_wrong_side_effect").when(~calm, "unrequested_side_effect")
        .when(F.size("_missing") > 0, F.concat(F.lit("missing_tool:"), F.col("_missing")[0])).when(~F.col("args_ok"), "bad_arguments").when(F.col("recovery_ok") == F.lit(False), "no_recovery")
        .when(F.col("answer_reason") == "no_answer", "no_final_answer").otherwise(F.concat(F.lit("wrong_answer:"), F.col("answer_reason")))
    )
    return e.withColumn("failure_mode", mode).select(
        "task_id", "success", "format_strict", "format_loose", "necessity_ok", "selection_ok", "args_ok", "recovery_ok", "final_correct", F.round("final_f1", 6).alias("final_f1"),
        "num_steps", "num_calls", "num_tool_errors", "oracle_calls", "truncated", "answer_reason", "failure_mode",
        "side_effect_ok", "unrequested_side_effect", "args_strict_frac", "arg_coercions", "error_kinds", "anchor_ok", "progress_frac", "reformulate_frac", "reformulate_ok", F.substring(F.coalesce("final_answer", F.lit("")), 1, 400).alias("final_answer"),
    )
