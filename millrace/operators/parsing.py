"""Tolerant parsing of assistant turns, in Arrow batches.

A turn may hold a think block, tool calls and a final answer, each possibly cut off. Calls are read from tool_call tags,
else from a fenced block, else from bare JSON; their JSON may have trailing commas, single quotes or Python constants,
unquoted names, or brackets left open. Every repair is named. Calls written as ``name(key="value")`` are read too.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = "struct<thinking:string,calls:array<struct<name:string,arguments:string,repairs:array<string>>>,final_answer:string,errors:array<string>,strict:boolean>"
_NAMES, _ARGS = ("name", "tool", "tool_name", "function"), ("arguments", "parameters", "args", "input")


def _outline(text: str) -> tuple[int, str] | None:
    """Where the first object of ``text`` ends (-1 if it does not) and the brackets still open there."""
    stack, quote, skip = [], "", False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'" and stack:
            quote = c
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                return i + 1, ""
    return (-1, quote + "".join(reversed(stack))) if stack else None


def lenient_object(text: str) -> tuple[dict | None, list[str]]:
    """The object that a text holds and the repairs that reading it took, in order."""
    start = text.find("{")
    if start < 0:
        return None, []
    body, done = text[start:], []
    shape = _outline(body)
    end, open_ = shape if shape else (-1, "")
    if end >= 0:
        if text.strip() != body[:end]:
            done.append("extracted")
        body = body[:end]
    steps = [
        ("trailing_comma", lambda s: re.sub(r",\s*([}\]])", r"\1", s)),
        ("unquoted_keys", lambda s: re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', s)),
        ("closed_brackets", lambda s: s.rstrip().rstrip(",") + open_),
    ]
    for name, fix in [("", lambda s: s), *steps]:
        tried = fix(body)
        if name and tried == body:
            continue
        body = tried
        done = [*done, name] if name else done
        for how, read in (("", json.loads), ("python_literal", ast.literal_eval)):
            try:
                obj = read(body)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
            if isinstance(obj, dict):
                return obj, [*done, how] if how else done
    return None, done


def _call(text: str) -> dict | None:
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*\((.*)\)\s*", text, re.S)
    if m:
        try:
            node = ast.parse(text.strip(), mode="eval").body
            kept = {k.arg: ast.literal_eval(k.value) for k in node.keywords if k.arg}
        except (ValueError, SyntaxError, AttributeError, RecursionError):
            return None
        return {"name": m.group(1), "arguments": json.dumps(kept, sort_keys=True, default=str), "repairs": ["call_syntax"]}
    obj, done = lenient_object(text)
    if obj is None:
        return None
    inner = obj.get("function")
    if isinstance(inner, dict):
        obj, done = inner, [*done, "nested_function"]
    name = next((obj[k] for k in _NAMES if isinstance(obj.get(k), str)), None)
    key = next((k for k in _ARGS if k in obj), None)
    if not name:
        return None
    done = done + ([] if "name" in obj else ["name_alias"]) + ([] if key in (None, "arguments") else ["args_alias"])
    args = obj.get(key) if key else {}
    if isinstance(args, str):
        parsed, more = lenient_object(args)
        args, done = (parsed if parsed is not None else {"value": args}), [*done, "string_args", *more]
    return {"name": name, "arguments": json.dumps(args, sort_keys=True, default=str, ensure_ascii=False), "repairs": done}


def parse_turn(text: str | None, fallbacks: bool = True) -> dict:
    rest, errors, calls = text or "", [], []
    out = {"thinking": None, "final_answer": None}
    m = re.search(r"<think>(.*?)(</think>|\Z)", rest, re.S)
    if m:
        out["thinking"] = m.group(1).strip()
        errors += [] if m.group(2) else ["unterminated_think"]
        rest = rest[: m.start()] + rest[m.end() :]
    tagged = list(re.finditer(r"<tool_call>(.*?)(</tool_call>|\Z)", rest, re.S))
    for t in tagged:
        errors += [] if t.group(2) else ["unterminated_tool_call"]
        call = _call(t.group(1))
        calls.append(call) if call else errors.append("malformed_tool_call")
    rest = re.sub(r"<tool_call>.*?(</tool_call>|\Z)", "", rest, flags=re.S)
    if not tagged and fallbacks and "<final_answer>" not in rest:
        fence = re.search(r"```(?:\w+)?\s*(.*?)```", rest, re.S)
        body = fence.group(1) if fence else rest if re.search(r"[{(]", rest) else ""
        call = _call(body) if body.strip() else None
        if call:
            call["repairs"] = ["fenced" if fence else "bare", *call["repairs"]]
            calls, rest = [call], ""
    m = re.search(r"<final_answer>(.*?)(</final_answer>|\Z)", rest, re.S)
    if m:
        out["final_answer"] = m.group(1).strip()
        errors += [] if m.group(2) else ["unterminated_final_answer"]
    elif not calls and not errors:
        if rest.strip():
            out["final_answer"] = rest.strip()
            errors.append("untagged_final_answer")
        else:
            errors.append("empty_turn")
    return out | {"calls": calls, "errors": errors, "strict": not errors and not any(c["repairs"] for c in calls)}


def parsed(text: Column) -> Column:
    """The parsed turn of a text column; null and blank are an empty turn."""

    @F.pandas_udf(TURN)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [parse_turn(x) for x in s]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("thinking", "calls", "final_answer", "errors", "strict")})

    return run(text)
