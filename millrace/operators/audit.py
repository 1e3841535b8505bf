"""The audit of a training record, in Arrow batches: what its turns name or answer before they have been shown it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import FUNCTION_WORDS

AXES = "struct<calls:int,psychic_first:boolean,psychic_think:boolean,unretrieved:boolean,leaky:boolean,question:string,answer:string>"
_CALL, _FINAL, _THINK = (re.compile(f"<{t}>(.*?)</{t}>", re.S) for t in ("tool_call", "final_answer", "think"))
_STOP = frozenset(FUNCTION_WORDS)


def _norm(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]+", " ", (text or "").lower())).strip()


def _names(text: str, prompt: str, prose: bool = False) -> list[str]:
    """Capitalised words that the prompt does not hold; in prose those that open a sentence are none."""
    low, out = prompt.lower(), []
    for m in re.finditer("[A-Za-z]+", text):
        w = m.group()
        if w[0].isupper() and w.lower() not in _STOP and w.lower() not in low:
            before = text[: m.start()].rstrip()
            if not prose or (before and before[-1] not in ".?!:"):
                out.append(w)
    return out


def _shown(content: str) -> list[str]:
    """Title and text of each hit of a tool's answer; the answer as it is if it has another form."""
    try:
        return [f"{h.get('title', '')} {h.get('text', '')}" for h in json.loads(content)["results"]]
    except (ValueError, KeyError, TypeError, AttributeError):
        return [content]


def _query(call: str) -> str:
    try:
        got = json.loads(call)["arguments"]["query"]
    except (ValueError, KeyError, TypeError):
        return ""
    return got if isinstance(got, str) else ""


def audit_record(messages) -> dict:
    """The axes of one record; a record without answer is unretrieved, and so is one whose answer no hit holds."""
    turns = [(m["role"], m["content"] or "") for m in (messages if messages is not None else []) if m is not None]
    user = next((c for r, c in turns if r == "user"), "")
    said, shown = [c for r, c in turns if r == "assistant"], [[_norm(x) for x in _shown(c)] for r, c in turns if r == "tool"]
    queries = [_query(q) for c in said for q in _CALL.findall(c)]
    seen, think = _norm(user), False
    for i, c in enumerate(said):
        m = _THINK.search(c)
        think = think or bool(m) and any(_norm(w) not in seen for w in _names(m.group(1), user, prose=True))
        if i < len(shown):
            seen += " " + " ".join(shown[i])
    m = _FINAL.search(said[-1]) if said else None
    answer = m.group(1).strip() if m else None
    want = _norm(answer)
    hit = next((i for i, t in enumerate(shown, 1) if want and any(want in x for x in t)), None)
    return {
        "calls": len(queries), "psychic_first": bool(queries) and bool(_names(queries[0], user)), "psychic_think": think, "unretrieved": hit is None,
        "leaky": hit is not None and hit < len(shown), "question": " ".join(user.split()).lower(), "answer": answer,
    }


def audited_axes(messages: Column) -> Column:
    """The axes of a column of messages (role, content)."""

    @F.pandas_udf(AXES)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [audit_record(x) for x in s]
        out = pd.DataFrame(rows, columns=["calls", "psychic_first", "psychic_think", "unretrieved", "leaky", "question", "answer"])
        return out.astype({"calls": "int32"} | dict.fromkeys(("psychic_first", "psychic_think", "unretrieved", "leaky"), "bool"))

    return run(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
