"""Text and scalar functions as columns: tokenisers, normalisers, overlap scores, answer matching, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are capitalised without being names.
FUNCTION_WORDS = (
    "a an the of in on at and or for to by i it its this that these those he she they "
    "his her their there then when what where which who whom whose why how as is was "
    "were be been from with about after before during however although while but also "
    "such other did does do done can could would should will may might must"
).split()
# Phrases that abstain.
ABSTENTIONS = [
    "not available", "no information", "cannot be determined", "can't be determined", "not found", "does not exist", "doesn't exist", "no such", "unable to find",
    "not enough information", "insufficient information", "no record", "not in the", "unavailable", "cannot answer", "can't answer", "no data",
]
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def words_bm25(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def norm_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " "), " +", " "))


def words_squad(c: Column) -> Column:
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))


def token_f1(gold: Column, pred: Column) -> Column:
    """F1 of the multiset overlap of two arrays of words; 0 if either is empty."""
    times = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    common = F.aggregate(F.array_distinct(gold), F.lit(0), lambda a, w: a + F.least(times(gold, w), times(pred, w)))
    return F.when(common > 0, 2.0 * common / (F.size(gold) + F.size(pred))).otherwise(F.lit(0.0))


def gold_forms(kind: Column, value: Column) -> Column:
    """Surface forms of a gold answer (value is JSON): one, each of any_of, all_of in one; none has none."""
    many, one = F.from_json(value, "array<string>"), F.coalesce(F.regexp_extract(value, r'^"(.*)"$', 1), F.lit(""))
    scalar = F.when(one == "", value).otherwise(one)
    return F.when(kind == "any_of", many).when(kind == "all_of", F.array(F.array_join(many, " "))).when(kind == "none", F.array().cast("array<string>")).otherwise(F.array(scalar))


def answer_f1(forms: Column, answer: Column) -> Column:
    pred = words_squad(answer)
    return F.coalesce(F.array_max(F.transform(forms, lambda g: token_f1(words_squad(g), pred))), F.lit(0.0))


def numbers(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(-?\d[\d,]*\.?\d*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def match_answer(kind: Column, value: Column, tol: Column, answer: Column, strict: bool = False) -> Column:
    """struct(ok, reason) of an answer against its gold; ok is null for a kind that is unknown."""
    want = value.try_cast("double")
    near = F.coalesce(tol, F.greatest(F.lit(0.01), F.abs(want) * 0.005))
    nums = numbers(answer)
    distinct = F.size(F.array_distinct(F.transform(nums, lambda n: F.round(n, 6))))
    got, forms, low = norm_text(answer), gold_forms(kind, value), F.lower(answer)
    many = F.from_json(value, "array<string>")
    missing = F.filter(many, lambda v: ~F.contains(got, norm_text(v)))
    res = lambda ok, why: F.struct(F.lit(ok).alias("ok"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    verbose = F.when(F.lit(strict) & (distinct > 2), res(False, "shotgun_strict")).when(distinct > 4, res(True, "matched_but_verbose")).otherwise(res(True, "ok"))
    numeric = F.when(F.size(nums) == 0, res(False, "no_number_in_answer")).when(F.exists(nums, lambda n: F.abs(n - want) <= near), verbose).otherwise(res(False, "wrong_number"))
    first = norm_text(forms[0])
    text = F.when(first == "", res(False, "empty_gold")).when(F.contains(got, first), res(True, "ok")).otherwise(res(False, "text_mismatch"))
    any_of = F.when(F.exists(many, lambda v: F.contains(got, norm_text(v))), res(True, "ok")).otherwise(res(False, "text_mismatch"))
    all_of = F.when(F.size(missing) == 0, res(True, "ok")).otherwise(res(False, F.concat(F.lit("missing:"), F.array_join(F.slice(missing, 1, 3), "|"))))
    none = F.when(F.exists(F.array(*[F.lit(m) for m in ABSTENTIONS]), lambda m: F.contains(low, m)), res(True, "ok")).otherwise(res(False, "did_not_abstain"))
    return (
        F.when(answer.isNull(), res(False, "no_answer")).when(kind == "numeric", numeric).when(kind == "text", text)
        .when(kind == "any_of", any_of).when(kind == "all_of", all_of).when(kind == "none", none)
    )


def invented_names(query: Column, prompt: Column, extra: tuple[str, ...] = ()) -> Column:
    """Capitalised words of ``query`` that ``prompt`` does not hold and that are not function words."""
    stop, low = [*FUNCTION_WORDS, *extra], F.lower(F.coalesce(prompt, F.lit("")))
    caps = F.filter(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: w.rlike("^[A-Z]"))
    return F.filter(caps, lambda w: ~F.lower(w).isin(stop) & ~F.contains(low, F.lower(w)))


def unseen_numbers(text: Column, seen: Column) -> Column:
    """Runs of digits in ``text`` that do not occur in ``seen`` (normalised text)."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,]*)"), F.lit(1))
    return F.filter(runs, lambda d: (norm_text(d) != "") & ~F.contains(seen, norm_text(d)))


def longest_name(query: Column) -> Column:
    """The longest run of capitalised words in lower case, by words, then characters, the first of equals; empty if there is none."""
    runs = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([A-Z][A-Za-z0-9']*(?:\s+[A-Z][A-Za-z0-9']*)*)"), F.lit(1))
    sized = F.transform(runs, lambda r, i: F.struct(F.size(F.split(r, r"\s+")).alias("w"), F.length(r).alias("n"), (-i).alias("i"), r.alias("r")))
    return F.coalesce(F.lower(F.array_max(sized)["r"]), F.lit(""))


def canonical_value(v: Column) -> Column:
    """A flat argument for comparison: numbers and numeric strings to six places, other text trimmed in lower case."""
    t = F.trim(v)
    return F.coalesce(F.round(t.try_cast("double"), 6).cast("string"), F.lower(t))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 20), F.lit("... [+"), (F.length(c) - (n - 20)).cast("string"), F.lit(" chars]"))).otherwise(c)


def cut_at_stop(c: Column, stops: list[str]) -> Column:
    """Text up to and with the stop string that comes first; as it is if none occurs."""
    ends = F.array(*[F.when(F.locate(s, c) > 0, F.locate(s, c) + len(s) - 1) for s in stops])
    end = F.array_min(F.filter(ends, lambda x: x.isNotNull()))
    return F.when(end.isNotNull(), F.substring(c, F.lit(1), end)).otherwise(c)


def tidy(c: Column) -> Column:
    """Spaces before punctuation and 's closed up, if the words stay the same."""
    t = F.regexp_replace(F.regexp_replace(c, r"\s+([?.,!;:])", "$1"), r"\s+('s)\b", "$1")
    return F.when(F.array_join(words_bm25(t), " ") == F.array_join(words_bm25(c), " "), t).otherwise(c)


def norm_question(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def hex_int(c: Column, digits: int) -> Column:
    """The first hex digits of the SHA-1 of c, as a number."""
    return F.conv(F.substring(F.sha1(c), 1, digits), 16, 10).cast("long")


def evidence_ids(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(c, "[_-]+"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("long"))))
