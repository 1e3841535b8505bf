"""Reasoning blocks and their texts: shortening, canonical turns, names and spans, prefixes, gates with repair, facts that must survive."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.audits import _ST, _STOPS, turns
from millrace.plans.base import RE, TK, TR, norm, records, tasks, toks, trajectories
from millrace.plans.episodes import MS, _rw, messages
from millrace.plans.extras import _B, t41
from millrace.registry import query
from millrace.sources.tables import table

LIMIT = 120
_WS = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n\f]+", " "))
_ws = lambda x: f"regexp_replace(regexp_replace(coalesce({x}, ''), '[ \\t\\r\\n\\f]+', ' ', 'g'), '^ | $', '', 'g')"


def shorten(text: Column, limit: int) -> Column:
    """Whole sentences up to the first that no longer fits in ``limit``, else words; white space collapsed."""
    t = _WS(text)
    parts = F.split(F.regexp_replace(t, "([.!?]) ", "$1\n"), "\n")
    upto = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x)) + F.greatest(i - 1, F.lit(0)) + F.length(p) + 1)
    kept = F.size(F.filter(upto, lambda n: n <= limit))
    words = F.substring(t, 1, limit)
    cut = F.when(F.contains(words, F.lit(" ")), F.regexp_replace(words, " [^ ]*$", "")).otherwise(words)
    return F.when(F.length(t) <= limit, t).when(kept > 0, F.array_join(F.slice(parts, 1, F.greatest(kept, F.lit(1))), " ")).otherwise(cut)


_SPLIT = "string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))"
_SHORT = f"""case when length(t) <= {LIMIT} then t when k > 0 then array_to_string(parts[1:k], ' ') when contains(t[1:{LIMIT}], ' ') then regexp_replace(t[1:{LIMIT}], ' [^ ]*$', '') else t[1:{LIMIT}] end"""
_SHORTS = f"y as (select *, {_SPLIT} as parts from x), z as (select *, len([1 for i in generate_series(1, len(parts)) if coalesce(list_sum([length(p) for p in parts[1:i - 1]]), 0) + greatest(i - 2, 0) + length(parts[i]) + 1 <= {LIMIT}]) as k from y)"


@query("t24_shorten", f"with x as (select doc_id, {_ws('text')} as t from documents where text is not null), {_SHORTS} select doc_id, md5({_SHORT}) as short_md5, length({_SHORT}) as length from z")
def t24(spark, d):
    s = shorten(F.col("text"), LIMIT)
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.md5(s).alias("short_md5"), F.length(s).alias("length"))


@query("t25_canonical_turn", f"with {TR}, s as (select task_id, generate_subscripts(steps, 1) - 1 as step, unnest(steps) as s, final_answer from tr), x as (select task_id, step, s, final_answer, {_ws('s.thinking')} as t from s), {_SHORTS} select task_id, step, md5(concat_ws(chr(10), case when t <> '' then '<think>' || {_SHORT} || '</think>' end, case when len(s.tool_calls) > 0 then '<tool_call>{{\"name\": \"' || s.tool_calls[1].name || '\", \"arguments\": ' || coalesce(s.tool_calls[1].arguments, '{{}}') || '}}</tool_call>' else '<final_answer>' || trim(final_answer, ' ') || '</final_answer>' end)) as turn_md5 from z")
def t25(spark, d):
    s = trajectories(spark, d, "steps", "final_answer").select("task_id", "final_answer", F.posexplode("steps").alias("step", "s"))
    think, call = _WS(F.col("s.thinking")), F.get("s.tool_calls", F.lit(0))
    turn = F.concat_ws(
        "\n", F.when(think != "", F.concat(F.lit("<think>"), shorten(F.col("s.thinking"), LIMIT), F.lit("</think>"))),
        F.when(F.size("s.tool_calls") > 0, F.concat(F.lit('<tool_call>{"name": "'), call["name"], F.lit('", "arguments": '), F.coalesce(call["arguments"], F.lit("{}")), F.lit("}</tool_call>"))).otherwise(F.concat(F.lit("<final_answer>"), F.trim("final_answer"), F.lit("</final_answer>"))),
    )
    return s.select("task_id", "step", F.md5(turn).alias("turn_md5"))


def fold(c: Column) -> Column:
    """Text decomposed by compatibility and without combining marks; null is empty. In Arrow batches, as the engine cannot normalise."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        bare = lambda x: x if x.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch))
        return s.map(lambda x: bare(x or ""))

    return run(c)


_LATIN = "text is not null and lang in ('en', 'de', 'es', 'fr')"


@query("t28_fold")
def t28(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(fold(F.col("text"))).alias("folded_md5"))


#: Words that make a capitalised span the opening of a sentence.
SPAN_WORDS = (
    "the a an of in on at and or for to by it its this that these those he she they his her their there then when what who which as "
    "is was were be been from with after before during however although while but also such other"
).split()
_SW = ", ".join(f"'{w}'" for w in SPAN_WORDS)


def content_tokens(folded: Column) -> Column:
    return F.array_distinct(F.filter(T.words_bm25(folded), lambda t: ~t.isin(SPAN_WORDS) & (F.length(t) > 2)))


@query("t29_content_tokens", f"select doc_id, array_to_string(list_sort(list_distinct([w for w in {toks('strip_accents(text)')} if w not in ({_SW}) and length(w) > 2])), ' ') as words, len([w for w in {toks('strip_accents(text)')} if w not in ({_SW}) and length(w) > 2]) > 0 as entity_like from documents where {_LATIN}")
def t29(spark, d):
    x = table(spark, d, "documents", "doc_id", "text", "lang").filter(_LATIN).select("doc_id", content_tokens(fold(F.col("text"))).alias("w"))
    return x.select("doc_id", F.array_join(F.array_sort("w"), " ").alias("words"), (F.size("w") > 0).alias("entity_like"))


#: Fixed value: a run of one to five capitalised words, with the small words that join them.
SPAN = r"[A-Z][A-Za-z'’-]*(?:\s+(?:of\s+|the\s+|de\s+|van\s+|von\s+|and\s+)?[A-Z][A-Za-z'’-]*){0,4}"


def spans(text: Column, cap: int = 24) -> Column:
    """The first ``cap`` capitalised spans of at least three characters, each once whatever its case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({SPAN})"), F.lit(1)), lambda s: F.btrim(s, F.lit(" .,-")))
    found = F.filter(found, lambda s: F.length(s) >= 3)
    low = F.transform(found, F.lower)
    return F.slice(F.filter(found, lambda s, i: F.array_position(low, F.lower(s)) == i + 1), 1, cap)


_SPANS = f"[s for s in [trim(r, ' .,-') for r in regexp_extract_all(text, '{SPAN.replace(chr(39), chr(39) * 2)}')] if length(s) >= 3]"


@query("t31_spans", f"with x as (select doc_id, {_SPANS} as f from documents where text is not null), y as (select doc_id, f, [lower(s) for s in f] as l from x) select doc_id, array_to_string([f[i] for i in generate_series(1, len(f)) if list_position(l, l[i]) = i][1:24], '|') as spans from y")
def t31(spark, d):
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.array_join(spans(F.col("text")), "|").alias("spans"))


@query("t37_attempt_seed", f"with {TR}, s as (select task_id, generate_subscripts(steps, 1) - 1 as step from tr) select task_id, step, attempt, ('0x' || sha1(task_id || '|' || step || '|' || attempt)[1:8])::bigint as seed from s, (values (0), (1)) a(attempt)")
def t37(spark, d):
    s = trajectories(spark, d, "steps").select("task_id", F.posexplode("steps").alias("step", "_s")).select("task_id", "step", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    return s.select("task_id", "step", "attempt", T.hex_int(F.concat_ws("|", "task_id", F.col("step").cast("string"), F.col("attempt").cast("string")), 8).alias("seed"))


def as_subquestion(c: Column) -> Column:
    q = _WS(c)
    return F.when((q != "") & ~F.substring(q, -1, 1).isin(".", "?", "!"), F.concat(q, F.lit("?"))).otherwise(q)


@query("t39_subquestion", f"with {TK}, s as (select task_id, generate_subscripts(oracle_plan, 1) - 1 as step, {_ws('unnest(oracle_plan).arguments.query')} as q from tk) select task_id, step, case when q <> '' and right(q, 1) not in ('.', '?', '!') then q || '?' else q end as goal from s")
def t39(spark, d):
    s = tasks(spark, d, "oracle_plan").select("task_id", F.posexplode("oracle_plan").alias("step", "s"))
    return s.select("task_id", "step", as_subquestion(F.col("s.arguments.query")).alias("goal"))


#: Own sentences for a block: the first search, a later one after what the last revealed, and the answer.
FIRST = ["To begin I look up {goal}", "The first thing to find is {goal}", "I start with {goal}"]
LATER = ["{prev} is settled, so next comes {goal}", "From {prev} the way leads on: {goal}", "Now that I have {prev}, I ask {goal}"]
_arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("t40_think_text", f"""with {TK}, s as (select task_id, generate_subscripts(oracle_plan, 1) - 1 as step, {_ws('unnest(oracle_plan).arguments.query')} as q, chain from tk),
    p as (select task_id, step, case when q <> '' and right(q, 1) not in ('.', '?', '!') then q || '?' else q end as goal, chain[step + 1] as prev, (('0x' || sha1(task_id || '|' || step)[1:2])::bigint % 3)::integer + 1 as pick from s)
    select task_id, step, case when goal = '' then '' when step = 0 then replace({_arr(FIRST)}[pick], '{{goal}}', goal) when prev is null then '' else replace(replace({_arr(LATER)}[pick], '{{prev}}', prev), '{{goal}}', goal) end as think from p""")
def t40(spark, d):
    """The sentence before each planned search; it names nothing but the question's head or what the search before revealed."""
    s = tasks(spark, d, "oracle_plan", "chain").select("task_id", "chain", F.posexplode("oracle_plan").alias("step", "s"))
    pick = (T.hex_int(F.concat_ws("|", "task_id", F.col("step").cast("string")), 2) % 3 + 1).cast("int")
    s = s.select("task_id", "step", as_subquestion(F.col("s.arguments.query")).alias("goal"), F.get("chain", F.col("step")).alias("prev"), pick.alias("pick"))
    choose = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("pick"))
    first = F.replace(choose(FIRST), F.lit("{goal}"), F.col("goal"))
    later = F.replace(F.replace(choose(LATER), F.lit("{prev}"), F.col("prev")), F.lit("{goal}"), F.col("goal"))
    return s.select("task_id", "step", F.when(F.col("goal") == "", "").when(F.col("step") == 0, first).when(F.col("prev").isNull(), "").otherwise(later).alias("think"))


HINTS = {"empty": "Nothing was written. Write the block.", "too_long": "Shorten the block.", "markup": "Leave out tags.", "psychic_name": "Leave out names that were not shown.", "psychic_number": "Leave out numbers that were not shown."}
_HINT = "case violation " + " ".join(f"when '{k}' then '{v}'" for k, v in HINTS.items()) + " end"
_T41 = f"""select task_id, step, case when len(ws) = 0 then 'empty' when len(ws) > 80 then 'too_long' when regexp_matches(b, '[<>]') then 'markup'
    when len([w for w in regexp_extract_all(b, '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({_STOPS}, {{open}}) and not contains(lower(coalesce(prompt, '')), lower(w))]) > 0 then 'psychic_name'
    when len([n for n in regexp_extract_all(b, '\\d[\\d,]*') if {norm('n')} <> '' and not contains({norm('prompt')}, {norm('n')})]) > 0 then 'psychic_number' end as violation from wd"""


def _violations() -> str:
    from millrace.plans.extras import _OPEN

    return _T41.replace("{open}", _OPEN)


@query("t42_repair_hints", f"with {_B}, v as ({_violations()}) select violation, {_HINT} as hint, count(*) as n from v where violation is not null group by 1")
def t42(spark, d):
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[F.col("violation")]
    return t41(spark, d).filter("violation is not null").groupBy("violation").agg(F.first(hint).alias("hint"), F.count("*").alias("n"))


@query("st9_two_pass_mint", f"with {_B}, v as ({_violations()}) select count(*) as blocks, count(*) filter (where violation is null) as first_pass, count(*) filter (where violation in ('too_long', 'markup', 'psychic_number')) as repaired, count(*) filter (where violation in ('empty', 'psychic_name')) as gave_up from v")
def st9(spark, d):
    """Gate, informed repair, gate again. The repair stands in for a model: it takes out what the hint names, but writes no block anew and keeps names."""
    return t41(spark, d).agg(
        F.count("*").alias("blocks"), F.count_if(F.col("violation").isNull()).alias("first_pass"), F.count_if(F.col("violation").isin("too_long", "markup", "psychic_number")).alias("repaired"), F.count_if(F.col("violation").isin("empty", "psychic_name")).alias("gave_up"),
    )


@query("a21_mint_stats", f"with {_B}, v as ({_violations()}) select coalesce(violation, 'accepted') as outcome, count(*) as blocks, round(count(*) / sum(count(*)) over (), 6)::double as coverage from v group by 1")
def a21(spark, d):
    g = t41(spark, d).groupBy(F.coalesce("violation", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("blocks"))
    return g.select("outcome", "blocks", F.round(F.col("blocks") / F.sum("blocks").over(Window.partitionBy(F.lit(0))), 6).alias("coverage"))  # six rows


_QUERY = "regexp_extract(content, '\"query\": \"([^\"]*)\"', 1)"
_PRE = f"{MS}, c as (select *, role = 'assistant' and contains(content, '<tool_call>') as is_call from ms), l as (select *, last_value(case when is_call then {_QUERY} end ignore nulls) over (partition by record_id order by pos rows between unbounded preceding and 1 preceding) as asked from c), n as (select *, count(*) filter (where role = 'tool') over (partition by record_id order by pos) as nth from l)"


@query("t43_prefix", f"with {_PRE}, p as (select record_id, pos, is_call, case when role = 'user' then 'QUESTION ' || trim(content, ' ') when role = 'tool' then 'SEARCH ' || nth || ': ' || coalesce(asked, '') || chr(10) || content end as part from n), x as (select record_id, pos, is_call, string_agg(part, chr(10) order by pos) filter (where part is not null) over (partition by record_id order by pos rows between unbounded preceding and 1 preceding) as prefix from p) select record_id, pos, md5(coalesce(prefix, '')) as prefix_md5 from x where is_call")
def t43(spark, d):
    """What was asked and shown before each call: the question, then each earlier search with its reply."""
    before = _rw().rowsBetween(Window.unboundedPreceding, -1)
    call = (F.col("role") == "assistant") & F.contains("content", F.lit("<tool_call>"))
    m = messages(spark, d).withColumn("is_call", call)
    m = m.withColumn("asked", F.last(F.when(F.col("is_call"), F.regexp_extract("content", r'"query": "([^"]*)"', 1)), ignorenulls=True).over(before)).withColumn("nth", F.count(F.when(F.col("role") == "tool", 1)).over(_rw()))
    part = F.when(F.col("role") == "user", F.concat(F.lit("QUESTION "), F.trim("content"))).when(F.col("role") == "tool", F.concat(F.lit("SEARCH "), F.col("nth").cast("string"), F.lit(": "), F.coalesce("asked", F.lit("")), F.lit("\n"), "content"))
    return m.withColumn("part", part).withColumn("prefix", F.array_join(F.collect_list("part").over(before), "\n")).filter("is_call").select("record_id", "pos", F.md5("prefix").alias("prefix_md5"))


#: Labels that a model puts before its text.
LEADS = ["Reasoning:", "REASONING:", "Answer:", "Output:"]


@query("t44_clean", f"with {_ST}, x as (select task_id, step, {_ws(chr(114) + 'egexp_replace(t, ' + repr('<think>[^<]*</think>') + ', ' + repr(' ') + ', ' + repr('g') + ')')} as t from st where t is not null) select task_id, step, md5(trim(trim(trim(trim(regexp_replace(t, '^(?:Reasoning:|REASONING:|Answer:|Output:) *', ''), ' '), '\"'), ''''), ' ')) as cleaned_md5 from x")
def t44(spark, d):
    t = _WS(F.regexp_replace("t", "<think>[^<]*</think>", " "))
    t = F.regexp_replace(t, f"^(?:{'|'.join(LEADS)}) *", "")
    return turns(spark, d).filter("t is not null").select("task_id", "step", F.md5(F.trim(F.btrim(F.btrim(F.trim(t), F.lit('"')), F.lit("'")))).alias("cleaned_md5"))


@query("t45_apply_block", f"with {_ST} select task_id, step, md5(case when regexp_matches(t, '<think>[\\s\\S]*?</think>') then regexp_replace(t, '<think>[\\s\\S]*?</think>', '<think>It costs $1 a bale.</think>') else t end) as turn_md5 from st where t is not null")
def t45(spark, d):
    """The first block of a turn replaced by another text, taken as it is (a dollar sign is no group)."""
    start, end = F.locate("<think>", F.col("t")), F.locate("</think>", F.col("t"))
    new = F.concat(F.substring(F.col("t"), F.lit(1), start - 1), F.lit("<think>It costs $1 a bale.</think>"), F.substring(F.col("t"), end + 8, F.length("t")))
    return turns(spark, d).filter("t is not null").select("task_id", "step", F.md5(F.when((start > 0) & (end > start), new).otherwise(F.col("t"))).alias("turn_md5"))


def surfaced(text: Column, title: Column, facts: Column) -> Column:
    """The facts that a passage states, and its title, as normalised words: what a rewriting must keep."""
    said = T.norm_text(text)
    values = F.transform(F.coalesce(F.map_values(facts), F.array().cast("array<string>")), T.norm_text)
    return F.array_distinct(F.filter(F.concat(F.filter(values, lambda v: F.contains(said, v)), F.array(T.norm_text(title))), lambda v: v != ""))


def facts_present(kept: Column, rewritten: Column) -> Column:
    """Whether a rewriting holds every fact, as words or with all but letters and digits left out."""
    said = T.norm_text(rewritten)
    return F.forall(kept, lambda v: F.contains(said, v) | F.contains(F.replace(said, F.lit(" "), F.lit("")), F.replace(v, F.lit(" "), F.lit(""))))


_DOCS = f"{TK}, dc as (select task_id, unnest(documents) as x from tk), pa as (select task_id, x.doc_id as doc_id, x.title as title, x.text as text, x.facts as facts from dc), sf as (select *, list_distinct([v for v in [{norm('v')} for v in map_values(facts) if contains({norm('text')}, {norm('v')})] || [{norm('title')}] if v <> '']) as kept from pa)"
_present = lambda new: f"len([1 for v in kept if not (contains({norm(new)}, v) or contains(replace({norm(new)}, ' ', ''), replace(v, ' ', '')))]) = 0"


def passages(spark, d):
    p = tasks(spark, d, "documents").select("task_id", F.explode("documents").alias("x")).select("task_id", "x.*")
    return p.withColumn("kept", surfaced(F.col("text"), F.col("title"), F.col("facts")))


@query("t46_fact_presence", f"with {_DOCS} select task_id, doc_id, len(kept) as facts, {_present('text')} as in_text, {_present(chr(114) + 'egexp_replace(text, title, ' + repr('it') + ', ' + repr('g') + ')')} as without_title from sf")
def t46(spark, d):
    p = passages(spark, d)
    return p.select("task_id", "doc_id", F.size("kept").alias("facts"), facts_present(F.col("kept"), F.col("text")).alias("in_text"), facts_present(F.col("kept"), F.expr("replace(text, title, 'it')")).alias("without_title"))


def rewritten(text: Column, kept: Column, clients: list) -> tuple[Column, Column]:
    """(text, attempts): what the first of ``clients`` (attempt number to rewriting, null where it fails) makes with all facts kept; else the text itself."""
    tries = [(i, c(text)) for i, c in enumerate(clients, 1)]
    ok = lambda t: t.isNotNull() & facts_present(kept, t)
    return F.coalesce(*[F.when(ok(t), t) for _, t in tries], text), F.coalesce(*[F.when(ok(t), F.lit(i)) for i, t in tries], F.lit(len(clients)))


#: Stand-ins for a model, attempt by attempt: one that writes figures in words, one that fails, one that writes in capitals.
CLIENTS = [lambda t: F.regexp_replace(t, "[0-9]", "#"), lambda t: F.lit(None).cast("string"), F.upper]


@query("a22_naturalise_stats", f"with {_DOCS}, n as (select *, case when {_present(chr(114) + 'egexp_replace(text, ' + repr('[0-9]') + ', ' + repr('#') + ', ' + repr('g') + ')')} then 1 else 3 end as attempts, {_present('upper(text)')} as last_ok from sf) select count(*) as docs, count(*) filter (where attempts = 1 or last_ok) as naturalised, sum(attempts - 1)::bigint as retries, count(*) filter (where attempts = 3 and not last_ok) as fell_back from n")
def a22(spark, d):
    p = passages(spark, d)
    text, attempts = rewritten(F.col("text"), F.col("kept"), CLIENTS)
    p = p.select("text", text.alias("new"), attempts.alias("attempts"))
    fell = (F.col("new") == F.col("text")) & (F.col("attempts") == len(CLIENTS)) & (F.upper("text") != F.col("text"))
    return p.agg(F.count("*").alias("docs"), F.count_if(~fell).alias("naturalised"), F.sum(F.col("attempts") - 1).alias("retries"), F.count_if(fell).alias("fell_back"))


#: Own phrases of the relations of a route; {0} is what came before.
PHRASES = {"person_city": "the birthplace of {0}", "country_city": "the capital of {0}", "city_country": "the country of {0}", "person_employer": "the employer of {0}", "org_city": "the seat of {0}", "work_author": "the author of {0}"}
_PH = "[" + ", ".join(f"'{k}'" for k in PHRASES) + "]", "[" + ", ".join(f"'{v}'" for v in PHRASES.values()) + "]"


@query("t48_nested_phrase", f"with recursive {TK}, r as (select task_id, route, chain[1] as head from tk where len(route) > 0 and len(chain) > 0), w(task_id, i, phrase) as (select task_id, 0, head from r union all select w.task_id, i + 1, replace(coalesce({_PH[1]}[list_position({_PH[0]}, route[i + 1])], '{{0}}'), '{{0}}', phrase) from w join r using (task_id) where i < len(route)) select task_id, max_by(phrase, i) as phrase from w group by 1")
def t48(spark, d):
    """The question part of a route: its relations' phrases put into one another, from the head of the chain on; unknown relations add nothing."""
    known = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    phrase = F.aggregate("route", F.get("chain", F.lit(0)), lambda a, r: F.replace(F.coalesce(known[r], F.lit("{0}")), F.lit("{0}"), a))
    return tasks(spark, d, "route", "chain").filter((F.size("route") > 0) & (F.size("chain") > 0)).select("task_id", phrase.alias("phrase"))


EASY = {"musique_2hop": 0.60, "musique_3hop": 0.30, "musique_4hop": 0.10}
HARD = {"musique_2hop": 0.20, "musique_3hop": 0.35, "musique_4hop": 0.45}


def erf(x: Column) -> Column:
    """The error function by the rational approximation of Abramowitz and Stegun (7.1.26), good to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592
    return F.signum(x) * (1 - poly * t * F.exp(-x * x))


_ERF = "sign(z) * (1 - (((((1.061405429::double * t - 1.453152027::double) * t) + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-z * z))"


@query("t52_e2h", f"with f as (select i / 20.0::double as f from generate_series(0, 20) g(i)), z as (select f, (f - 0.7::double) / (0.25::double * sqrt(2.0::double)) as z from f), t as (select *, 1 / (1 + 0.3275911::double * abs(z)) as t from z), g as (select f, 0.5 * (1 + {_ERF}) as g from t) select f, round(g, 5) as weight, k as family, round((1 - g) * e + g * h, 5) as share from g, (values " + ", ".join(f"('{k}', {EASY[k]}::double, {HARD[k]}::double)" for k in EASY) + ") m(k, e, h)")
def t52(spark, d):
    """Shares of the families along a run, from the easy to the hard mix by a normal distribution function; both mixes sum to one, so their mean does."""
    f = spark.range(21).select((F.col("id") / 20.0).alias("f")).withColumn("g", 0.5 * (1 + erf((F.col("f") - 0.7) / (0.25 * 2**0.5))))
    mix = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.lit(EASY[k]).alias("e"), F.lit(HARD[k]).alias("h")) for k in EASY]))
    m = f.select("f", "g", mix.alias("m")).select("f", "g", "m.*")
    return m.select("f", F.round("g", 5).alias("weight"), "family", F.round((1 - F.col("g")) * F.col("e") + F.col("g") * F.col("h"), 5).alias("share"))


@query("x05_subset", f"with {TR}, {TK} select tr.task_id, len([t for t in tk.required_tools if not list_contains([c.name for c in call_log], t)]) = 0 as all_called from tr join tk on tk.task_id = split_part(tr.task_id, '#', 1)")
def x05(spark, d):
    t = tasks(spark, d, "required_tools").select(F.col("task_id").alias("base"), "required_tools")
    j = trajectories(spark, d, "call_log").withColumn("base", F.substring_index("task_id", "#", 1)).join(t, "base")
    return j.select("task_id", (F.size(F.array_except(F.coalesce("required_tools", F.array().cast("array<string>")), F.transform("call_log", lambda c: c["name"]))) == 0).alias("all_called"))


@query("pr07_chain_len", f"with {TK} select task_id, len([1 for s in oracle_plan if s.expect_error is null]) as chain_len from tk")
def pr07(spark, d):
    return tasks(spark, d, "oracle_plan").select("task_id", F.size(F.filter("oracle_plan", lambda s: s["expect_error"].isNull())).alias("chain_len"))


_LEN = "coalesce(list_sum([length(coalesce(m.content, '')) for m in messages]), 0)"
_ANS = "len([1 for m in messages if m.role = 'assistant' and coalesce(m.content, '') <> ''])"


@query("pr11_length_drop", f"with {RE} select record_id, {_LEN}::bigint as length, {_ANS} as spans, {_LEN} > 2000 or {_ANS} = 0 as dropped from re")
def pr11(spark, d):
    n = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    k = F.size(F.filter("messages", lambda m: (m["role"] == "assistant") & (F.coalesce(m["content"], F.lit("")) != "")))
    return records(spark, d, "messages").select("record_id", n.alias("length"), k.alias("spans"), ((n > 2000) | (k == 0)).alias("dropped"))


@query("pr10_encode_eligible", f"with {TR} select task_id, stop_reason is distinct from 'empty_turn' and len([1 for s in steps if len([1 for x in s.parse_errors if contains(x, 'unterminated_')]) > 0]) = 0 and {_ANS} > 0 and {_LEN} <= 4000 as eligible from tr where steps is not null and messages is not null")
def pr10(spark, d):
    t = trajectories(spark, d, "stop_reason", "steps", "messages").filter("steps is not null and messages is not null")
    cut = F.exists("steps", lambda s: F.coalesce(F.exists(s["parse_errors"], lambda x: F.contains(x, F.lit("unterminated_"))), F.lit(False)))
    n = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    k = F.size(F.filter("messages", lambda m: (m["role"] == "assistant") & (F.coalesce(m["content"], F.lit("")) != "")))
    return t.select("task_id", (F.coalesce(F.col("stop_reason") != "empty_turn", F.lit(True)) & ~cut & (k > 0) & (n <= 4000)).alias("eligible"))


_KIND = "[coalesce(nullif(regexp_extract(trim(x.doc_id), '^(city|c|f|o|p|w)', 1), ''), '?') for x in from_json(json_extract(tool, '$.results'), '[{\"doc_id\":\"VARCHAR\"}]')]"


@query("pr12_block_select", f"with {MS}, w as (select *, role = 'assistant' and contains(content, '<tool_call>') as is_call, last_value(case when role = 'tool' then content end ignore nulls) over {'(partition by record_id order by pos)'} as tool from ms), s as (select *, sum(is_call::int) over (partition by record_id order by pos) - 1 as step from w), k as (select record_id, pos, step, case when tool like '{{%' then {_KIND} end as kinds from s where is_call and contains(content, '<think>') and tool is not null) select record_id, pos, step::bigint as step from k where step > 0 and len([x for x in kinds[2:] if x = kinds[1]]) >= 1")
def pr12(spark, d):
    """The blocks worth writing anew: before a later call, after a reply whose best hit has a sibling of its kind."""
    call = (F.col("role") == "assistant") & F.contains("content", F.lit("<tool_call>"))
    m = messages(spark, d).withColumn("is_call", call).withColumn("tool", F.last(F.when(F.col("role") == "tool", F.col("content")), ignorenulls=True).over(_rw())).withColumn("step", F.sum(F.col("is_call").cast("int")).over(_rw()) - 1)
    kind = lambda x: F.coalesce(F.nullif(F.regexp_extract(F.trim(x["doc_id"]), "^(city|c|f|o|p|w)", 1), F.lit("")), F.lit("?"))
    kinds = F.when(F.startswith("tool", F.lit("{")), F.transform(F.from_json("tool", "results array<struct<doc_id:string>>")["results"], kind))
    m = m.filter(F.col("is_call") & F.contains("content", F.lit("<think>")) & F.col("tool").isNotNull() & (F.col("step") > 0)).withColumn("kinds", kinds)
    return m.filter(F.size(F.filter("kinds", lambda k: k == F.get("kinds", F.lit(0)))) > 1).select("record_id", "pos", "step")


@query("q03_conflicting_records", f"with {MS}, a as (select record_id, lower({_ws('max(content) filter (where role = ' + repr('user') + ')')}) as q, max_by(regexp_extract(content, '<final_answer>(.*)</final_answer>', 1, 's'), pos) filter (where role = 'assistant') as answer from ms group by 1), c as (select q from a where answer <> '' group by 1 having count(distinct answer) > 1) select record_id from a join c using (q) where answer <> ''")
def q03(spark, d):
    """Records whose question has another answer in another record."""
    m = messages(spark, d)
    said = F.col("role") == "assistant"
    a = m.groupBy("record_id").agg(F.lower(_WS(F.max(F.when(F.col("role") == "user", F.col("content"))))).alias("q"), F.max_by(F.when(said, F.regexp_extract("content", r"(?s)<final_answer>(.*)</final_answer>", 1)), F.when(said, F.col("pos"))).alias("answer")).filter("answer <> ''")
    bad = a.groupBy("q").agg(F.countDistinct("answer").alias("n")).filter("n > 1").select("q")
    return a.join(bad, "q", "left_semi").select("record_id")


@query("q05_first_think", f"with {MS}, u as (select record_id, max(content) filter (where role = 'user') as prompt, min_by(content, pos) filter (where role = 'assistant') as first from ms group by 1), t as (select record_id, prompt, regexp_replace(regexp_extract(first, '<think>([^<]*)</think>', 1), '(^|[.?!:])[ \\t\\n\\r]*[A-Za-z]+', ' . ', 'g') as think from u) select record_id, len([w for w in regexp_extract_all(think, '[A-Za-z]+') if regexp_matches(w, '^[A-Z]') and lower(w) not in ({_STOPS}) and not contains(lower(coalesce(prompt, '')), lower(w))]) > 0 as psychic from t where think <> ''")
def q05_first(spark, d):
    """The part of the think audit that SQL can say: the first block, before anything was shown; words that open a sentence are no names."""
    m = messages(spark, d)
    said = F.col("role") == "assistant"
    u = m.groupBy("record_id").agg(F.max(F.when(F.col("role") == "user", F.col("content"))).alias("prompt"), F.min_by(F.when(said, F.col("content")), F.when(said, F.col("pos"))).alias("first"))
    think = F.regexp_replace(F.regexp_extract("first", "<think>([^<]*)</think>", 1), r"(^|[.?!:])[ \t\n\r]*[A-Za-z]+", " . ")
    return u.withColumn("think", think).filter("think <> ''").select("record_id", (F.size(T.invented_names(F.col("think"), F.col("prompt"))) > 0).alias("psychic"))
