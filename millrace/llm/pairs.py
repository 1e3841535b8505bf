"""Problem 4: defective prompt and response pairs.

Ordered rules, each of which can fire: ``empty``, ``copies_question``, ``refusal``, ``truncated``, ``other_language``.
Everything that one pair shows is decided row by row in an Arrow function. What one pair cannot show, whether a text
without a final stop breaks off or only lacks the stop, is read from the corpus: for each trailing context of up to
three words (names and numbers masked) the answers tell how often a sentence ends there and how often it goes on. Both
come from one pass over the texts, which is written once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.canonical import canonical, content, fields, visible
from millrace.session import written

#: The order in which one defect is chosen where several are shown.
DEFECTS = ["empty", "copies_question", "refusal", "truncated", "other_language"]

# Function words by which a sentence shows its language, of the languages of Latin script.
WORDS = {
    "en": "i my am will would must but or an the of and to in is that was by for with which who had it its there about as from on this not do are has have were their been did does what where how many you your people live one",
    "de": "der die das und ist von in den dem des mit wurde für nicht auf ein eine einer im am zu bei nach aus sich wie wer welchem welche viele es steht keinem gehört hat haben leben liegt dort als etwa um jahr ich kann",
    "es": "el la los las de y que en un una es fue por con para no lo su se del al desde entre cerca como quién cuántas qué está viven había año según hasta casi todas allí sede tiene circula",
    "fr": "le la les de des et est un une du que qui dans par pour en au aux ne pas ce cette sur se à a été où avec depuis selon près son sa ses y il elle combien fondée siège siège vivent ville environ surtout petit",
    "it": "il lo gli della delle dei nel nella nelle di che è sono non con per una uno fu stato stata dal dalla alla anche questo questa suo sua ha hanno come dove quando più tra",
    "pt": "o os não são dos das pelo pela nos nas uma um foi ao à com por que em seu sua você ele ela também mais como quando onde há está tem",
    "nl": "de het een van en niet met voor op aan zijn werd naar bij uit door dat deze dit ook om hij zij wordt heeft hebben waar wanneer",
    "pl": "na się nie jest że przez od po oraz który która został została był była są jako dla jego jej ich",
}
#: Scripts that one or a few languages use, by their ranges; the first that a text shows names its language.
SCRIPTS = [("ja", "぀-ヿ"), ("ko", "가-힣ᄀ-ᇿ"), ("zh", "㐀-鿿"), ("ru", "Ѐ-ӿ"), ("el", "Ͱ-Ͽ"), ("he", "֐-׿"), ("ar", "؀-ۿ"), ("hi", "ऀ-ॿ"), ("th", "฀-๿"), ("hy", "԰-֏"), ("ka", "Ⴀ-ჿ")]
_SCRIPTS = [(k, re.compile(f"[{r}]")) for k, r in SCRIPTS]
#: Scripts without spaces between words: there letters are counted, elsewhere words.
_DENSE = {"ja", "zh", "th"}
_WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
# How a prompt asks for a language.
ASKS = {
    "en": r"english|englisch|inglés|anglais|английск|英語", "de": r"german\b|deutsch|alemán|allemand|немецк|ドイツ語",
    "es": r"spanish|spanisch|español|espagnol|испанск|スペイン語", "fr": r"french|französisch|francés|français|французск|フランス語",
    "ru": r"russian|russisch|ruso\b|russe\b|русск|ロシア語|俄语|러시아어", "ja": r"japanese|japanisch|japonés|japonais|японск|日本語|日语|일본어",
    "it": r"italian|italienisch|italiano|italien\b|итальян|イタリア語|意大利语", "pt": r"portugu|portugies|португал|ポルトガル語|葡萄牙语", "nl": r"dutch|niederländisch|neerland|néerland|holandés|нидерланд|オランダ語",
    "pl": r"polish|polnisch|polaco|polonais|польск|ポーランド語", "zh": r"chinese|chinesisch|chino\b|chinois|китайск|中国語|中文|汉语", "ko": r"korean|koreanisch|coreano|coréen|корейск|韓国語|한국어",
}
_ASKS = {k: re.compile(v, re.I) for k, v in ASKS.items()}

# What a refusal declines to do, and phrases that decline, by language. Each is a shape (who, will not or may
# not, do what), not a sentence.
_DO = r"(?:help|assist|answer|reply|respond|comply|discuss|engage|provide|share|say|tell|speak|comment|speculate|do (?:that|this|so)|fulfil|fulfill|talk about|go into|support|complete|continue|give)"
REFUSALS = [
    rf"\b(?:i|we) (?:can ?no?t|can['’]?t|could ?n['’]?t|won['’]?t|will not|shall not|must not|may not|do not want to|don['’]t want to|refuse to)(?: \w+){{0,2}} {_DO}\b", rf"\b(?:i am|i['’]?m|we are|we['’]re) (?:not able|unable|unwilling|not willing|not at liberty|not in a position|not allowed|not permitted|not authori[sz]ed|not comfortable)\b", r"\b(?:i|we)(?:['’]d| would)? (?:rather|prefer) (?:not|to not)\b",
    r"\bi (?:have|need|will have) to (?:pass|decline|refuse)\b", r"\b(?:i|we) (?:must|have to|need to|will|shall|respectfully)? ?(?:decline|refuse)\b", r"\b(?:i|we) (?:must|will|shall) pass on\b",
    r"\bnot (?:be )?(?:appropriate|allowed|permitted|comfortable|authori[sz]ed|possible for me)\b.{0,30}\b(?:answer|discuss|help|respond|reply|share|talk|say|give)", r"\b(?:would|will) (?:break|violate|breach) (?:my|our|the) (?:rules|guidelines|instructions|polic)", r"\b(?:my|our) (?:instructions|rules|guidelines|policy|policies) (?:keep|prevent|forbid|prohibit|stop|do not (?:allow|let|permit)|don['’]t (?:allow|let|permit))",
    r"\b(?:against|violates?|breaks?) (?:my|our) (?:guidelines|rules|instructions|policy|policies|programming)\b", r"\bas (?:an? )?(?:ai|assistant|(?:only )?a? ?language model)\b.{0,40}\b(?:unable|can ?not|can['’]t|not able|must|refuse|decline)", r"\bi am only an? (?:ai|assistant|language model)\b", r"\b(?:outside|beyond) (?:of )?what (?:i|we) (?:may|can|am|are)\b", r"\bno comment\b", r"\b(?:let us|let['’]s) (?:change the subject|talk about something else|speak of something else)\b",
    r"\b(?:darf|kann|möchte|werde) (?:ich|das|dies)? ?(?:\w+ ){0,6}?nicht (?:\w+ ){0,2}?(?:beantworten|helfen|antworten|sagen|dienen|weiterhelfen|eingehen|besprechen)", r"\bdabei kann ich nicht helfen", r"\bnicht (?:erlaubt|gestattet)\b.{0,40}\b(?:beantworten|antworten)", r"\b(?:muss|möchte) (?:\w+ ){0,4}?ablehnen\b", r"\bleider nicht (?:beantworten|helfen)",
    r"\bno (?:puedo|podemos|me es posible|me está permitido|estoy autorizad[oa] (?:a|para)|debo|quiero|se me permite)\b.{0,20}\b(?:ayudar|responder|contestar|cumplir|hablar|comentar|decir)", r"\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|negarme|no responder|no contestar)", r"\bmis (?:instrucciones|normas|reglas) (?:\w+ ){0,2}(?:impiden|prohíben|permiten)", r"\bva (?:en )?contra (?:de )?mis (?:instrucciones|normas|reglas)",
    r"\bne (?:peux|pouvons|puis|souhaite|veux|suis)(?: \w+){0,2} (?:pas )?(?:vous aider|aider|répondre|dire|autorisée? à|en mesure de)", r"\b(?:préfère|préférerais) ne pas (?:répondre|en parler)", r"\b(?:dois|vais) (?:\w+ )?(?:refuser|décliner)", r"\bmes (?:consignes|règles|instructions) (?:\w+['’]?){0,2}\s?(?:l['’]interdisent|m['’]interdisent|m['’]empêchent)",
    r"\bnon (?:posso|possiamo|sono autorizzat[oa] a|sono in grado di|mi è (?:possibile|permesso|consentito)|voglio|intendo|desidero)(?: \w+){0,3} (?:rispond\w+|aiut\w+|dire|dirlo|fornir\w+|discuter\w+|commentare|parlarne|soddisfare)", r"\b(?:devo|preferisco|sono costrett[oa] a) (?:\w+ )?(?:rifiutar\w*|declinare|non rispondere)", r"\ble mie (?:istruzioni|regole) (?:\w+ ){0,2}(?:impediscono|vietano|permettono)",
    r"\bnão (?:posso|podemos|estou autorizad[oa] a|consigo|me é (?:possível|permitido)|quero|devo)(?: \w+){0,3} (?:respond\w+|ajud\w+|dizer|fornecer|discutir|comentar|atender|falar)", r"\b(?:devo|tenho de|tenho que|prefiro) (?:recusar|declinar|não responder)",
    r"\b(?:kan|mag|wil|zal) (?:ik|we) (?:\w+ ){0,5}?niet (?:\w+ ){0,2}?(?:beantwoorden|helpen|antwoorden|zeggen|bespreken)", r"\b(?:ik|we) (?:kan|mag|wil|zal|kunnen|mogen) (?:\w+ ){0,5}?niet (?:\w+ ){0,2}?(?:beantwoorden|helpen|antwoorden|zeggen|bespreken)", r"\bik moet (?:\w+ ){0,4}(?:weigeren|afwijzen)\b",
    r"\bnie (?:mogę|możemy|wolno mi|chcę|będę|jestem w stanie)(?: \w+){0,3} (?:odpowi\w+|odpowiada\w+|pomóc|udziel\w+|powiedzieć|komentować|rozmawiać)", r"\b(?:muszę odmówić|odmawiam)\b",
    r"не (?:могу|можем|буду|вправе|хочу|имею права|стану)(?: \w+){0,3} (?:помо\w+|ответ\w+|отвеч\w+|обсужд\w+|комментир\w+|сказать)", r"не разрешено (?:отвечать|обсуждать|говорить)", r"\b(?:вынужден\w*|должен|должна|придётся)(?: \w+){0,2} отказат\w+", r"(?:правила|инструкции)(?: \w+){0,2} (?:запрещают|не позволяют)",
    r"(?:お答え|お応え|回答|お手伝い|返答|対応|お話し)(?:する|を|に|は|いたし|し)*(?:こと)?(?:は|が)?(?:できません|できかねます|致しかねます|いたしかねます|出来ません|控え)", r"(?:お断り|拒否)(?:し|いたし|させ)", r"規則により.{0,20}(?:できません|できない)",
    r"(?:不能|无法|無法|不便|不会|不會|不可以|拒绝|拒絕|不允许|不允許)(?:为您|為您|对此|對此|给您|帮您|就此)?(?:回答|回复|回覆|协助|協助|帮助|幫助|提供|讨论|討論|满足|滿足|评论|評論|透露)", r"恕(?:我)?(?:不能|无法|無法|难|難)(?:回答|从命|從命|奉告)?",
    r"(?:답변|대답|응답|도움|말씀|논의|제공)(?:을|를|은|는|해)? ?(?:해 |드)?(?:드릴|할|줄)? ?(?:수 없|수가 없|드리기 어렵|하기 어렵|하지 않겠|거절|거부)", r"도와 ?드릴 수 없",
]
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I | re.S)
# Saying that the passages do not hold the answer is an answer.
NOT_THERE = re.compile(r"\b(?:passages?|documents?|texts?|sources?|records?|excerpts?|given|abschnitt\w*|quellen?|pasajes?|fuentes?|extraits?|brani|trechos?|отрывк\w+|источник\w+)\b|文章|资料|문서|cannot be (?:answered|determined) from|could not find", re.I)

_HAN = re.compile("[㐀-鿿]")
_TAG = re.compile(r"</?\w[^<>]*>")
_OPEN_TAG = re.compile(r"<(final_answer|answer|think|tool_call)>", re.I)
_CLIPPED = re.compile(r"(?:\.\.\.|…)\s*(?:\[\+?\d+ (?:chars?|characters|tokens?|words?)\]|\[truncated\])?\s*$", re.I)
_STOP = "。.!?！？؟"
_CLOSERS = "\"'”’»)]}」』*_ \t\r\n　"
_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "「": "」", "『": "』"}
_TOKEN = re.compile(r"(?P<num>\d[\d.,:/]*\d|\d)|(?P<cjk>[぀-ヿ㐀-鿿])|(?P<name>[A-ZÀ-ÖØ-ÞА-ЯЁ](?:(?![぀-ヿ㐀-鿿])[^\W\d_])*(?:['’\-](?:(?![぀-ヿ㐀-鿿])[^\W\d_])+)*)|(?P<word>(?:(?![぀-ヿ㐀-鿿])[^\W\d_])+(?:['’\-](?:(?![぀-ヿ㐀-鿿])[^\W\d_])+)*)|(?P<p>[,;:、，；：])|(?P<stop>[.!?。！？])")
_DANGLING = re.compile(r"(?:[,;:、，；：(\[{«“「『\-–—/&=]|(?<=\s)[\"'“]|:\s*\(?\d{1,2}[).]|(?<=\s)\(\w{0,6})\s*$")
_LEAD = re.compile(r"^[\s>*\"'“(]*[^:：\n]{1,24}[:：]\s*")


def bare(answer: str) -> str:
    return _TAG.sub(" ", answer)


def language_of(text: str) -> tuple[str | None, int]:
    """The language that a text's script and function words show, and how many of its words (or letters) do."""
    letters = max(1, sum(c.isalpha() for c in text))
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not text.isascii():
        for lang, script in _SCRIPTS:
            if lang in _DENSE or lang == "ko":
                n = len(script.findall(text)) + (len(_HAN.findall(text)) if lang == "ja" else 0)
                if n >= 4 and (lang != "ja" or script.search(text)) and n * 6 >= letters:
                    return lang, n
            elif (n := sum(bool(script.search(w)) for w in words)) >= 2 and n * 3 >= len(words):
                return lang, n
    hits = {k: sum(w in v for w in words) for k, v in _WORDS.items()}
    best = max(hits, key=lambda k: hits[k])
    others = max(v for k, v in hits.items() if k != best)
    return (best, hits[best]) if hits[best] > others else (None, hits[best])


def _enough(lang: str | None, n: int, terse: bool = False) -> bool:
    """Whether so many words or letters show a language; a list of named fields has few words that could."""
    return lang is not None and n >= (6 if lang in _DENSE else 4 if lang == "ko" else 1 if terse else 2)


@dataclass
class Said:
    """The language of an answer to a prompt that lists named fields, whose own language shows in few words if at all."""

    prompt: str  # key of the prompt
    lang: str
    foreign: bool  # whether the list's few words show another language
    alone: bool  # whether the answer counts as foreign if no other answer to the prompt tells


def other_language(prompt: str, text: str) -> tuple[bool, Said | None]:
    """Whether the answer is a sentence in a language that the prompt is neither written in nor asks for.

    A prompt that lists named fields is too terse to tell: what is said there comes back for a comparison with the other
    answers to the same prompt. Without those, an answer that takes up one of the list's values may choose its language.
    """
    lang, n = language_of(text)
    if not _enough(lang, n) or (lang not in _DENSE and lang != "ko" and len(re.findall(r"[^\W\d_]+", text)) < 4):
        return False, None
    shown = visible(prompt)
    listed = fields(shown) if ":" in shown or "=" in shown else None
    own, m = language_of(shown if listed else prompt)
    foreign = own != lang and _enough(own, m, bool(listed)) and not any(k == lang and p.search(prompt) for k, p in _ASKS.items())
    if not listed:
        return foreign, None
    said = content(visible(text))
    takes = any(len(v) > 3 and not v.isdigit() and v in said for _, v in listed)
    return False, Said(hashlib.md5(prompt.encode("utf-8", "surrogatepass")).hexdigest(), lang, foreign, not takes)


def copies(prompt: str, answer: str) -> bool:
    p, a = content(visible(prompt)), content(visible(bare(answer)))
    if len(p) < 8 or not a:
        return False
    led = content(visible(_LEAD.sub("", bare(answer), count=1)))
    for x in {a, led}:
        if x == p or (len(x) >= 0.75 * len(p) and x in p) or (len(x) > len(p) and len(x.replace(p, "")) <= 0.02 * len(p)):
            return True
    return canonical(prompt) == canonical(bare(answer))


def unclosed(answer: str) -> bool:
    """A tag, bracket or quotation mark that is opened and not closed."""
    for m in _OPEN_TAG.finditer(answer):
        if f"</{m.group(1).lower()}>" not in answer[m.end() :].lower():
            return True
    text = bare(answer)
    for a, b in _PAIRS.items():
        if text.count(a) > text.count(b):
            return True
    return text.count('"') % 2 == 1


def mask(text: str) -> list[str]:
    """Tokens with names as X (a run of them is one) and numbers as 0; CJK by character; a final stop as $."""
    out: list[str] = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        tok = {"num": "0", "name": "X", "stop": "$"}.get(kind) or (m.group().lower() if kind == "word" else m.group())
        if kind == "word" and m.group().isascii() is False and len(m.group()) > 12 and any("぀" <= c <= "ヿ" for c in m.group()):
            out.extend(m.group())
            continue
        if tok == "X" and out and out[-1] == "X":
            continue
        out.append(tok)
    return out


def defects(prompt: str | None, answer: str | None) -> tuple[list[str], list[str] | None, Said | None]:
    """The defects that the pair itself shows, and the tail and the language to look up where only the corpus can tell."""
    if answer is None or not any(c.isalnum() for c in bare(answer)):
        return ["empty"], None, None
    prompt, found, tail = prompt or "", [], None
    if copies(prompt, answer):
        found.append("copies_question")
    text = bare(answer)
    if _REFUSAL.search(text) and not (NOT_THERE.search(text) and not re.search(r"\bmy (?:rules|instructions|guidelines)|language model|assistant", text, re.I)):
        found.append("refusal")
    plain = text.rstrip(_CLOSERS)
    if unclosed(answer) or _CLIPPED.search(text.rstrip()) or _DANGLING.search(text.rstrip()):
        found.append("truncated")
    elif plain and plain[-1] not in _STOP:
        toks = mask(plain)
        if len(toks) >= 4 or (len(toks) == 3 and toks[-1] not in ("X", "0")):
            tail = toks[-3:]
    foreign, said = other_language(prompt, text)
    if foreign:
        found.append("other_language")
    return found, tail, said


def contexts(text: str) -> list[tuple[str, bool]]:
    """Each context of one to three masked tokens with whether the sentence ends there; unstopped ends say nothing."""
    toks, out = mask(bare(text)), []
    for i in range(1, len(toks)):
        if toks[i - 1] == "$":
            continue
        for k in (1, 2, 3):
            part = toks[max(0, i - k) : i]
            if len(part) == k and "$" not in part:
                out.append((" ".join(part), toks[i] == "$"))
    return out


_SCHEMA = "id string, at timestamp, shown array<string>, tail3 string, tail2 string, tail1 string, asked string, lang string, foreign boolean, alone boolean, c string, go long, end long"
#: Contexts that a task counts before it hands their counts on; results do not depend on it.
MOST_CONTEXTS = 200_000
#: Parts into which the answers of each tail are dealt where verdicts are looked up.
SALTS = 16


def _counted(seen: dict[str, list[int]]) -> pd.DataFrame:
    rest = {k: None for k in ("id", "at", "shown", "tail3", "tail2", "tail1", "asked", "lang", "foreign", "alone")}
    return pd.DataFrame(rest | {"c": list(seen), "go": [v[0] for v in seen.values()], "end": [v[1] for v in seen.values()]})


def _foreign_to_the_rest(judged: DataFrame) -> DataFrame:
    """judged, with ``other_language`` where most other answers to the same list of fields are in one other language.

    A prompt's answers are counted by language first, so that the counts joined are one row a prompt; the answers of a
    prompt are dealt into parts.
    """
    here = F.col("foreign")
    votes = judged.filter("asked is not null").groupBy("asked", "lang").agg(F.count("*").alias("n"))
    votes = votes.groupBy("asked").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("votes"))  # one entry a language
    votes = votes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ask = judged.filter(here).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(votes, ["asked", "salt"])
    same = F.col("votes")[F.col("lang")] - 1
    others = F.coalesce(F.array_max(F.map_values(F.map_filter("votes", lambda k, n: k != F.col("lang")))), F.lit(0))
    foreign = F.when((same == 0) & (others == 0), F.col("alone")).otherwise(others > same)
    ask = ask.withColumn("shown", F.when(foreign, F.array_append("shown", F.lit("other_language"))).otherwise(F.col("shown")))
    tail = ["id", "shown", "tail3", "tail2", "tail1"]
    return judged.filter(~F.coalesce(here, F.lit(False))).select(*tail).unionAll(ask.select(*tail))


def defective_pairs(rows: DataFrame, id_col: str, prompt_col: str, answer_col: str, status_col: str | None = None, running: str = "running", order_col: str | None = None, abrupt_below: float = 0.06) -> DataFrame:
    """(id, defects array in the order of DEFECTS) of every defective pair; each id once, as its latest delivery.

    Pairs whose status is ``running`` are unfinished and never defective; with a null status they are judged. Rows with
    a null id are left out. A null answer is empty; a null prompt can neither be copied nor set a language. Texts are
    read whole. Ties of ``order_col`` are broken by the defects found, so exact repeats do no harm. An empty table gives
    an empty result; extra columns are ignored.

    abrupt_below: an answer without a final stop breaks off if of the sentences with its last words (the longest
    context seen, up to three) a smaller share ends there, or if its last word is never used elsewhere and longer words
    begin with it.
    """
    at = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    src = rows.filter(F.col(id_col).isNotNull())
    if status_col:
        src = src.filter(F.coalesce(F.col(status_col), F.lit("")) != running)
    src = src.select(F.col(id_col).cast("string").alias("id"), at.alias("at"), F.col(prompt_col).alias("p"), F.col(answer_col).alias("a"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            got = [defects(p, a) for p, a in zip(b["p"], b["a"])]
            tails, said = [(t or [None]) for _, t, _ in got], [s for _, _, s in got]
            yield pd.DataFrame({
                "id": b["id"], "at": b["at"], "shown": [f for f, _, _ in got],
                "tail3": [" ".join(t) if len(t) == 3 else None for t in tails],
                "tail2": [" ".join(t[-2:]) if t[0] is not None else None for t in tails],
                "tail1": [t[-1] for t in tails],
                "asked": [s and s.prompt for s in said], "lang": [s and s.lang for s in said], "foreign": [s and s.foreign for s in said], "alone": [s and s.alone for s in said],
                "c": None, "go": None, "end": None,
            })
            for a in b["a"].dropna():
                for c, end in contexts(a):
                    seen.setdefault(c, [0, 0])[end] += 1
            if len(seen) >= MOST_CONTEXTS:
                yield _counted(seen)
                seen = {}
        if seen:
            yield _counted(seen)

    read_once = written(src.mapInPandas(read, _SCHEMA), "answers")
    held = ["shown", "tail3", "tail2", "tail1", "asked", "lang", "foreign", "alone"]
    judged = read_once.filter("c is null").groupBy("id").agg(F.max_by(F.struct(*held), F.struct("at", *held)).alias("x")).select("id", "x.*")
    judged = written(_foreign_to_the_rest(judged), "judged")
    stats = read_once.filter("c is not null").groupBy("c").agg(F.sum("go").alias("go"), F.sum("end").alias("end"))
    # Only contexts that some tail needs stay; each is one row, so the joins below meet no hot key on that side.
    open_ = judged.filter(F.col("tail1").isNotNull())
    tails = open_.groupBy("tail3", "tail2", "tail1").agg(F.count("*").alias("n"))
    need = tails.select(F.explode(F.array("tail3", "tail2", "tail1")).alias("c")).filter("c is not null").distinct()
    known = stats.join(need, "c", "left_semi")
    # A broken word: with the token before it it is seen nowhere, but longer words that begin with it are.
    pair = F.split("c", " ")
    longer = stats.filter((F.size(pair) == 2) & (F.col("go") + F.col("end") >= 5)).select(pair[0].alias("first"), pair[1].alias("word"))
    starts = longer.select(F.explode(F.expr("transform(sequence(1, greatest(1, length(word) - 1)), i -> concat(first, ' ', left(word, i)))")).alias("c"), (F.length("first") + 1 + F.length("word")).alias("len"))
    starts = starts.filter(F.length("c") < F.col("len")).select("c").distinct()
    broken = need.filter((F.size(pair) == 2) & pair[1].rlike(r"^[\p{Ll}]")).join(stats, "c", "left_anti").join(starts, "c", "left_semi").select(F.col("c").alias("tail2"), F.lit(True).alias("broken"))
    verdict = tails
    for k in (3, 2, 1):
        verdict = verdict.join(known.select(F.col("c").alias(f"tail{k}"), F.col("go").alias(f"g{k}"), F.col("end").alias(f"e{k}")), f"tail{k}", "left")
    verdict = verdict.join(broken, "tail2", "left")
    share = F.coalesce(*[F.when(F.col(f"g{k}") + F.col(f"e{k}") >= n, F.col(f"e{k}") / (F.col(f"g{k}") + F.col(f"e{k}"))) for k, n in ((3, 3), (2, 3), (1, 3))])
    verdict = verdict.select("tail3", "tail2", "tail1", (F.coalesce("broken", F.lit(False)) | (F.coalesce(share, F.lit(1.0)) < abrupt_below)).alias("abrupt")).filter("abrupt")
    # Most answers have nothing to look up; they stay out of the join, where they would all share one key.
    # A tail that a third of all answers has is dealt into parts; only tails that break off are in the verdict.
    verdict = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    same = [salted["salt"] == verdict["salt"], *[salted[f"tail{k}"].eqNullSafe(verdict[f"tail{k}"]) for k in (3, 2, 1)]]
    looked = salted.join(verdict, same, "left").select("id", F.when(F.col("abrupt"), F.array_union("shown", F.array(F.lit("truncated")))).otherwise(F.col("shown")).alias("shown"))
    out = looked.unionAll(judged.filter(F.col("tail1").isNull()).select("id", "shown"))
    ordered = F.filter(F.array(*[F.lit(d) for d in DEFECTS]), lambda d: F.array_contains(F.col("shown"), d))
    return out.filter(F.size("shown") > 0).select(F.col("id").alias(id_col), ordered.alias("defects"))
