"""Problem 1: responses that are no usable answer to their prompt.

Method: ordered rules for emptiness, copied prefixes, multilingual refusal phrases, script and language mismatch, unclosed
delimiters and abrupt endings. Every rule is applied to every response and all defects that it shows are given; the first
in that order is the response's main defect.

A language is told by script and frequent words, and where these tell nothing by profiles of characters that are fitted to
the table's prompts (see ``languages``). An abrupt ending is one after which the responses of the table go on rather than end (see ``endings``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.words import plain, words
from quillmark.llm import endings, languages
from quillmark.llm.truncation import digest, verdict
from quillmark.session import spread

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Log-odds of an end below which an ending is abrupt.
ABRUPT = -1.5

# What stands for a missing answer, once brackets, quotes and marks are off.
PLACEHOLDERS = frozenset(
    "n a|na|none|null|nil|nan|tbd|tba|todo|blank|empty|no response|no answer|no reply|not available|not applicable|missing|placeholder|undefined|pending|response|answer"
    "|keine antwort|leer|ohne antwort|sin respuesta|vacío|vacio|ninguna respuesta|aucune réponse|pas de réponse|vide|sans réponse|无|暂无|空|无回答|没有回答|无答案|待定".split("|")
)
# What may stand before a copied question.
_LABELS = frozenset("question prompt query you asked user human assistant instruction task q frage ihre pregunta usted preguntó vous avez demandé votre 问题 你问 用户 the your was is".split())

_CJK = re.compile(r"[㐀-䶿一-鿿]")
_LETTERS = re.compile(r"[^\W\d_]")

# Refusals: what is declined is answering, helping or talking.
_ACT = r"(?:answer|help|assist|respond|reply|comply|fulfil|do (?:that|this|it|so)|discuss|comment|talk about|write about|provide|engage|continue|share|support|address|complete|speak about|say anything)"
_REFUSALS = [
    rf"\b(?:i|we)(?: am|'m| are|'re)? (?:can(?:no|')t|can not|could(?:n't| not)|won't|will not|would(?:n't| not)|unable to|not able to|not (?:allowed|permitted|comfortable|in a position|going)(?: to| with)?) (?:be able to |be |really |in good conscience )?{_ACT}",
    r"\b(?:i|we) (?:won't|will not|can't|cannot) be (?:answering|helping|discussing|commenting|able to (?:help|answer|assist|do))",
    rf"\bunable to {_ACT}",
    r"\bwon't be able to (?:do|help|answer|assist|respond)",
    r"\b(?:must|have to|need to|am going to|'ll have to|would like to|choose to|prefer to) (?:decline|refuse|pass on|abstain)\b",
    r"\bi (?:respectfully |politely )?(?:decline|refuse) (?:to|this|that|your)",
    r"\b(?:against|violates?|outside) (?:my|our|the) (?:guidelines|policy|policies|principles|rules)",
    r"\b(?:policy|policies|guidelines|rules|programming) (?:do(?:es)?(?: not|n't) (?:let|allow|permit)|prevents?|forbids?|prohibits?)",
    rf"\b(?:would|'d) (?:rather|prefer) not (?:to )?{_ACT}?",
    r"\bnot something (?:that )?i (?:can|could|am able to|'m able to|will|want to|wish to)",
    r"\bno (?:answer|response|reply|help) (?:can|will|could) be (?:given|provided|offered)",
    rf"\bnot be (?:right|appropriate|proper|wise) for me to {_ACT}",
    r"\b(?:don't|do not) feel (?:comfortable|able|right)",
    r"\boutside (?:of )?(?:what i can|my (?:scope|abilities|remit|capabilities))",
    r"\bbeyond (?:what i can|my (?:scope|abilities|remit|capabilities))",
    r"\bi'?ll (?:leave it|stop) (?:there|here)",
    # German
    r"\b(?:kann|darf|möchte|will|werde) (?:ich|wir)[^.!?]{0,40}\b(?:nicht|keine)[^.!?]{0,40}(?:beantworten|helfen|antworten|eingehen|äußern|auskunft|sagen|geben|weiterhelfen|unterstützen|erfüllen)",
    r"\bich (?:kann|darf|möchte|will|werde)[^.!?]{0,40}\b(?:nicht|keine)[^.!?]{0,40}(?:beantworten|helfen|antworten|eingehen|äußern|auskunft|sagen|geben|weiterhelfen|unterstützen|erfüllen)",
    r"\bmuss (?:ich )?[^.!?]{0,40}(?:ablehnen|verweigern|passen)\b",
    r"\b(?:nicht möglich|außerhalb meiner|gegen meine (?:richtlinien|regeln))\b",
    # Spanish
    r"\bno (?:puedo|podemos|podré|me es posible|es posible|voy a|debo|quiero|estoy en condiciones de|me está permitido)[^.!?]{0,30}(?:ayudar|responder|contestar|atender|hablar|comentar|opinar|hacer|dar|cumplir|asistir)",
    r"\b(?:debo|tengo que|prefiero|he de) (?:rechazar|declinar|negarme|no (?:contestar|responder|hablar|opinar|comentar|pronunciarme))",
    r"\b(?:va en contra de|contra) mis (?:normas|principios|reglas|políticas)",
    r"\bmis (?:normas|reglas|políticas|directrices) (?:no me|me impiden|prohíben)",
    # French
    r"\bne (?:peux|puis|pouvons|pourrai|suis|dois|souhaite|veux|vais) (?:malheureusement |vraiment )?(?:pas|guère)?[^.!?]{0,30}(?:aider|répondre|commenter|parler|prononcer|faire|donner|traiter|mesure|satisfaire|donner suite)",
    r"\b(?:dois|préfère|me vois contrainte?|suis obligée?) (?:de )?(?:refuser|décliner|ne pas|m'abstenir)",
    r"\b(?:n'est|m'est) pas possible de (?:répondre|vous aider|donner|traiter)",
    r"\bcontraire à mes (?:règles|principes)|\bmes (?:règles|consignes|principes) (?:ne me|m'interdisent|m'empêchent)",
    # Chinese
    r"(?:我|恕我|很遗憾|抱歉|对不起)[^。！？]{0,14}(?:无法|不能|不便|不可以|没法|没有办法)[^。！？]{0,14}(?:帮助|帮|回答|回复|提供|讨论|评论|协助|处理|完成|满足|答复|谈论)",
    r"恕我(?:拒绝|不能|无法|难以)|(?:我|必须|只能|不得不)(?:必须|只能|不得不|要)?(?:拒绝|谢绝|婉拒)|超出了?我的(?:范围|能力)|违反(?:了)?我的(?:准则|原则|规定)|不方便(?:回答|讨论|评论)|我不(?:想|愿意?|会)(?:回答|讨论|评论|谈论)",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in _REFUSALS))
# Sentences that may stand beside a refusal and answer nothing.
_FILLERS = [
    r"^(?:i'?m|i am|we are|we're)? ?(?:so |very |truly |really )?sorry\b[^.!?]{0,60}$|^i apologi[sz]e\b[^.!?]{0,60}$|^(?:no|unfortunately|regrettably|sorry|nope)\W*$",
    r"\bplease (?:ask|consult|contact|see|try|seek|speak|refer|check with|reach out|keep me|forgive|understand)\b",
    r"^(?:is there|do you have|would you like|can i help|may i help|how else|what else|anything else|let me know|feel free)\b",
    r"\bthank(?:s| you)\b",
    r"^(?:try|ask|consult|choose|pick) (?:an?other|a different|something|someone|a qualified|an expert)\b",
    r"^as an? (?:ai|language|large|assistant|virtual|chatbot|machine)\b",
    r"\bi (?:hope|trust) you(?:'ll| will| can)? understand|\bi understand (?:why|that) you",
    r"^(?:bitte|gibt es|kann ich sonst|vielen dank|danke|es tut mir leid|leider|tut mir leid)\b",
    r"^(?:por favor|¿?hay (?:algo|otra)|gracias|lo siento|lamentablemente|¿?puedo ayudar|disculpe|perdón)\b|\bgracias por\b",
    r"^(?:veuillez|merci|y a-t-il|puis-je|je suis désolée?|désolée?|malheureusement|avez-vous|s'il vous plaît)\b",
    r"^(?:请|谢谢|感谢|抱歉|对不起|很遗憾|还有(?:什么|其他)|如果(?:您|你))",
]
_FILLER = re.compile("|".join(f"(?:{p})" for p in _FILLERS))
# Prompts that ask for such a message.
_ASKS_REFUSAL = re.compile(
    r"\b(?:declin\w+|refus\w+|turn(?:s|ing)? down|reject(?:s|ing|ion)?|says? no|ablehn\w*|absag\w*|abzulehnen|abzusagen|rechaz\w*|declin\w*|negativa|refus\w*|déclin\w*)\b|拒绝|婉拒|谢绝|推辞"
)
_MESSAGE = re.compile(r"\b(?:message|letter|note|e-?mail|reply|response|text|sentence|draft|write|nachricht|brief|antwort|schreib\w*|mensaje|carta|correo|redact\w*|escrib\w*|lettre|courriel|rédig\w*|écri\w*)\b|消息|信|邮件|写|回复")

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)

# Names of the languages in requests.
_NAMES = {
    "en": r"english|englisch\w*|inglés|anglais\w*|英文|英语",
    "de": r"german|deutsch\w*|alemán|allemand\w*|德文|德语",
    "fr": r"french|französisch\w*|francés|français\w*|法文|法语",
    "es": r"spanish|spanisch\w*|español\w*|espagnol\w*|castellano|西班牙文|西班牙语",
    "zh": r"chinese|mandarin|chinesisch\w*|chino|chinois\w*|中文|汉语|普通话",
    "ja": r"japanese|japanisch|japonés|japonais|日文|日语",
}
_ASKED = {k: re.compile(rf"\b(?:in|into|to|auf|ins|en|al|a|au|de|von|from|sur)\s+(?:das |el |le |la |the )?(?:{v})\b|(?:用|成|为|到)(?:{v})") for k, v in _NAMES.items()}
_NOT_ASKED = {k: re.compile(rf"\b(?:from|aus dem|aus|del|du|de l')\s*(?:{v})\b|从(?:{v})") for k, v in _NAMES.items()}


@lru_cache(maxsize=256)
def last_turn(prompt: str) -> str:
    """What the user said last in a prompt of flattened turns."""
    turns = re.split(r"(?:^|\n)[^\S\n]*(?:user|human)[^\S\n]*:\s*", prompt)
    tail = turns[-1] if len(turns) > 1 else prompt
    return re.split(r"\n[^\S\n]*(?:assistant|model|bot)[^\S\n]*:", tail)[0] if len(turns) > 1 else tail


def _tokens(text: str) -> list[str]:
    """Words, with runs of Chinese characters taken apart."""
    if not _CJK.search(text):
        return words(text)
    return [t for w in words(text) for t in (re.findall(r"[㐀-䶿一-鿿]|[^㐀-䶿一-鿿]+", w) if _CJK.search(w) else [w])]


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    w = words(response)
    if not w:
        # Marks, blanks and fences alone; a pictograph is an answer of a kind.
        return not any(ord(c) >= 0x2190 and c.isprintable() and not c.isspace() and not _LETTERS.match(c) and ord(c) not in range(0x2E80, 0x3040) for c in response if ord(c) not in (0xFEFF, 0x3000, 0xFFFD))
    return len(w) <= 3 and " ".join(w) in PLACEHOLDERS


@lru_cache(maxsize=256)
def _asked(prompt: str) -> tuple[frozenset[str], ...]:
    """The words of a prompt's last turn and of all of it."""
    turn = last_turn(prompt)
    return (frozenset(_tokens(turn)), frozenset(_tokens(prompt))) if turn != prompt else (frozenset(_tokens(prompt)),)


@lru_cache(maxsize=256)
def _asks_refusal(prompt: str) -> bool:
    asked = plain(last_turn(prompt))
    return bool(_ASKS_REFUSAL.search(asked) and _MESSAGE.search(asked))


def is_copy(prompt: str | None, response: str) -> bool:
    """Whether the response holds nothing but the prompt or its last user turn, perhaps labelled, restyled or repeated."""
    if not prompt:
        return False
    said = _tokens(response)
    body = [w for w in said if w not in _LABELS] or said
    if len(body) < 3:
        return False
    held = set(body)
    for question in _asked(prompt):
        strange = sum(1 for w in body if w not in question)
        if strange <= max(1, 0.08 * len(body)) and len(held & question) >= 0.75 * len(question - _LABELS):
            return True
    return False


def is_refusal(prompt: str | None, response: str) -> bool:
    """Whether the response declines and answers nothing; false if the prompt asks for a message that declines."""
    if prompt and _asks_refusal(prompt):
        return False
    declined = False
    for s in _SENTENCE.split(plain(response).replace("’", "'")):
        s = s.strip(" \t\"'*_>-#")
        if not s:
            continue
        if _REFUSAL.search(s):
            declined = True
        elif words(s) and not _FILLER.search(s):
            return False
    return declined


@lru_cache(maxsize=256)
def _expected(prompt: str) -> tuple[str | None, frozenset[str]]:
    """The language of a prompt, and those it asks for."""
    turn = last_turn(prompt)
    asked_in = plain(turn)
    wanted = frozenset(k for k, p in _ASKED.items() if p.search(asked_in) and not _NOT_ASKED[k].search(asked_in))
    return languages.language(turn) or languages.language(prompt), wanted


def wrong_language(prompt: str | None, response: str, profiles: dict | None = None) -> bool:
    """Whether the response is mostly in a language that is neither asked for nor, if none is, the prompt's own.

    With ``profiles`` (see ``languages.fitted``) that may be a language that nothing is known of.
    """
    if not prompt:
        return False
    own, wanted = _expected(prompt)
    if own is None:
        return False
    low, found = languages._words(response)
    got = languages._told(low, found)
    if got is not None and got != own:
        return got not in wanted
    return bool(profiles) and not wanted and languages.foreign(found, own, profiles)


_RULED = "record_idx long, side string, found array<string>, class binary, keys array<long>, within array<long>"


def _rules(profiles: dict, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each response shows by itself, and the contexts of its end if that says nothing."""
    for b in batches:
        out, cores = [], []
        for i, side, prompt, response in zip(b["record_idx"], b["side"], b["prompt_text"], b["response"], strict=True):
            found, end = [], "whole"
            if is_empty(response):
                found.append("empty")
            else:
                if is_copy(prompt, response):
                    found.append("copy")
                if is_refusal(prompt, response):
                    found.append("refusal")
                if wrong_language(prompt, response, profiles):
                    found.append("language")
                end, core = verdict(response)
                if end == "cut":
                    found.append("truncated")
                elif end == "open":
                    cores.append(core)
            out.append([i, side, found, digest(core) if end == "open" else None, None, None])
        finals = iter(endings.final_keys(cores))
        for row in out:
            if row[3] is not None:
                row[4], row[5] = next(finals)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RULED.split(", ")])


def defects(df: DataFrame, abrupt: float = ABRUPT) -> DataFrame:
    """One row (record_idx, side, defects ARRAY<STRING>) for each response with a defect, the defects in the order of DEFECTS.

    ``df`` has record_idx BIGINT, prompt_text, chosen_response and rejected_response; other columns are ignored. Null
    responses are empty. Without a prompt no response is a copy or in a wrong language. Repeated rows give repeated rows, and rows with a null record_idx none.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_response").alias("response")) for s in ("chosen", "rejected")))).alias("s")
    each = df.where("record_idx is not null").select(F.col("record_idx").cast("long").alias("record_idx"), "prompt_text", sides).select("record_idx", "prompt_text", "s.*")
    each = spread(each)
    profiles = languages.fitted(spread(df.select(F.col("prompt_text").alias("text"))))
    ruled = each.mapInPandas(partial(_rules, profiles), _RULED).persist(StorageLevel.MEMORY_AND_DISK)
    odds = endings.log_odds(each.select(F.col("response").alias("text")), ruled.where("class is not null").select("class", "keys", "within"))
    rows = ruled.select("record_idx", "side", "found", "class").join(odds, "class", "left")
    cut = F.col("class").isNotNull() & (F.coalesce("log_odds", F.lit(0.0)) < F.lit(float(abrupt)))
    return rows.select("record_idx", "side", F.when(cut, F.array_append("found", F.lit("truncated"))).otherwise(F.col("found")).alias("defects")).where(F.size("defects") > 0)


def found(df: DataFrame) -> DataFrame:
    """(record_idx, side, defect): the main defect of each defective response."""
    return defects(df).select("record_idx", "side", F.col("defects")[0].alias("defect"))


def listed(df: DataFrame) -> DataFrame:
    """(record_idx, side, defects): all defects of each defective response, by commas, in the order of DEFECTS."""
    return defects(df).withColumn("defects", F.array_join("defects", ","))


def counts(df: DataFrame) -> DataFrame:
    """(side, defect, n) over all defects that responses show."""
    return defects(df).select("side", F.explode("defects").alias("defect")).groupBy("side", "defect").agg(F.count("*").alias("n"))
