"""Problem 3: prompt and response pairs whose response is no proper answer.

A pair gets at most one defect, tried in this order: ``empty``, ``copied``, ``refusal``, ``other_language``,
``truncated``. The rules read whole texts, row by row, in Arrow batches, without a shuffle, but for one question: whether
a response that stops without an end mark is finished. That hangs on how the texts of the table use its last word
(:func:`endings`): a word that they go on after is no end, and a word they never have, but have the beginning of many
others by, is a part of one. Counts of all words of all responses are aggregated and joined with those few responses.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .words import mixed

INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»“)\]]*\s+|\s*;\s+|\n+")
WORD = re.compile(r"[^\W_]+")

# What stands for a missing answer.
PLACEHOLDERS = {
    "n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "tbc", "todo", "to do", "fixme", "blank", "empty", "no answer", "no response", "no reply", "no output", "no data", "no value", "missing",
    "undefined", "placeholder", "not available", "not applicable", "unknown", "unanswered", "pending", "response", "answer", "your answer here", "insert answer here", "answer here", "response here", "text here", "to be done", "to be added", "to be determined", "to be filled in", "xxx", "xx", "x", "lorem ipsum",
    "keine antwort", "leer", "fehlt", "k a", "folgt", "sin respuesta", "vacio", "ninguno", "ninguna", "pendiente", "sans reponse", "pas de reponse", "aucune reponse", "vide", "neant", "a completer", "nichts", "nada", "rien", "void", "eof", "end", "error", "false", "no content", "content missing",
}

# Words that placeholders are made of, and those of them that tell one.
SLOT = set(
    "your my the a an this that here text answer response reply output content value name title description insert enter type write put add fill in out goes comes go to be is was with for of please placeholder blank empty "
    "intentionally deliberately left page section field paragraph sample example dummy missing omitted removed redacted deleted pending todo tbd later added provided completed done needed".split()
)
SLOT_TELLS = set("here blank placeholder insert enter fill missing omitted removed redacted deleted pending todo tbd dummy".split())

# Frequent words that hardly occur in the other languages.
FUNCTION_WORDS = {
    "en": "the and of is are was were that this with for from not you it be which on in at as by than then when what why how has have had its their every each our only can would should if after before without there nobody most today please does do an or but we they one other",
    "de": "der die das und ist sind war waren dass mit für von nicht du es ein eine einer einem einen den dem des im am zu zum zur auf als wie wenn was warum hat haben nach vor ohne noch niemand heute wird wurde wurden sich auch so man nur oder aber bei über laut meistens sobald bevor deshalb besser",
    "fr": "le la les et est sont était que qui avec pour de du des pas vous il elle un une au aux en dans sur par plus quand quoi pourquoi comment a ont après avant sans encore personne on ne se ce cette ces ou mais selon dès aujourd hui même leur sa son être été reste faut",
    "es": "el la los las y es son era que con para de del no usted un una al en por más cuando qué cómo ha han después antes sin todavía nadie hoy se lo su sus o pero según cuanto hay también esta este entre sobre como solo está ser fue sigue siendo",
}
# The same of further languages, in which an answer is never due unless it is asked for.
FURTHER_WORDS = {
    "pt": "o os as e é são era foi que com para de do da dos das não uma um em no na nos nas por mais quando como tem têm depois antes sem ainda ninguém hoje se sua seu ou mas muito também já está este esta ao pelo pela isso você",
    "it": "il lo gli i le e è sono era che con per di del della dei delle non un uno una in nel nella al alla da dal dalla più quando come perché ha hanno dopo prima senza ancora nessuno oggi si suo sua o ma molto anche già questo questa ci sul",
    "nl": "de het een en is zijn was waren dat die met voor van niet je u ze er in op aan om te als hoe wat waarom heeft hebben naar na zonder nog niemand vandaag wordt werd worden zich ook zo maar of bij over meer wel dan door uit deze dit",
    "pl": "i w z na do jest są był była że nie się to co jak o od po za dla przez ale lub czy oraz gdy kiedy dlaczego ma mają bez jeszcze nikt dziś już bardzo także ten ta te tego jego jej ich tylko może przed pod",
    "sv": "och i att det som en ett på är av för med den till inte har de om var han hon men sig från vi så kan när nu vid också efter eller hade upp utan mycket sedan skulle detta mot bara",
    "da": "og i at det som en et på er af for med den til ikke har de om var han hun men sig fra vi så kan når nu ved også efter eller havde op uden meget siden skulle dette mod kun jeg hvad",
    "cs": "a v na je se že s z do to o k i jako za by ale po pro nebo jsou byl byla není od jeho jen když co tak až také už která který které při ve než podle",
    "ro": "și în de la cu pe nu este sunt că o un pentru din care mai se au a fost dar sau după când ce cum fără dacă această acest foarte prin până între lui",
    "hu": "a az és hogy nem is egy ez van volt meg de csak már mint ha vagy még azt ezt aki ami amely után előtt nélkül nagyon mert lehet kell",
    "fi": "ja on ei se että oli mutta kun myös hän ovat joka niin kuin tai jos vain sen ole hänen tämä jo mukaan sitä ne kaikki vielä nyt sekä",
    "tr": "ve bir bu da de için ile çok en ama daha gibi olarak var olan ne kadar sonra değil her ya önce mi diye ise o şu hiç yok",
}
FUNCTION_SETS = {language: set(words.split()) for language, words in FUNCTION_WORDS.items()}
FURTHER = {language: set(words.split()) for language, words in FURTHER_WORDS.items()}
LANGUAGE_OF: dict[str, dict[str, float]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        LANGUAGE_OF.setdefault(_word, {})[_language] = 1.0
for _word, _weights in LANGUAGE_OF.items():
    for _language in _weights:
        _weights[_language] = 1.0 / len(_weights)

# Words that no finished sentence ends with.
DANGLING = set(
    "the a an of and or but nor to in on at by for from with without than that which who whose when while because if as is are was were has have had its their our your my every each between under into onto about over not no per so then where how why what this these those be been being also only just more most very "
    "der die das den dem des ein eine einer einem einen und oder aber von vom zu zum zur im am auf für mit ohne bei nach vor als wie dass weil wenn ob sich nicht noch sehr ist sind war wird wurde wurden hat haben "
    "le la les un une des du de au aux et ou mais que qui dont où pour par avec sans sur dans en entre est sont a ont ne se ce cette ces son sa ses leur plus très qu l d s n j c "
    "el los las uno una unos unas y o pero que del al por para con sin sobre entre es son fue ha han no se su sus lo muy más".split()
)

ASKS_FOR_COPY = re.compile(
    r"(?i)\b(repeat|copy|copies|recite|quote|cite|transcribe|reproduce|echo|verbatim|word for word|say (?:this|that|it) (?:once more|again)|write (?:this|that|it) (?:again|down)|once more|choose|pick|select|extract|proofread|correct (?:the|this)|complete|continue"
    r"|wiederhol\w*|zitier\w*|kopier\w*|abschreib\w*|wörtlich|noch einmal|wähl\w*|répèt\w*|répét\w*|recopi\w*|copi(?:e|er|ez)|cit(?:e|er|ez)|encore une fois|mot à mot|chois\w*|repit\w*|repet(?:ir|id)|copi(?:a|ar|e)|cit(?:a|ar)|otra vez|una vez más|literalmente|elig\w*|escog\w*)\b"
)
OPTIONS = re.compile(r"(?im)^\s*(?:options|optionen|opciones|choices|auswahl|choix)\s*:")
ASKS_FOR_LANGUAGE = re.compile(
    r"(?i)\b(?:translate|translated|translation (?:into|of (?:this|the following))|übersetze|übersetzen|übersetzt|übersetzung (?:ins|von)|traduis|traduire|traduisez|traduce|traducir|traduzca|traducid)\b"
    r"|\b(?:in|into|to|ins?|auf|aus dem|en|au|al|from)\s+(?:the\s+)?(?:english|german|french|spanish|italian|portuguese|dutch|russian|latin|deutsch\w*|englisch\w*|französisch\w*|spanisch\w*|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b"
)
SHORT_ANSWER = re.compile(
    r"(?i)(\byes or no\b|\bnumber only\b|\bonly the (?:number|name|word)\b|\bone word\b|\banswer with\b|^\s*(?:name|which|who|when|where|how many|how much|is|are|was|were|does|do|did|can|could|will|has|have)\b|\bwhat does .{1,80} (?:print|return|output|show)\b|\bja oder nein\b|\boui ou non\b|\bsí o no\b|nur die zahl|mit einem wort|en un mot|en una palabra)"
)
ALLOWS_NONE = re.compile(r"(?i)\b(?:answer|reply|respond|write|say|return|antworte|réponds|responde)\b[^.?!]{0,40}\b(none|null|n/?a|nothing|unknown|nichts|keine?r?|rien|aucune?|nada|ningun[oa]|empty|blank)\b")

ABLE = r"(?:willing|able|allowed|permitted|prepared|authori[sz]ed|comfortable|in a position|equipped|supposed|going|free|meant|designed)"
HELP = r"(?:help(?:ing)?|assist(?:ing)?|answer(?:s|ing)?|respond(?:ing)?|reply(?:ing)?|comment(?:ing)?|discuss(?:ing)?|provid(?:e|ing)|explain(?:ing)?|cover|talk|share|write|speak|comply|fulfil|do (?:that|this|so)|say|advise|advice|offer|support|engage|continue|get into|go into|go there|opinions?|address|touch|disclose|reveal|give (?:you |out |any |an? |the |that |this |my )*(?:answers?|advice|opinions?|information|details|response|guidance|help))"
REFUSAL = [
    re.compile(p)
    for p in (
        rf"\b(?:i|we)(?:'m|'re| am| are|'d| would| must| have to| need to|'ll| will)?\b[^.:;!?]{{0,40}}\b(?:cannot|can ?not|can't|cant|could not|couldn't|won't|will not|unable to|not able to|not allowed to|not permitted to|not authori[sz]ed to|rather not|prefer not to|refuse to|decline to|not going to)\b[^.:;!?]{{0,40}}\b{HELP}\b",
        r"\bi\b[^.:;!?]{0,30}\b(?:decline|refuse|respectfully pass|pass on this|have to pass|must pass)\b",
        rf"\b(?:not|n't|never)\b(?: \w+){{0,4}} (?:that |which )?(?:i|we)(?:'m| am|'re| are) {ABLE}\b|\b(?:i'm|i am|we're|we are) (?:simply |just |afraid |sorry )*not (?:really |currently )?{ABLE}\b[^.:;!?]{{0,40}}\b{HELP}\b",
        rf"\b(?:this|the|your|our) (?:assistant|model|system|bot|chatbot|service|tool|ai|team)\b[^.:;!?]{{0,20}}\b(?:does not|doesn't|do not|don't|cannot|can't|can not|will not|won't|is not|isn't|is unable|declines|refuses)\b[^.:;!?]{{0,40}}\b{HELP}\b",
        r"\bi\b.{0,12}\b(?:don't|do not)\b.{0,12}\b(?:feel comfortable|have enough information|have the information|have access)\b",
        r"\b(?:not|n't) (?:be )?(?:appropriate|possible|right) for me\b|\bnot a (?:topic|subject|question|matter) (?:that )?i can\b|\bnot something (?:that )?i can\b",
        r"\bsomething (?:that )?i (?:have|need|must|am obliged)\b.{0,8}\b(?:decline|refuse)\b|\bno can do\b",
        r"\b(?:falls?|is|lies) (?:outside|beyond)(?: of)? (?:what|the scope|my)\b",
        r"\b(?:against|violates?|contrary to) (?:my|our) (?:instructions|guidelines|polic(?:y|ies)|rules|principles)\b",
        r"\b(?:guidelines|polic(?:y|ies)|instructions|rules|programming)\b.{0,20}\b(?:prevent|forbid|prohibit|do not allow|don't allow|do not permit|don't permit|stop) (?:me|us)\b",
        r"\bas an? (?:ai|assistant|language model|artificial)\b[^.;!?]{0,60}\b(?:not|n't|cannot|unable)\b",
        r"\b(?:this|that|your) (?:request|question)\b.{0,30}\b(?:cannot|can't|can not|not) be (?:answered|fulfilled|processed|discussed)\b|\bi cant answer\b|\bno comment\b",
        r"\b(?:kann|darf|möchte|will|muss|werde|könnte) ich\b.{0,60}\b(?:nicht|keine?n?|ablehnen|verweigern|leider)\b|\bich (?:kann|darf|möchte|will|werde)\b.{0,60}\b(?:nicht|keine?n?|lieber nicht)\b.{0,40}\b(?:helfen|beantworten|antworten|sagen|geben|äußern|sprechen|schreiben|eingehen|erklären|auskunft)|\b(?:muss|möchte) ich\b.{0,40}\bablehnen\b|\bmir (?:ist es )?nicht (?:erlaubt|gestattet|möglich)\b|\bes ist mir nicht (?:erlaubt|gestattet|möglich)\b|\bist es mir nicht (?:erlaubt|gestattet|möglich)\b|\bich\b.{0,30}\b(?:ablehnen|verweigere|lehne)\b",
        r"\bje (?:ne )?(?:peux|suis|dois|préfère|préférerais|regrette|refuse|souhaite|voudrais)\b.{0,60}\b(?:pas|refuser|décliner|refuse)\b.{0,60}|\bje préfère ne pas\b|\bje dois (?:refuser|décliner)\b|\bil ne m'est pas (?:permis|possible)\b|\bje ne (?:peux|suis) pas\b",
        r"\bno (?:puedo|podría|estoy (?:autorizad|en condiciones|capacitad)|me está permitido|me es posible|me permiten)\b|\bprefiero no\b|\bpreferiría no\b|\b(?:debo|tengo que|me veo obligad[oa] a) (?:rechazar|declinar|negarme)\b",
        r"\bnon (?:posso|potrei|sono (?:in grado|autorizzat[oa])|mi è (?:permesso|consentito|possibile))\b[^.;!?]{0,40}\b(?:aiutar\w*|risponder\w*|rispondere|fornir\w*|dar\w*|parlar\w*|dire|discuter\w*|commentar\w*|farlo)\b|\bpreferisco non\b|\b(?:devo|sono costrett[oa] a) (?:rifiutare|declinare)\b|\bmi rifiuto\b",
        r"\bnão (?:posso|poderia|consigo|estou (?:autorizad[oa]|em condições)|me é permitido)\b[^.;!?]{0,40}\b(?:ajudar|responder|fornecer|dar|falar|dizer|discutir|comentar)\b|\bprefiro não\b|\b(?:devo|tenho de|tenho que) (?:recusar|declinar)\b|\brecuso-me\b",
        r"\b(?:ik (?:kan|mag|wil|zal)|(?:kan|mag|wil|zal) ik)\b[^.;!?]{0,40}\b(?:niet|geen|liever niet)\b[^.;!?]{0,40}\b(?:helpen|antwoord\w*|beantwoorden|geven|zeggen|bespreken|ingaan)\b|\bik (?:weiger|moet weigeren)\b",
        r"\bnie (?:mogę|jestem w stanie|wolno mi)\b[^.;!?]{0,40}\b(?:pomóc|odpowiedzieć|udzielić|powiedzieć|rozmawiać|komentować)\b|\bodmawiam\b|\bwolę nie\b",
    )
]
# A sentence without any of these parts declines nothing.
DECLINES = ("not", "n't", "cant", "no can", "no comment", "no pued", "no podr", "no est", "no me", "declin", "refus", "pass", "never", "outside", "beyond", "against", "violat", "contrary", "prevent", "forbid", "prohibit", "stop", "unable",
    "nicht", "kein", "ablehn", "verweiger", "leider", "lehne", "pas", "déclin", "préfèr", "prefier", "prefer", "rechaz", "negarme", "non ", "rifiut", "não", "recus", "prefir", "niet", "geen", "weiger", "nie ", "odmawiam", "wolę")


def may_decline(text: str) -> bool:
    return any(part in text for part in DECLINES)


FILLER = re.compile(
    r"\b(?:sorry|apolog(?:y|ies|ize|ise)|thank(?:s| you)|hello|hi|hmm+|interesting question|good question|great question|unfortunately|let's talk|talk about something else|another topic|something else|please consult|please ask|please contact|someone who knows|professional|expert|anything else|happy to help|sure,? gladly|of course|certainly|hope you understand|understand"
    r"|tut mir leid|leider|danke|hallo|bitte wenden|etwas anderes|gute frage|verständnis|désolé\w*|malheureusement|merci|bonjour|autre chose|autre sujet|consult\w*|compréhension|lo siento|lamento|lamentablemente|gracias|hola|otra cosa|otro tema|por desgracia|desafortunadamente|buena pregunta|bonne question|temo|crains|perdón|disculp\w*|gerne|con gusto|claro|bien sûr|volontiers)\b"
)

QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|```.*?(?:```|\Z)|`[^`\n]*`", re.S)
LABEL = re.compile(r"(?i)^\s*(?:user|human|question|q|instruction|input|frage|pregunta|mensch|usuario|utilisateur)\s*:\s*")
TURN = re.compile(r"(?im)^\s*(?:assistant|answer|response|a|antwort|respuesta|réponse|bot|ai)\s*:\s*")
CONTEXT = re.compile(r"(?s)\s+(?:Context|Kontext|Contexte|Contexto)\s*:.*")


def plain(text: str) -> str:
    """Without entities, tags and invisible characters."""
    for _ in range(2):
        text = html.unescape(text) if "&" in text else text
    if "<" in text:
        text = TAG.sub(" ", text)
    return text if text.isascii() else INVISIBLE.sub("", text)


ANY_QUOTE = re.compile("[\"“„«`]")


def unquoted(text: str) -> str:
    """Without quotations and code."""
    return QUOTED.sub(" ", text) if ANY_QUOTE.search(text) else text


def without_context(text: str) -> str:
    """Without the context given after the question; all its names have these letters."""
    return CONTEXT.sub("", text) if "onte" in text else text


COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f\u2000-\u206f]")


def folded(text: str) -> list[str]:
    """Words without case and accents."""
    if not text.isascii():
        text = COMBINING.sub("", unicodedata.normalize("NFKD", text))
    return WORD.findall(text.casefold())


def instruction_of(prompt: str) -> str:
    """The prompt without the formatter's frame around it."""
    text = prompt
    if "### Instruction:" in text:
        text = text.split("### Instruction:", 1)[1]
    text = text.split("### Response:", 1)[0]
    text = LABEL.sub("", text.strip())
    parts = TURN.split(text)
    if len(parts) > 1 and not parts[-1].strip():
        text = text[: text.rindex(TURN.findall(text)[-1])] if TURN.findall(text) else text
    text = text.strip()
    return text[:-1] if text.endswith((".:", "?:", '":', "!:", "'':", "”:", "»:")) else text


def is_empty(response: str | None, prompt: str) -> bool:
    if response is None:
        return True
    text = plain(response)
    words = folded(text)
    if not words:
        if "<" in response and re.search(r"<\s*[a-z]+\s*>", response.strip(), re.I) and not text.strip():
            return True
        return not re.search(r"\w", text)
    if len(words) > 1 and SLOT.issuperset(words) and not SLOT_TELLS.isdisjoint(words):
        return True
    said = " ".join(words)
    if said in PLACEHOLDERS:
        allowed = ALLOWS_NONE.search(prompt)
        return not (allowed and said in {"none", "null", "n a", "na", "nothing", "unknown", "nichts", "nada", "rien", "ninguno", "ninguna", "empty", "blank"}) and not (said in {"false", "error", "end", "x", "void", "answer", "response", "nothing"} and SHORT_ANSWER.search(prompt))
    return False


def _window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of ``length`` codes, in a logarithmic number of steps."""
    out, have = codes, 1
    for bit in bin(length)[3:]:  # doubled, and one more where the bit is set
        out, have = mixed(out[: len(out) - have] ^ mixed(out[have:])), 2 * have
        if bit == "1":
            out, have = mixed(out[: len(out) - 1] ^ mixed(codes[have : have + len(out) - 1] + np.uint64(1))), have + 1
    return out


def tiles(left: list[str], right: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy string tiling: marks of the words in common runs of at least ``least`` words, longer runs first, each word once.

    Windows of halving length are looked up by hash, as in running Karp-Rabin matching, and each match is followed to its
    end; marked runs are no shorter than the window, so a window is free if its ends are. The number of steps grows with
    the words times the logarithm of their number, however often they repeat."""
    one, two = np.zeros(len(left), bool), np.zeros(len(right), bool)
    if len(left) < least or len(right) < least:
        return one, two
    numbers: dict[str, int] = {}
    a, b = (np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64) for words in (left, right))
    codes = mixed(a.astype(np.uint64)), mixed(b.astype(np.uint64))
    lengths = [least]
    while lengths[-1] * 2 <= min(len(a), len(b)):
        lengths.append(lengths[-1] * 2)
    for n in reversed(lengths):
        free = [np.flatnonzero(~(marks[: len(marks) - n + 1] | marks[n - 1 :])) for marks in (one, two)]
        if not len(free[0]) or not len(free[1]):
            continue
        h, g = _window_hashes(codes[0], n)[free[0]], _window_hashes(codes[1], n)[free[1]]
        order = np.argsort(g, kind="stable")
        g, places = g[order], free[1][order]
        at = np.searchsorted(g, h, "left")
        known = np.flatnonzero(g[np.minimum(at, len(g) - 1)] == h)
        if not len(known):
            continue
        ends = np.searchsorted(g, h[known], "right").tolist()
        taken: dict[int, int] = {}  # places of a hash that are used up
        done = -1
        for i, start, end in zip(free[0][known].tolist(), at[known].tolist(), ends):
            if i < done or one[i] or one[i + n - 1]:
                continue
            k = taken.get(start, start)
            while k < end and (two[places[k]] or two[places[k] + n - 1]):
                k += 1
            taken[start] = k
            if k == end:
                continue
            j = int(places[k])
            most = min(len(a) - i, len(b) - j)
            differ = np.flatnonzero((a[i : i + most] != b[j : j + most]) | one[i : i + most] | two[j : j + most])
            much = int(differ[0]) if len(differ) else most
            if much >= n:
                one[i : i + much] = two[j : j + much] = True
                done = i + much
    return one, two


def _may_cover(left: list[str], right: list[str], least: int, cover: float) -> bool:
    """Whether enough words of ``left`` stand in runs of ``least`` words that ``right`` has, too; tiles can't cover more."""
    held = set(zip(*(right[k:] for k in range(least))))
    until = covered = 0
    for i, run in enumerate(zip(*(left[k:] for k in range(least)))):
        if run in held:
            covered += i + least - max(i, until)
            until = i + least
    return covered >= cover * len(left)


def is_copied(response: str, instruction: str, least: int = 3, cover: float = 0.75) -> bool:
    """Tiles cover the response, and a whole sentence of the prompt; no sentence of the response is its own."""
    m = OPTIONS.search(instruction)
    body = instruction[: m.start()] if m else instruction
    answer = plain(response)
    said, asked_words = folded(answer), folded(plain(body))
    if len(said) < 4:  # too few to be a copy by chance or not, unless they are all there is
        if not said or said != asked_words:
            return False
    elif not _may_cover(said, asked_words * 2, least, cover):
        return False
    if m:
        for option in instruction[m.end() :].split("\n"):
            if folded(re.sub(r"^\s*[-*•]\s*", "", option)) == said:
                return False
    else:
        asked = without_context(instruction)
        if asked.lstrip().lower().startswith(("passage:", "text:")):
            asked = asked.strip().rsplit("\n", 1)[-1]
        else:
            asked = asked.strip().split("\n", 1)[0].split(":", 1)[0] + " " + (asked.strip().split("\n", 1)[0] if ":" not in asked else "")
        if ASKS_FOR_COPY.search(unquoted(asked)):
            return False
    if len(said) < 4:
        return True
    one, _ = tiles(said, asked_words * 2, least)  # twice, for a response that gives it back twice
    if one.sum() < cover * len(said):
        return False
    at = 0
    for sentence in SENTENCE.split(answer):
        n = len(folded(sentence))
        if n >= 4 and one[at : at + n].sum() < 0.34 * n:
            return False
        at += n
    for sentence in [body, *SENTENCE.split(plain(body)), *without_context(body).split("\x00"), *(x for x in re.split(r"[:\"“”„«»]", body))]:
        words = folded(plain(sentence))
        if len(words) >= 4:
            _, two = tiles(said, words, least)
            if two.sum() >= cover * len(words) or (len(words) >= 6 and said == words[: len(said)] and len(said) >= 0.6 * len(words)):
                return True
    return False


def is_refusal(response: str) -> bool:
    """It declines, and no sentence says anything else: what isn't a refusal has words of courtesy and few others, or
    hardly any word."""
    text = plain(response).replace("’", "'").replace("‘", "'").lower().strip()
    if not may_decline(text):
        return False
    declined = False
    for sentence in SENTENCE.split(text):
        words = WORD.findall(sentence)
        if not words:
            continue
        quoted = unquoted(sentence)
        if may_decline(quoted) and any(p.search(quoted) for p in REFUSAL):
            declined = True
        elif len(words) > 3:
            rest = len(WORD.findall(FILLER.sub(" ", quoted)))
            if rest == len(WORD.findall(quoted)) or rest > 14:
                return False
    return declined


def language(text: str) -> tuple[str | None, float, int]:
    """The language of the running text outside quotations and code, its share of function words, and their number."""
    scores, n = dict.fromkeys(FUNCTION_WORDS, 0.0), 0
    for word in WORD.findall(text.lower()):
        if word in LANGUAGE_OF:
            n += 1
            for key, weight in LANGUAGE_OF[word].items():
                scores[key] += weight
    total = sum(scores.values())
    best = max(scores, key=scores.get)
    return (best if n else None), (scores[best] / total if total else 0.0), n


def script(text: str) -> str | None:
    """The script most letters are of, where that isn't Latin."""
    other: dict[str, int] = {}
    for char in BEYOND_LATIN.findall(text):
        if char.isalpha():
            name = unicodedata.name(char, "?").split(" ")[0]
            other[name] = other.get(name, 0) + 1
    letters = sum(map(str.isalpha, text)) if other else 0
    if letters and other:
        best = max(other, key=other.get)
        if other[best] > 0.5 * letters and best not in ("LATIN", "FULLWIDTH", "MODIFIER"):
            return best
    return None


def is_other_language(response: str, instruction: str) -> bool:
    """Another script than the instruction's, or words of another language, unless the instruction asks for one."""
    asked = without_context(unquoted(OPTIONS.split(instruction)[0]))
    own = script(response)
    odd_script = own is not None and own != script(instruction)
    first = asked.split(":", 1)[0] if ":" in asked and len(asked.split(":", 1)[0].split()) >= 3 else asked
    if asked.lstrip().lower().startswith(("passage:", "text:")):
        first = asked.strip().rsplit("\n", 1)[-1]
    if not odd_script and not _odd_words(response, first, asked):
        return False
    if ASKS_FOR_LANGUAGE.search(asked):
        return False
    return odd_script or not (ASKS_FOR_COPY.search(first) or OPTIONS.search(instruction))


def _odd_words(response: str, first: str, asked: str) -> bool:
    wanted, sure, n = language(first)
    if wanted is None or n < 2 and len(WORD.findall(first)) > 3 and sure < 0.6:
        wanted, sure, n = language(asked)
    spoken, part, m = language(unquoted(plain(response)))
    if wanted is None or sure < 0.4:
        return False
    if spoken is not None and spoken != wanted and m >= 3 and part >= 0.55:
        return True
    words = WORD.findall(unquoted(plain(response)).lower())
    if len(words) < 4 or m > 0.3 * len(words) and spoken == wanted:
        return False
    own = FUNCTION_SETS[wanted]
    others = max(sum(w in known and w not in own for w in words) for known in FURTHER.values())
    return others >= 3 and others >= 0.15 * len(words) and others > 2 * sum(w in own and not any(w in known for known in FURTHER.values()) for w in words)


OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}, {")", "]", "}", "”", "»"}
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "col"}
INTERVAL = re.compile(r"(?<![\w)\]])[\[(]\s*[-+]?[\w.∞]+\s*[,;]\s*[-+]?[\w.∞]+\s*[\])]")
INCHES = re.compile(r"(?<=\d)\"(?=[\s,.;:!?)x×-]|$)")
TOKEN = re.compile(r"```|`|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|[()\[\]{}“”«»„\"]|^\s*(?:\(?\d{1,3}[.)]|[a-z]\))\s", re.M)


def _without_inches(text: str) -> str:
    """Without marks after digits that no open quotation waits for."""

    def kept(m: re.Match) -> str:
        return '"' if text.count('"', 0, m.start()) % 2 else ""

    return INCHES.sub(kept, text)


def unfinished(text: str) -> list[str]:
    """A pushdown parse of fences, brackets, quotations, list markers and tags: what is still open at the end.

    Strings in code hide their brackets; closers without an opener (smileys, list markers), half-open intervals and inch
    marks are let pass."""
    if not OPEN_OR_CLOSED.search(text):
        return []
    if "," in text and "```" not in text:
        text = INTERVAL.sub(" ", text)
    if '"' in text:
        text = _without_inches(text)
    stack: list[str] = []
    for m in TOKEN.finditer(text):
        token = m[0]
        top = stack[-1] if stack else ""
        if token == "```":
            if "```" in stack:
                inner = stack[stack.index("```") + 1 :]
                del stack[stack.index("```") :]
                if any(x in "([{" for x in inner):
                    stack.append("code")
            else:
                stack.append(token)
        elif token.strip() != token or token[:1].isdigit() or token.endswith(")") and len(token) > 1:
            continue
        elif token == "`":
            if "```" not in stack:
                stack.pop() if top == "`" else stack.append("`")
        elif token == '"':
            if top == '"':
                stack.pop()
            elif '"' in stack and "```" not in stack:
                del stack[stack.index('"') :]
            else:
                stack.append('"')
        elif top in ('"', "`") and token != '"' and "```" in stack:
            continue
        elif token[0] == "<":
            name = re.match(r"</?([A-Za-z0-9]+)", token)[1].lower()
            if "```" in stack or name in VOID_TAGS or token.endswith("/>"):
                continue
            if token[1] == "/":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == f"<{name}>":
                        del stack[k:]
                        break
            elif name in ("p", "div", "span", "b", "i", "em", "strong", "ul", "ol", "li", "code", "pre", "table", "tr", "td", "a", "blockquote", "h1", "h2", "h3"):
                stack.append(f"<{name}>")
        elif token in OPENERS and not (token == "“" and "„" in stack):
            stack.append(token)
        else:
            wanted = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "“": "„"}[token]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == wanted or token == "”" and stack[k] == "„":
                    del stack[k:]
                    break
    return stack


LONGEST_WORD = 64
DIGIT = re.compile(r"\d")
END_MARKS = (".", "!", "?", "…", "。", "！", "？")
OPEN_OR_CLOSED = re.compile("[()\\[\\]{}“”«»„\"`<]")
ENDED = re.compile(r"(?:[.!?…。！？]|\.\.\.)[\"'”»“’)\]*_`~\s]*(?:\([^()]{1,60}\)\s*)?$|[`\"”»]\s*$|[\U0001F300-\U0001FAFF☀-➿️]\s*$|```\s*$|</[A-Za-z]+>\s*$|[)\]}]\s*$")
MARKER = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|[a-z]\))\s*$")
ITEMS = re.compile(r"(?m)^\s*(?:[-*•–]|\(?\d{1,3}[.)])\s+\S")
ASKED_ITEMS = re.compile(r"(?i)\b(?:list|give|name|nenne|liste|cite|enumera|énumère)\b\s+(\d{1,2})\b")


def truncation(response: str, instruction: str) -> tuple[bool, str | None]:
    """Whether the response is cut off; where that hangs on its last words alone, no, and the last two in lower case."""
    text = html.unescape(response)
    text = (text if text.isascii() else INVISIBLE.sub("", text)).rstrip()
    if OPTIONS.search(instruction):
        given = folded(plain(text))
        options = [folded(re.sub(r"^\s*[-*•]\s*", "", x)) for x in OPTIONS.split(instruction)[-1].split("\n")]
        if given in options:
            return False, None
        joined = "".join(given)
        return any(len(x) and len(joined) < len("".join(x)) and "".join(x).startswith(joined) for x in options) or bool(unfinished(text)), None
    if unfinished(text):
        return True, None
    lines = text.split("\n")
    if len(lines) > 1 and MARKER.match(lines[-1]):
        return True, None
    if DIGIT.search(instruction) and (m := ASKED_ITEMS.search(instruction)):
        n = len(ITEMS.findall(text))
        if 0 < n < int(m[1]) and (n > 1 or len(WORD.findall(text)) < 40):
            return True, None
    if re.search(r"[,;:\-–—/&+=(]$", text) and not text.endswith("--"):
        return True, None
    if text[-1:] in END_MARKS or ENDED.search(text):
        return False, None
    words = WORD.findall(plain(text))
    if not words:
        return False, None
    if SHORT_ANSWER.search(without_context(instruction).strip()) and len(words) <= (2 if words[-1].lower() in DANGLING else 8):
        return False, None
    return False, " ".join(words[-2:]).lower()


def is_cut(word: str, both_end: int, both_else: int, ends: int, others: int, longer: int, enough: int = 10, share: float = 0.05) -> bool:
    """Whether a text that stops at ``word`` is cut off: the table has it at the end of ``ends`` sentences, in ``others``
    other places, after the same word before it in ``both_end`` and ``both_else`` of these, and ``longer`` words that
    begin with it. What the table hardly has is judged beforehand: function words end nothing, other words may."""
    if both_end + both_else >= enough:
        return both_end < share * (both_end + both_else)
    if ends + others >= enough:
        return ends < share * (ends + others)
    if ends + others == 0 and longer >= 2 * enough and not word.isdigit():
        return True
    return ends == 0 and word in DANGLING


def defect_of(prompt: str | None, response: str | None) -> str | None:
    """The defect of one pair by itself, or null for a sound one. A null prompt is an empty one."""
    defect, word = _defect_or_word(prompt, response)
    return "truncated" if word is not None and is_cut(word.split()[-1], 0, 0, 0, 0, 0) else defect


def _defect_or_word(prompt: str | None, response: str | None) -> tuple[str | None, str | None]:
    prompt = prompt or ""
    if is_empty(response, prompt):
        return "empty", None
    instruction = instruction_of(prompt)
    if instruction and is_copied(response, instruction):
        return "copied", None
    if is_refusal(response):
        return "refusal", None
    if instruction and is_other_language(response, instruction):
        return "other_language", None
    cut_off, word = truncation(response, instruction)
    return ("truncated" if cut_off else None), word


def endings(responses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, before, both_end, both_else, ends, others, longer) of each of the ``wanted`` (word, before: the word before
    it, or null): how often it ends a sentence that has an end mark and how often it stands elsewhere in column
    ``response``, after ``before`` and at all, last words of texts left out, and how many longer words begin with it.

    All words of all rows are counted, in the engine's own functions and with partial sums before the shuffle. An unbroken
    run of more than ``LONGEST_WORD`` letters is no word that another could be the beginning of."""
    # marks stand for places that would take the whole array into every row: the end of a text, and of a sentence's words
    parts = F.explode(F.split(F.concat(F.lower("response"), F.lit("\u0001")), r"(?<=[.!?…])[\"”»)\]]*\s+|\n+")).alias("part")
    rows = responses.select(parts).select(F.regexp_extract_all("part", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("words"), F.endswith("part", F.lit("\u0001")).alias("last"), F.col("part").rlike(r"[.!?…][\"”»)\]*_`]*\s*\x01?$").alias("ended"))
    shifted = F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit("")), F.col("words")).alias("before"), F.concat(F.slice("words", 2, 1 << 30), F.array(F.lit(""))).alias("after"))
    rows = rows.where(F.size("words") > 0).select(F.explode(shifted).alias("x"), "last", "ended").select("x.word", "x.before", F.col("x.after") == "", "last", "ended").toDF("word", "before", "final", "last", "ended")
    rows = rows.where("word is not null and (not final or ended or not last)").select("word", F.nullif("before", F.lit("")).alias("before"), F.expr("final and ended").alias("ends"), F.expr("not final").alias("others"))
    per = cut(rows.groupBy("word").agg(F.count_if("ends").alias("ends"), F.count_if("others").alias("others")))  # used twice, in two forms
    begun = per.where(F.length("word").between(2, LONGEST_WORD)).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("word"), (F.col("ends") + F.col("others")).alias("n"))
    begun = begun.groupBy("word").agg(F.sum("n").alias("longer"))
    both = rows.join(wanted, ["word", "before"], "left_semi").groupBy("word", "before").agg(F.count_if("ends").alias("both_end"), F.count_if("others").alias("both_else"))
    return wanted.join(both, ["word", "before"], "left").join(per, "word", "left").join(begun, "word", "left").na.fill(0, ["both_end", "both_else", "ends", "others", "longer"])


def defects(pairs: DataFrame, key: str = "pair_id", prompt: str = "prompt", response: str = "response") -> DataFrame:
    """(key, defect): one row per defective pair of ``pairs``.

    Null and blank responses are ``empty``; null keys come out as they are; repeated deliveries count as rows; an
    empty table gives an empty table; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_defect_or_word(a, b) for a, b in zip(batch.column("prompt").to_pylist(), batch.column("response").to_pylist())]
            keep = pa.array([d is not None or w is not None for d, w in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([d for d, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], [key, "defect", "word"]).filter(keep)

    def cut_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [is_cut(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("word", "both_end", "both_else", "ends", "others", "longer")))]
            yield batch.select([key]).append_column("defect", pa.array(["truncated"] * batch.num_rows, pa.string())).filter(pa.array(keep, pa.bool_()))

    kind = f"`{key}` {pairs.schema[key].dataType.simpleString()}"
    rows = pairs.select(F.col(key), F.col(prompt).cast("string").alias("prompt"), F.col(response).cast("string").alias("response"))
    judged = cut(rows.mapInArrow(run, f"{kind}, defect string, word string"))
    open_ = judged.where("defect is null").select(key, F.substring_index("word", " ", -1).alias("word"), F.when(F.contains("word", F.lit(" ")), F.substring_index("word", " ", 1)).alias("before"))
    wanted = cut(open_.select("word", "before").distinct())
    counted = endings(rows.where("response is not null"), wanted)
    open_ = open_.join(counted, open_["word"].eqNullSafe(counted["word"]) & open_["before"].eqNullSafe(counted["before"])).select(key, counted["word"], "both_end", "both_else", "ends", "others", "longer")
    return judged.where("defect is not null").select(key, "defect").unionAll(open_.mapInArrow(cut_off, f"{kind}, defect string"))


def report(pairs: DataFrame) -> DataFrame:
    """Pairs and defects per source and formatter."""
    bad = defects(pairs)
    per = pairs.select("pair_id", F.coalesce("source", F.lit("unknown")).alias("source"), "preproc").join(bad, "pair_id", "left")
    return per.groupBy("source", "preproc", F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("pairs"))
