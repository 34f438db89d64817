"""Defective pairs of goal and answer, by tagging the answer's clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import pair_examples as examples
from casewright.llm.crf import ChainCRF
from casewright.llm.language import FUNCTION_WORDS, TASK_WORDS, asked_languages, language_of, prose_words
from casewright.llm.literals import Sieve

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
# Words that stand for no answer, after everything but letters and digits is gone.
NO_ANSWER = {"", "na", "none", "null", "nil", "nan", "nooutput", "noanswer", "noresponse", "empty", "undefined", "blank", "tbd", "todo", "unknown", "notavailable",
             "notapplicable", "noresult", "noresults", "nocontent", "nothing", "keineantwort", "keineausgabe", "sansréponse", "aucuneréponse", "sinrespuesta", "semresposta",
             "нетответа", "无", "无输出", "没有回答", "noreply", "emptyresponse", "void", "ninguno", "nenhum", "aucun", "keine", "нет"}
# Cues of a refusal in its parts; a clause that declines a goal mostly shows two of them.
CUES = {
    "unable": r"\b(?:não estou|no estoy|ne suis pas autoris\w+|bin nicht (?:befugt|berechtigt)|outside (?:of )?what i|beyond (?:my|what i)|out of (?:my )?scope|not something i|can(?:no|')t|can not|cannot|unable to|not able to|won't be able|will not|won't|couldn't|could not|am not allowed|mustn't|must not|do not have|don't have|kann\b.{0,40}\bnicht|nicht möglich|nicht in der lage|ne peux\b|ne suis pas en mesure|impossible de|no puedo|no me es posible|não posso|não consigo|не могу|не можем|невозможно)|无法|不能|没有办法|未能",
    "help": r"\b(?:answer (?:this|that)|respond to|répondre|responder|beantworten|antworten|ответить|help with|assist|provide an? answer|complete this|this (?:request|task|instruction)|do (?:this|that)|carry out|fulfil?l|comply|hilfe|helfen|weiterhelfen|anfrage|bearbeiten|aider|cette demande|cette tâche|ayudar|esta solicitud|esta tarea|ajudar|este pedido|esta solicitação|помочь|этот запрос|с этим|выполнить)|协助|帮助|请求|完成这|回答",
    "self": r"\b(?:as an (?:ai|a\.i\.|assistant|language model)|ai assistant|language model|als (?:ki|assistent|sprachmodell)|en tant qu|como (?:asistente|assistente|modelo|ia)|как (?:ассистент|помощник|модель|ии))|作为.{0,6}(?:助手|模型|AI)",
    "policy": r"\b(?:autoriza\w+|autoris\w+|befugt|berechtigt|allowed to do|inappropriate|not appropriate|comfortable|unethical|leave to a human|left to a human|capabilit\w+|abilities|policy|policies|guidelines|not permit|permitted|against my|not allowed|richtlinien|erlaub\w*|consignes|directives|políticas?|normas|diretrizes|правил\w*|политик\w*)|政策|准则|规定",
    "decline": r"\b(?:i (?:must |have to |need to )?(?:decline|refuse)|i'd rather not|i(?:'d| would)? prefer not|i'll (?:stop|have to stop)|i have to leave|i hope (?:you|that|this) (?:understand|is understandable)|no changes were made|i will leave|ablehnen|lehne|refuser|refuse de|rechaz\w+|debo negarme|recus\w+|отказ\w+|вынужден\w*)|拒绝|谢绝",
    "sorry": r"\b(?:sorry|apologi[sz]e|unfortunately|regret\w*|leider|tut mir leid|entschuldig\w*|désolée?|malheureusement|lo siento|lamento|desculp\w*|infelizmente|sinto muito|извините|прошу прощения|к сожалению|простите)|抱歉|对不起|遗憾",
    "first": r"\b(?:i|i'm|i'd|my|ich|mir|mich|je|j'|me|mi|eu|minha|я|мне|мои|puedo|posso|не могу|no puedo)\b|我",
    "access": r"\b(?:have access|access to your|zugriff|accès à|acceso a|acesso a|доступ)|访问",
    "after": r"\b(?:any ?more|any longer|reproduce|about the|for the (?:long|noise|delay)|anymore|nicht mehr|plus reproduire|ya no|já não|больше не)\b|不再|重现",
}
_CUES = {k: v.replace("AI", "ai") for k, v in CUES.items()}  # run over lower case


@lru_cache(1)
def _cues() -> Sieve:
    return Sieve(_CUES)


_FENCE = regex.compile(r"```[^\n`]*\n?(.*?)(?:```|\Z)", regex.S)
_SENTENCE = regex.compile(r"(?<=[.!?…])(?<!(?:^|\n)[ \t]*\d{1,3}\.)[\"'”»*_)]*\s+|(?<=[。！？])|\n+")
#: Without this a line has no place where it could be split into sentences.
_ENDS = re.compile(r"[.!?…][\"'”»*_)]*\s|[。！？]")
_QUOTED = regex.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\"|`[^`\n]*`|「[^」]*」")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_DONE = re.compile(r"[.!?。！？]+[\"'”»*_)\]]*$")
_LABEL = regex.compile(r"^\W*(?:task|goal|you asked|request|question|prompt|instruction|aufgabe|ziel|tâche|demande|tarea|objetivo|tarefa|pedido|задача|запрос|任务|问题)\s*[:：]\s*", regex.I)
_CODE = re.compile(
    r"^\s{2,}\S|^\s*[\w.\[\]'\"$]+\s*=\s*\S|(?:^|\s)--[a-z]|^(?:ENV|RUN|COPY|FROM|ARG|CMD)\s|^\s*<\w|^\s*\[[\w.\-]+\]\s*$|^\s*[\w\-]+:\s*$|^\s*(?:def|class|import|from|return|export|const|let|var|if|for|while|curl|git|assert|raise|sudo|pip|npm|\$|#|//|\./|\+|@@|GET|POST|PUT).*[=(){}\[\]:/$]|^\s*[\w.\-'\"]+\s*[:=]\s*\S+$|[{};]\s*$|^\s*\S+\(.*\)\s*$|^-----|^\s*[A-Za-z0-9+/=]{30,}$|^\s*[+\-]\w+ ?=|\s->\s|::|\|"
)
_FIRM = re.compile(r"^\s*(?:return|def|assert|raise|import|yield)\b.*[=()\[\]:]|^(?:\t| {2,})\S.*[=()\[\]{}]")
_WORD = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"https?://\S+$")
_HAN = regex.compile(r"\p{Han}{4,}")
_FUNCTION = frozenset(w for t in (FUNCTION_WORDS, TASK_WORDS) for v in t.values() for w in v.split()) - {"i", "no", "all"}
_LONGEST = 2 * max(map(len, NO_ANSWER))  # lower case may be shorter
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|```\w*")


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, punctuation, empty markup or a word standing for no answer."""
    if answer is None:
        return True
    said = ""
    for m in _WORD.finditer(_MARKUP.sub(" ", answer) if "<" in answer or "`" in answer else answer):
        said += m.group()
        if len(said) > _LONGEST:
            return False
    return said.lower() in NO_ANSWER


def clauses(answer: str) -> list[tuple[str, str]]:
    """(kind, text) of an answer in order: ``prose``, ``more`` (prose after a sentence on the same line), ``item``,
    ``code``, or ``open`` for a code block never closed."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in [*_FENCE.finditer(answer), None]:
        for line in answer[at : m.start() if m else len(answer)].split("\n"):
            code = _FIRM.search(line) or _CODE.search(line) and len(set(prose_words(line)) & _FUNCTION) < 3
            kind = "item" if _ITEM.match(line) else "code" if code else "prose"
            for k, piece in enumerate(p for p in ([line] if kind != "prose" or not _ENDS.search(line) else _SENTENCE.split(line)) if _WORD.search(p)):
                out.append(("more" if k else kind, piece))
        if m:
            if _WORD.search(m.group(1)):
                out.append(("code" if m.group().endswith("```") and len(m.group()) > 5 else "open", m.group(1)))
            at = m.end()
    return out


def features(goal: str, parts: list[tuple[str, str]]) -> list[list[str]]:
    """Binary features of every clause, seen against its goal."""
    goal_words, spoken, asked = set(_WORD.findall(goal.lower())), language_of(goal), None
    out, sieve = [], _cues()
    for k, (kind, text) in enumerate(parts):
        last = k == len(parts) - 1
        fs = ["bias", f"kind {kind}", "first" if k == 0 else "later"]
        words = _WORD.findall(_LABEL.sub("", text).lower())
        share = sum(w in goal_words for w in words) / max(1, len(words))
        fs.append("echo all" if share >= 0.95 else "echo most" if share >= 0.75 else "echo half" if share >= 0.5 else "echo little")
        if len(words) >= 3 and share >= 0.95:
            fs.append("echo long")
        if kind in ("prose", "more", "item"):
            bare = _QUOTED.sub(" ", text)
            heard = language_of(bare)
            if heard and spoken:
                asked = asked_languages(goal) if heard != spoken and asked is None else asked
                fs.append("language same" if heard == spoken else "language asked" if heard in asked else "language other")
            cues = sieve.names(bare.lower())
            fs += [f"cue {c}" for c in cues]
            fs += [f"cues {a} {b}" for a in cues for b in cues if a < b]
        if last and kind == "open":
            fs.append("ends open")
        elif last and kind == "item":
            said = _ITEM.sub("", text).split()
            hanging = text.rstrip()[-1:] in ",、，" or len(said) > 1 and said[-1] in _FUNCTION
            fs.append("ends hanging" if hanging else "ends item")
        elif last and kind in ("prose", "more"):
            tail = text.rstrip()
            end = prose_words(tail)
            natural = sum(w in _FUNCTION for w in end)
            spoken_last = _WORD.findall(tail.lower())
            lead = spoken_last[:1]
            if _DONE.search(tail):
                fs.append("ends done")
            elif _ADDRESS.search(tail) and len(end) <= 4:
                fs.append("ends address")
            elif tail[-1] in "…:;,、，–—-(" or (spoken_last and spoken_last[-1] in _FUNCTION and share < 0.9):
                fs.append("ends hanging")
            elif natural >= 2 and len(end) >= 4 or _HAN.search(tail):
                fs.append("ends prose")
            elif natural and lead and lead[0] in _FUNCTION and len(parts) > 1:
                fs.append("ends prose")
            else:
                fs.append("ends word" if kind == "prose" else "ends midline")
        out.append(fs)
    return out


@lru_cache(1)
def trained() -> ChainCRF:
    """The model, fitted to the labelled examples beside this module (their number bounds the sample)."""
    rows = examples.labelled()
    cut = [clauses(answer) for _, answer, _ in rows]
    for (_, answer, tags), parts in zip(rows, cut):
        if len(parts) != len(tags):
            raise ValueError(f"{len(parts)} clauses, {len(tags)} tags: {answer!r}")
    return ChainCRF(TAGS).fit([features(goal, parts) for (goal, _, _), parts in zip(rows, cut)], [tags for _, _, tags in rows])


def defect_of(goal: str | None, answer: str | None, model: ChainCRF) -> str | None:
    """The defect of one pair, or None if it is sound; see ``defects_of``."""
    return defects_of([goal], [answer], model)[0]


def defects_of(goals: list[str | None], answers: list[str | None], model: ChainCRF) -> list[str | None]:
    """The defects of pairs, None for sound ones; a null goal counts as an empty one.

    Coverage is the share of the clauses' words. A pair without any word is empty. Else a refusal among the
    first two sentences (of two words or more) that covers a sixth, or any that covers a third, declines; an echo that leaves no answer copies; foreign prose of more than half is in the wrong
    language; an unfinished last clause makes the rest truncated.
    """
    parts = [[] if is_empty(a) else clauses(a) for a in answers]
    tagged = model.tag_all([features(g or "", p) if p else [] for g, p in zip(goals, parts)])
    return [_defect(p, t) if p else "empty" for p, t in zip(parts, tagged)]


def _defect(parts: list[tuple[str, str]], tags: list[str]) -> str | None:
    sizes = [max(1, len(t) // 2) if not t.isascii() and _HAN.search(t) else max(1, len(_WORD.findall(t))) for _, t in parts]
    cover = {t: sum(s for s, x in zip(sizes, tags) if x == t) for t in TAGS}
    prose = sum(s for s, (kind, _) in zip(sizes, parts) if kind in ("prose", "more", "item"))
    said = [t for t, n, (kind, _) in zip(tags, sizes, parts) if kind in ("prose", "more") and t != "echo" and (n > 1 or t == "refusal")]  # "No." is no sentence
    if "refusal" in said[:2] and cover["refusal"] * 6 > sum(sizes) or cover["refusal"] * 3 > sum(sizes):
        return "refusal"
    if cover["echo"] and cover["echo"] >= 0.9 * sum(sizes):
        return "copy"
    if cover["foreign"] * 2 > prose:
        return "wrong_language"
    return "truncated" if tags[-1] == "unfinished" else None


def defective_pairs(df: DataFrame, key: str, goal: str, answer: str) -> DataFrame:
    """Defective pairs with their defect: columns ``key``, ``defect``; sound pairs are left out.

    A conditional random field tags the clauses of each answer (answer, refusal, echo, foreign, unfinished); the
    clauses' coverage decides, see ``defect_of``. The field is fitted by the driver to a bounded set of labelled
    examples and broadcast (some kilobytes). No shuffle; Arrow batches.

    A null, blank or stand-in answer is ``empty``, whatever the goal; a null goal has no language and no words, so only
    empty, refusal and truncated apply. Null keys are kept. Answers of any length are read whole. Rows repeated in
    ``df`` are repeated in the result. Other columns are not read.
    """
    share = df.sparkSession.sparkContext.broadcast(trained())
    source = df.select(F.col(key).alias(key), F.col(goal).alias("_g"), F.col(answer).alias("_a"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            defects = defects_of(batch["_g"].tolist(), batch["_a"].tolist(), share.value)
            out = pd.DataFrame({key: batch[key], "defect": defects}, dtype=object)
            yield out[out["defect"].notna()]

    return source.mapInPandas(run, f"`{key}` {kind}, defect string")
