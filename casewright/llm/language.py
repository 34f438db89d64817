"""Language of short technical prose by script and function words."""

from __future__ import annotations

import re

import regex

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an of and to in is was that this it for on with as by at from be are were has have had not no but or which who when because so before after if then while until each every any other still only than into without does do did can cannot could should will would must may how why what where there here please its their them they you your we our i my me all both either instead been being now after whether up between about over under out per",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist war sind waren wird werden wurde wurden hat haben mit von aus bei nach auf für im in an zu zum zur als wie wenn weil dass damit noch auch nur schon sich es er sie wir ihr ich wert bitte warum mehr über unter vor durch ohne bis kann können muss soll keine kein diese dieser dieses",
    "fr": "le la les un une des du de et ou mais ne pas plus est sont était été a ont avec pour par dans sur au aux ce cette ces qui que quoi dont où quand car afin il elle nous vous ils je mon votre son sa ses leur aussi encore avant après sans tout toute être fait pourquoi lors toujours jamais n l d qu j s",
    "es": "el la los las un una unos unas de del y o pero no es son era fue ha han con por para en al que como cuando porque se su sus lo le les ya más muy también todavía antes después sin hasta esta este esto estas estos nos si qué está sigue hay nadie ser había quedan tarda limpia haga ellos ella usted",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas não é são era foi com por para em no na nos nas ao à que como quando porque se seu sua seus suas já mais muito também ainda antes depois sem até esta este isto nós pelo pela foram você vocês ainda isso também lhe havia ninguém mesmo fique",
    "ru": "и в на не что с по из для к от до о за при как это был была было были мы я он она они его чтобы бы же ли или но уже ещё после перед когда где всё все",
}
# Words of tasks, which tell English as well as its function words do but join no clauses.
TASK_WORDS = {"en": "passes fails make makes made add remove write find clean explain fix show return replace review continue use run keep drop test tests tolerate speed upgrade document investigate new old first last same"}
# Characters that one of the languages uses and the others with the same script don't.
MARKS = {"de": "äöüß", "fr": "êèçœùûîôë", "es": "ñ¿¡", "pt": "ãõ"}
# How a request names a language.
NAMES = {
    "en": ["english", "englisch", "anglais", "inglés", "inglês", "английск", "英语", "英文"],
    "de": ["german", "deutsch", "allemand", "alemán", "alemão", "немецк", "德语"],
    "fr": ["french", "französisch", "français", "francés", "francês", "французск", "法语"],
    "es": ["spanish", "spanisch", "espagnol", "español", "castellano", "espanhol", "испанск", "西班牙语"],
    "pt": ["portuguese", "portugiesisch", "portugais", "portugués", "português", "португальск", "葡萄牙语"],
    "ru": ["russian", "russisch", "russe", "ruso", "russo", "русск", "俄语"],
    "zh": ["chinese", "chinesisch", "chinois", "chino", "chinês", "китайск", "中文", "汉语"],
    "ja": ["japanese", "japanisch", "japonais", "japonés", "japonês", "японск", "日语"],
    "it": ["italian", "italienisch", "italien", "italiano", "итальянск", "意大利语"],
}
_ASK = regex.compile(
    r"(?i)\b(?:answer|reply|respond|write|report|explain|summari[sz]e|antworte\w*|schreib\w*|répond\w*|réponse|écri\w*|respond\w*|contest\w*|responda|escrev\w*|escrib\w*|ответ\w*|напиш\w*)\b[^.!?\n]{0,60}|(?:用|以)[^。]{0,8}(?:回答|回复|答复)|\b(?:in|auf|en|em|на)\s+\p{L}+(?:ом)?\b\W*$"
)
_SETS = {k: frozenset(f"{v} {TASK_WORDS.get(k, '')}".split()) for k, v in FUNCTION_WORDS.items()}
_OWNERS: dict[str, list[str]] = {}
for _lang, _words in _SETS.items():
    for _w in _words:
        _OWNERS.setdefault(_w, []).append(_lang)
#: What makes a token no word of prose.
_ODD = re.compile(r"[_/\\@=<>{}\[\]()#$\d]|\w\.\w")
_WORDS = regex.compile(r"\p{L}+")
_CJK = regex.compile(r"\p{Han}")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_CYR = regex.compile(r"\p{Cyrillic}")


def _plain(text: str) -> str:
    return " ".join([t for t in text.split() if t.isalpha() or not _ODD.search(t)]) if _ODD.search(text) else text


def prose_words(text: str) -> list[str]:
    """Lower-case words of a text without identifiers, paths, numbers and addresses."""
    return _WORDS.findall(_plain(text).lower())


def language_of(text: str) -> str | None:
    """Language of a text, or None where its words don't tell; empty text tells nothing."""
    plain = _plain(text).lower()
    words = _WORDS.findall(plain)
    letters = sum(map(len, words))
    if not letters:
        return None
    ascii_only = plain.isascii()
    if not ascii_only:
        if len(_KANA.findall(plain)) * 10 >= letters:
            return "ja"
        if len(_CJK.findall(plain)) * 3 >= letters:
            return "zh"
        if len(_CYR.findall(plain)) * 2 >= letters:
            return "ru"
    score = dict.fromkeys(_SETS, 0.0)
    for w in words:
        if w in _OWNERS:
            owners = _OWNERS[w]
            for lang in owners:
                score[lang] += 1 / len(owners)
    for lang, marks in () if ascii_only else MARKS.items():
        score[lang] += 0.7 * sum(any(c in w for c in marks) for w in words)
    (best, first), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best if first >= 0.9 and first > second else None


def asked_languages(goal: str) -> set[str]:
    """Languages in which a goal asks to be answered."""
    out = set()
    for m in _ASK.finditer(goal, overlapped=True):
        part = m.group().lower()
        out |= {lang for lang, names in NAMES.items() if any(n in part for n in names)}
    return out
